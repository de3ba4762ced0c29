"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep_others, table
from ledgerlift.session import small_batches

#: Bytes of text in a language's dictionary, and the most rows that are read for one.
DICTIONARY_BYTES, SAMPLE_ROWS = 96 << 10, 400
#: A longer text gives its share in pieces of at most so many bytes, and in so many pieces at least.
PIECE_BYTES, PIECES = 256, 4
#: A text whose best language saves less than this share over the next one is rejected.
NARROW = 0.002
UNKNOWN = "und"


#: Bytes of the dictionary's tail that go ahead of every block of text, and of text in a block.
LEAD_BYTES, BLOCK_BYTES = 512, 16 << 10


_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text in lower case with one space for each run of anything but letters."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


def _coder(content: bytes):
    """The number of bytes that a text adds after a dictionary, which goes ahead of each of its blocks.

    So the dictionary is as near to the end of a long text as to its start, and what it saves grows with the text.
    """
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=3, hash_log=17, chain_log=16, window_log=18,
        write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    code = zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress
    # a tail of the dictionary goes ahead of every block: alone, a short text would be stored as it is
    lead = content[-LEAD_BYTES:]
    base = len(code(lead))
    return lambda raw: sum(
        len(code(lead + raw[at : at + BLOCK_BYTES])) - base for at in range(0, max(1, len(raw)), BLOCK_BYTES)
    )


def held_out(key: str = "doc_id") -> Column:
    """True for the quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spread(raw: bytes, share: int) -> bytes:
    """At most `share` bytes of a text, in pieces at even distances from its start to its end."""
    if len(raw) <= share:
        return raw
    n = min(max(PIECES, -(-share // PIECE_BYTES)), (share + 1) // 2)
    if n < 2:
        return raw[:share]
    size = (share - n + 1) // n
    return b" ".join(raw[at : at + size] for at in ((len(raw) - size) * i // (n - 1) for i in range(n)))


def _share(sizes: list[int]) -> int:
    """The bytes that each of the texts may give to fill a dictionary: what short ones leave goes to longer ones."""
    left = DICTIONARY_BYTES
    for k, size in enumerate(sizes := sorted(sizes)):
        if (size + 1) * (len(sizes) - k) > left:
            return max(0, left // (len(sizes) - k) - 1)
        left -= size + 1
    return DICTIONARY_BYTES


def _mapped(what, kind: pa.DataType):
    """For mapInArrow: (lang, draw, text) to (lang, draw, what(lang, the text's letters))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, draws, texts = batch.columns
            made = [what(lang, letters(text)) for lang, text in zip(langs.to_pylist(), (x.as_py() for x in texts))]
            yield pa.RecordBatch.from_arrays([langs, draws, pa.array(made, kind)], names=["lang", "draw", "made"])

    return run


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """A raw-content dictionary per language, from at most about SAMPLE_ROWS of its rows.

    Rows are drawn by a hash of their key against the language's row count, so a common language
    brings no more than a rare one. The drawn texts share DICTIONARY_BYTES evenly, and what short ones
    leave goes to the longer, which give pieces spread over their whole length: a language whose drawn
    texts hold that many bytes of letters fills its dictionary. What reaches the driver is a number per
    drawn row and a dictionary per language; a language is a label in use, a few hundred at most.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return {}
    chance = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_ROWS / n))]), F.col(lang))
    draw = F.pmod(F.xxhash64(F.lit("language"), key, text), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < chance).select(F.col(lang).alias("lang"), draw.alias("draw"), F.col(text).alias("text"))
    sizes: dict[str, list[int]] = {}
    for code, _, size in drawn.mapInArrow(_mapped(lambda _, raw: len(raw), pa.int64()), "lang string, draw double, made long").collect():
        sizes.setdefault(code, []).append(size)
    shares = {code: _share(held) for code, held in sizes.items()}
    pieces = drawn.mapInArrow(
        _mapped(lambda code, raw: _spread(raw, shares[code]), pa.binary()), "lang string, draw double, made binary"
    )
    out: dict[str, bytes] = {}
    for code, _, piece in pieces.orderBy("draw", "made").collect():
        held = out.get(code, b"")
        if len(held) < DICTIONARY_BYTES:
            out[code] = held + bytes(piece)[: DICTIONARY_BYTES - len(held)] + b" "
    return out


def _predict(dictionaries: dict[str, bytes]):
    names = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [_coder(dictionaries[name]) for name in names]
        for batch in batches:
            lang, score = [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                if not names or text is None or not any(map(str.isalpha, text)):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                raw = letters(text)
                sizes = [added(raw) for added in coders]
                best = int(np.argmin(sizes))
                low = sizes.pop(best)
                after = min(sizes, default=len(raw) + 12)
                lang.append(names[best])
                score.append((after - low) / after if after > low else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return run


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """Rows of `df` with lang_pred, score and rejected added; input columns of these names are replaced.

    A text's letters, in lower case, are compressed once per language, each block of BLOCK_BYTES after that language's
    dictionary, and the language of the smallest sum wins (the first by name where two are equal). score is the share
    by which it is smaller than the next best, and a score below NARROW is rejected; it does not fall with length. A null text, and one without any
    letter, is `und` with score 0 and rejected; so is every text if no language was learned. Whole texts
    are read, one at a time, whatever their length.
    """
    small_batches(df.sparkSession)
    cols = [c for c in keep_others(df, ["lang_pred", "score", "rejected"]) if c != text]
    rows = df.select(*cols, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["lang_pred string", "score double"])
    out = rows.mapInArrow(_predict(dictionaries), schema)
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < NARROW))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), dictionaries).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )
