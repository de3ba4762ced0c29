"""Concatenate and cut: documents' tokens in fixed windows."""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep_others, table
from ledgerlift.session import stored

SEQUENCE, END = 4096, 2
#: Words that a Python worker remembers (some 200 bytes each), and the bytes of text it encodes at a time.
REMEMBERED, STEP_BYTES = 500_000, 4 << 20
#: White space and control characters that words of bytes can hold though the tokenizer may cut there,
#: and the first letter beyond which lower case and composition need the tokenizer's own rules.
_ODD = regex.compile(r"[\x00-\x20\x7f-\xa0]")
_SIMPLE_BELOW = "İ"
_MARKS = ".,;:!?|"


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Ids of words, found once per distinct word.

    The tokenizer drops white space before it cuts words into pieces, so a text's ids are those of its words
    in a row. A word of plain letters is cut by the tokenizer's own pattern and its pieces are encoded many
    at once; any other word goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # fixed value: the pattern of the vocabulary's pre-tokenizer
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.words, self.flat, self.first = _Numbers(), array("I"), array("q", [0])
        self.uses = np.zeros(0, np.int64)

    def _ids(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words one after the other, and where each word's end."""
        flat, first = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.first, np.int64)
        long = first[index + 1] - first[index]
        ends = np.cumsum(long)
        return flat[np.repeat(first[index] - (ends - long), long) + np.arange(int(long.sum()))], ends

    def forget(self) -> None:
        """Keep the half that is used most."""
        least = np.partition(self.uses, -(REMEMBERED // 2))[-(REMEMBERED // 2)]
        keep = np.flatnonzero(self.uses > least)
        ids, ends = self._ids(keep)
        old, words = list(self.words), _Numbers()
        for i in keep.tolist():
            words[old[i]] = len(words)
        self.words, self.uses = words, self.uses[keep]
        self.flat, self.first = array("I", ids.tobytes()), array("q", [0])
        self.first.frombytes(ends.astype(np.int64).tobytes())

    def _learn(self, new: list[bytes]) -> None:
        """Add the ids of words that are numbered but not yet known, in their order."""
        parts: list = []
        pieces: dict[str, int] = {}
        for raw in new:
            word = raw.decode()
            # most words are letters, perhaps with one mark behind them
            if not word.isascii() and max(word) >= _SIMPLE_BELOW:
                cut = None
            elif word.isalpha():
                cut = (word.lower(),)
            elif word[-1] in _MARKS and word[:-1].isalpha():
                cut = (word[:-1].lower(), word[-1])
            else:
                cut = None if _ODD.search(word) else self.cut.findall(word.lower())
            parts.append(cut)
            for piece in cut or ():
                pieces.setdefault(piece, len(pieces))
        known: list[list[int]] = [[] for _ in pieces]
        todo = list(pieces)
        for i in range(0, len(todo), 2000):
            got = self.tokenizer.encode(" ".join(todo[i : i + 2000]), add_special_tokens=False)
            for at, token in zip(got.word_ids, got.ids):
                known[i + at].append(token)
        flat, ends, base = array("I"), array("q"), len(self.flat)
        for raw, cut in zip(new, parts):
            if cut is None:
                flat.extend(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids)
            else:
                for piece in cut:
                    flat.extend(known[pieces[piece]])
            ends.append(base + len(flat))
        self.flat.extend(flat)
        self.first.extend(ends)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > REMEMBERED:
            self.forget()
        # the tokenizer lowers its text; letters A-Z lowered first make fewer words
        cut = [t.lower().split() for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        seen = len(self.words)
        index = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        self._learn(list(islice(self.words, seen, None)))
        self.uses = np.bincount(index, minlength=len(self.words)) + np.pad(self.uses, (0, len(self.words) - seen))
        ids, ends = self._ids(index)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokens(path: str, end: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, upto = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            column = pc.fill_null(batch.column(text_at), "").cast(pa.binary())
            weight = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                done = weight[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(weight, done + STEP_BYTES, "right")))
                ids = coder.encode(column.slice(first, last - first).to_pylist())
                sizes = np.array([len(i) + 1 for i in ids], np.int64)
                before = upto + np.cumsum(sizes) - sizes
                upto += int(sizes.sum())
                tail = np.array([end], "<u4").tobytes()
                kept = [batch.column(i).slice(first, last - first) for i in range(batch.num_columns) if i != text_at]
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept, pa.array([i.astype("<u4").tobytes() + tail for i in ids], pa.binary()), pa.array(sizes),
                        pa.array(np.full(len(sizes), part, np.int32)), pa.array(before),
                    ],
                    names=[n for i, n in enumerate(batch.schema.names) if i != text_at] + ["ids", "doc_tokens", "_part", "_before"],
                )
                first = last

    return run


def tokenised(df: DataFrame, path: str, end: int = END, text: str = "text") -> DataFrame:
    """`df` without its text, with ids (little-endian 32-bit, the closing id last) and their place.

    First pass: each partition sums its own tokens as it goes (_before) and writes them once, so the second
    pass reads places that no retry can move.
    """
    cols = [c for c in keep_others(df, ["ids", "doc_tokens", "_part", "_before"]) if c != text]
    rows = df.select(*cols, text)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text]
        + ["ids binary", "doc_tokens long", "_part int", "_before long"]
    )
    return stored(rows.mapInArrow(_tokens(path, end, len(cols)), schema), "tokens")


def pack(tokens: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Pieces of the concatenated documents in sequences of `length`.

    Second pass: prefix sums over the partitions' totals (one row each) give every document its global
    offset; windows of fixed length cut the line, and a document that reaches over a window's end makes a
    boundary record in each window it touches. Only the last sequence is short. Adds start (ids of the
    document before the piece), length, sequence_id, offset, and whether the piece continues one or is
    continued; ids holds the piece's own.
    """
    totals = tokens.groupBy("_part").agg(F.sum("doc_tokens").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = tokens.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_offset") + F.col("_before"))
    size = F.lit(length).cast("bigint")
    stop = F.col("_at") + F.col("doc_tokens")
    windows = F.sequence(F.floor(F.col("_at") / size), F.floor((stop - 1) / size))
    cut = placed.withColumn("sequence_id", F.explode(windows))
    lo = F.greatest(F.col("_at"), F.col("sequence_id") * size)
    hi = F.least(stop, (F.col("sequence_id") + 1) * size)
    cut = cut.withColumns({"start": lo - F.col("_at"), "length": hi - lo, "offset": lo - F.col("sequence_id") * size})
    return cut.withColumns({
        "ids": F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))"),
        "continues": F.col("start") > 0,
        "continued": F.col("start") + F.col("length") < F.col("doc_tokens"),
    }).drop("_part", "_before", "_offset", "_at")


def pack_documents(df: DataFrame, path: str | None = None, text: str = "text", length: int = SEQUENCE) -> DataFrame:
    """Whole documents tokenised and packed; see `tokenised` and `pack`.

    A null text is an empty one, and an empty text is its closing id alone, so every row has a piece.
    Repeated rows are packed each. An empty table gives no pieces. Order is the table's own; columns of
    the input with the names of added ones are replaced.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rest = keep_others(df, ["start", "length", "sequence_id", "offset", "continues", "continued", "_offset", "_at"])
    return pack(tokenised(df.select(*rest), path, text=text), length)


def pieces(df: DataFrame) -> DataFrame:
    """The digest columns of packed pieces."""
    return df.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "continues", "continued",
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pieces(pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))
