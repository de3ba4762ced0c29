"""Ranked lexical search, a term at a time with limited accumulators."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.llm.common import table
from ledgerlift.operators.ordering import running_total
from ledgerlift.session import stored

#: Terms of the items that one reading of the documents answers.
BLOCK_TERMS = 50_000
#: Postings that are scored at a time, and bytes of a text that are cut into terms at a time.
BLOCK_POSTINGS, SLICE_BYTES = 2_000_000, 4 << 20
#: Parts in which a ranking's candidates are first cut, so that no task takes all of an item.
PARTS = 32

_KEPT = (string.digits + string.ascii_letters).encode() + bytes(range(128, 256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms in order, a slice at a time: runs of letters, digits and all beyond ASCII, A-Z lower-cased.

    UTF-8 bytes beyond ASCII belong to such characters only, so bytes are cut as characters would be.
    """
    text = text.translate(_FOLD)
    first = 0
    while first < len(text):
        last = text.find(b" ", first + SLICE_BYTES)
        last = len(text) if last < 0 else last
        yield text[first:last].split()
        first = last


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [sorted({t for part in terms(x or b"") for t in part}) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in held], pa.int64()), pa.array(held, pa.list_(pa.binary()))],
            ["item_id", "n_terms", "terms"],
        )


def _postings(vocabulary: dict[bytes, int]):
    """(doc_id, n, ids, tfs): a document's number of terms and those of the vocabulary with their occurrences."""
    width = len(vocabulary) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            rows, lengths, ids, tfs = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            hits: list[int] = []

            def settle():
                # one sort counts the pairs of (document, term) gathered so far
                pairs, counts = np.unique(np.array(hits, np.int64), return_counts=True)
                ids.append(pairs)
                tfs.append(counts)
                hits.clear()

            for d, text in enumerate(batch.column(1).cast(pa.large_binary())):
                n, shift = 0, d * width
                for part in terms(text.as_py() or b""):
                    n += len(part)
                    hits += [shift + i for t in part if (i := known(t)) is not None]
                    if len(hits) > BLOCK_POSTINGS:
                        settle()
                if n:
                    rows.append(d)
                    lengths.append(n)
            settle()
            pairs, counts = np.concatenate(ids), np.concatenate(tfs)
            order = np.argsort(pairs, kind="stable")  # a document's pairs may have been counted in parts
            pairs, first = np.unique(pairs[order], return_index=True)
            counts = np.add.reduceat(counts[order], first) if len(first) else counts
            offsets = np.searchsorted(pairs, np.append(np.array(rows, np.int64) * width, batch.num_rows * width)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array((pairs % width).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                ["doc_id", "n", "ids", "tfs"],
            )

    return run


class Ranking:
    """The best documents of one item so far: higher scores first, then smaller ids, documents without an id last."""

    def __init__(self, most: int):
        self.most = most
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)

    def least(self) -> int:
        """What a further document must score at least; ties may still win by their id."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        unnamed = np.concatenate([self.unnamed, unnamed])
        best = np.lexsort((doc, unnamed, -score))[: self.most]
        self.score, self.doc, self.unnamed = score[best], doc[best], unnamed[best]


class Block:
    """Some documents' postings by term, with every posting's share of a score."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, share: np.ndarray, size: int):
        order = np.argsort(ids, kind="stable")
        self.size = size
        self.doc, self.share = doc[order], share[order]
        self.term, self.first = np.unique(ids[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.bound = np.maximum.reduceat(self.share, self.first) if len(order) else np.zeros(0, np.int64)

    def search(self, rarest_first: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the `most` best with a score of `least` or more, and their exact scores.

        Terms come rarest first. Before each, what all terms from it on can add at most is held against the `most`-th
        best partial score: below it, a document without an accumulator cannot come in any more. From there
        on no accumulator is made, and those that can still reach that score are brought to their exact sums.
        """
        at = np.searchsorted(self.term, rarest_first)
        at = at[at < len(self.term)] if not len(self.term) else at[self.term[np.minimum(at, len(self.term) - 1)] == rarest_first]
        rest = np.append(np.cumsum(self.bound[at][::-1])[::-1], 0)
        if rest[0] < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums, alive = np.zeros(self.size, np.int64), None
        for k, t in enumerate(at):
            doc, share = self.doc[self.first[t] : self.last[t]], self.share[self.first[t] : self.last[t]]
            if alive is None and rest[k] < max(least, rest[0] - rest[k]):
                reached = least
                if self.size >= most:
                    reached = max(reached, int(np.partition(sums, self.size - most)[self.size - most]))
                if rest[k] < reached:
                    alive = np.flatnonzero(sums + rest[k] >= reached)
            if alive is None:
                sums[doc] += share
            else:
                place = np.minimum(np.searchsorted(doc, alive), len(doc) - 1)
                here = doc[place] == alive
                sums[alive[here]] += share[place[here]]
        found = np.flatnonzero(sums) if alive is None else alive
        found = found[sums[found] >= least]
        if len(found) > most:
            found = found[sums[found] >= np.partition(sums[found], len(found) - most)[len(found) - most]]
        return found, sums[found]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where its postings reach BLOCK_POSTINGS; a longer document is a block of its own."""
    ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_POSTINGS, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _score(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Ranking(most) for item, _ in queries}
        for batch in (b for whole in batches for b in _blocks(whole)):
            length = np.array([50 + 50 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            ids, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            share = weights[ids] * (1_000_000_000 * tf // (1000 * tf + 20 * length[doc]))
            block = Block(ids, doc, share, batch.num_rows)
            unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            named = batch.column(0).fill_null(0).to_numpy()
            for item, rarest_first in queries:
                found, score = block.search(rarest_first, most, best[item].least())
                if len(found):
                    best[item].add(score, named[found], unnamed[found])
        for item, r in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r.doc), item, np.int64)), pa.array(r.doc, pa.int64(), mask=r.unnamed), pa.array(r.score, pa.int64())],
                ["number", "doc_id", "score"],
            )

    return run


def _numbered(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, terms, number, block): items with terms, in blocks of bounded size."""
    once = items.groupBy(F.col(item).alias("item_id")).agg(F.min(text).alias("text"))
    schema = once.select("item_id", F.lit(0).cast("bigint").alias("n_terms"), F.array().cast("array<binary>").alias("terms")).schema
    held = once.mapInArrow(_item_terms, schema).where("n_terms > 0")
    # the terms so far number an item, too: every one adds some
    order = running_total(held, [], ["item_id"], "n_terms", "number")
    block = F.floor(F.col("number") / BLOCK_TERMS)
    return stored(order.select("item_id", "terms", "number", block.alias("block")), "items")


def search(
    docs: DataFrame, items: DataFrame, most: int = 50, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `most` documents of highest score above 0 for every item.

    A term weighs floor(1000 * ln((2N + 2) / (2 df + 1))), N the documents with a term, df those that hold it; the
    rest is integer arithmetic: with n a document's terms, L those of all documents and m = 50 + 50 n N div L,
    a term that occurs tf times adds weight * (10**9 tf div (1000 tf + 20 m)). Equal scores go by smaller id.

    Items are answered in blocks: whole items of at most BLOCK_TERMS terms together, or one longer item among
    them. Only such a block's vocabulary passes the driver. For a block the documents are read
    once into postings of that vocabulary (a table); N, L and df are counted on it; each task then works through
    its documents in blocks of postings, a term at a time, and keeps `most` documents per item, whose last score is what
    the next block must reach. Nothing but those is shuffled, and an item's candidates are cut in
    PARTS before they meet.

    Null or empty texts have no terms: such documents count nowhere, such items have no rows. Rows that
    repeat a doc_id are documents of their own; a null doc_id comes after all others of its score. Rows that repeat an item_id count
    once, by the smallest text. Empty tables give no rows; other columns of either table are not read.
    """
    spark = docs.sparkSession
    numbered = _numbered(items, item, item_text)
    out = None
    for block in sorted(r["block"] for r in numbered.select("block").distinct().collect()):
        rows = numbered.where(F.col("block") == block).select("number", "terms").collect()
        words = sorted({bytes(t) for r in rows for t in r["terms"]})
        known = {t: i for i, t in enumerate(words)}
        read = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        postings = stored(read.mapInArrow(_postings(known), "doc_id long, n long, ids array<int>, tfs array<long>"), "postings")
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(words), np.int64)
        for r in postings.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
            df[r["id"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        queries = []
        for r in rows:
            ids = np.array([known[bytes(t)] for t in r["terms"]], np.int64)
            queries.append((r["number"], ids[np.lexsort((ids, df[ids]))]))
        found = postings.mapInArrow(_score(queries, weights, n_docs, n_terms or 1, most), "number long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "number long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    first = F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))
    cut = part.withColumn("rank", first).where(F.col("rank") <= most)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op12_lexical_search": r"""
WITH words AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
occurs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, up, low), term)) AS term FROM documents, words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occurs GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
lengths AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM sizes, corpus),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, corpus GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, up, low), term)) AS term FROM benchmark, words),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
