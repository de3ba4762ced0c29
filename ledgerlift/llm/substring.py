"""Removal of long passages that repeat, by a compacted de Bruijn graph of token k-mers.

The graph's nodes are k-mers at minimiser positions: any two equal windows choose the same k-mer, so
nothing repeated is missed, and one word in thirteen makes a row. An edge joins a chosen k-mer to the next
one of its document and stands for all words from the one to the end of the other. A node whose every
occurrence has the same edge in and the same edge out does not branch; it is compacted away, and the path
through such nodes is one repeated span wherever it occurs. Only windows that reach over the end of such a
path are hashed one by one and counted, at their source coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep_others, table
from ledgerlift.llm.words import Lane, Slice, slices
from ledgerlift.session import stored

WINDOW, K = 35, 11
_INDEX_BITS = 28


def _lanes() -> tuple[Lane, Lane]:
    return Lane(11), Lane(12)


class Graph:
    """The chosen k-mers of a slice: word index, hash, and the hash of the edges on both sides."""

    def __init__(self, part: Slice, lane: Lane, window: int, k: int):
        words = lane.of_words(part.data, part.starts, part.ends)
        self.runs = lane.runs(words)
        n = len(words)
        left = part.words_left()
        self.doc = np.repeat(np.arange(part.n), np.diff(part.at))
        #: first words of windows
        self.windows = np.flatnonzero(left >= window)
        if not len(self.windows):
            self.at = self.hash = self.sides = np.zeros(0, np.uint64)
            self.whole = self.rank = np.zeros(0, bool)
            return
        kmers = np.arange(n - k + 1)
        value = self.runs.hash(kmers, kmers + k)
        # the smallest hash of each stretch, the leftmost where equal: minima over doubling stretches
        low = np.uint64((1 << _INDEX_BITS) - 1)
        best = (value & ~low) | np.arange(len(value), dtype=np.uint64)
        span, reach = window - k + 1, 1
        while reach * 2 <= span:
            best = np.minimum(best[:-reach], best[reach:])
            reach *= 2
        if reach < span:
            best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
        chosen = (best[self.windows] & low).astype(np.int64)
        #: per window, the index of its k-mer among the chosen ones
        self.at, self.rank = np.unique(chosen, return_inverse=True)
        self.hash = value[self.at]
        doc = self.doc[self.at]
        inner = np.zeros(len(self.at), bool)
        inner[1:-1] = (doc[1:-1] == doc[:-2]) & (doc[1:-1] == doc[2:])
        self.sides = np.zeros(len(self.at), np.uint64)
        mid = np.flatnonzero(inner)
        if len(mid):
            before = self.runs.hash(self.at[mid - 1], self.at[mid] + k)
            after = self.runs.hash(self.at[mid], self.at[mid + 1] + k)
            self.sides[mid] = before * np.uint64(0x9E3779B97F4A7C15) + after
        self.whole = inner

    def settle(self, part: Slice, repeated: np.ndarray, straight: np.ndarray, window: int, k: int):
        """Windows known to repeat, and windows to be counted, as indices of their first words.

        repeated / straight: per chosen k-mer, whether it occurs twice, and whether it does not branch.
        """
        if not len(self.windows):
            return self.windows, self.windows
        straight = straight & self.whole & repeated
        # a path reaches from the k-mer before its first straight node to the one after its last
        index = np.arange(len(self.at))
        first = np.maximum.accumulate(np.where(straight, -1, index))
        last = np.minimum.accumulate(np.where(straight, len(index), index)[::-1])[::-1]
        here = self.rank
        ok = straight[here]
        lo = self.at[np.clip(first[here], 0, None)]
        hi = self.at[np.clip(last[here], None, len(index) - 1)] + k
        inside = ok & (self.windows >= lo) & (self.windows + window <= hi)
        return self.windows[inside], self.windows[repeated[here] & ~inside]


def _nodes(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = _lanes()[0]
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for part in slices(batch.column(2)):
                g = Graph(part, lane, window, k)
                if not len(g.at):
                    continue
                doc = g.doc[g.at.astype(np.int64)]
                where = part.first + doc
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.hash.view(np.int64)),
                        pa.array(g.sides.view(np.int64), mask=~g.whole),
                        pa.array(a[where]), pa.array(b[where]),
                        pa.array((g.at - part.at[doc]).astype(np.int32)),
                    ],
                    names=["node", "sides", "_a", "_b", "pos"],
                )

    return run


def _flags(part: Slice, g: Graph, known, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Per chosen k-mer: repeated, straight; from the documents' lists of (position * 2 + straight)."""
    repeated = np.zeros(len(g.at), bool)
    straight = np.zeros(len(g.at), bool)
    offsets, flat = known
    lo, hi = offsets[first], offsets[first + part.n]
    if hi > lo and len(g.at):
        doc = np.repeat(np.arange(part.n), np.diff(offsets[first : first + part.n + 1]))
        code = flat[lo:hi]
        word = part.at[doc] + (code >> 1)
        place = np.searchsorted(g.at, word)
        repeated[place] = True
        straight[place[(code & 1) == 1]] = True
    return repeated, straight


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), flat.astype(np.int64)


def _border(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _lanes()
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            known = _lists(batch.column(3))
            for part in slices(batch.column(2)):
                g = Graph(part, one, window, k)
                _, count = g.settle(part, *_flags(part, g, known, part.first), window, k)
                if not len(count):
                    continue
                other = two.runs(two.of_words(part.data, part.starts, part.ends))
                doc = g.doc[count]
                where = part.first + doc
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.runs.hash(count, count + window).view(np.int64)),
                        pa.array(other.hash(count, count + window).view(np.int64)),
                        pa.array(a[where]), pa.array(b[where]),
                        pa.array((count - part.at[doc]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "_a", "_b", "pos"],
                )

    return run


def _cut(window: int, k: int, text_at: int, known_at: int, found_at: int):
    """Kept text, number of words and of removed words, put in front of the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = _lanes()[0]
        for batch in batches:
            known, found = _lists(batch.column(known_at)), _lists(batch.column(found_at))
            texts, words, removed = [], [], []
            for part in slices(batch.column(text_at)):
                cover = np.zeros(len(part.starts) + 1, np.int64)
                has_known = known[0][part.first + part.n] > known[0][part.first]
                if has_known:
                    g = Graph(part, lane, window, k)
                    settled, _ = g.settle(part, *_flags(part, g, known, part.first), window, k)
                    cover[settled] += 1
                    cover[settled + window] -= 1
                lo, hi = found[0][part.first], found[0][part.first + part.n]
                if hi > lo:
                    doc = np.repeat(np.arange(part.n), np.diff(found[0][part.first : part.first + part.n + 1]))
                    start = part.at[doc] + found[1][lo:hi]
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                gone = np.concatenate([[0], np.cumsum(~keep)])
                per_doc = gone[part.at[1:]] - gone[part.at[:-1]]
                for d in range(part.n):
                    texts.append(b" ".join(part.words_of(d, keep if per_doc[d] else None)))
                words += np.diff(part.at).tolist()
                removed += per_doc.tolist()
            rest = [c for i, c in enumerate(batch.columns) if i not in (text_at, known_at, found_at)]
            names = [n for i, n in enumerate(batch.schema.names) if i not in (text_at, known_at, found_at)]
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            nulls = batch.column(text_at).is_null()
            kept = pa.compute.if_else(nulls, pa.scalar(None, pa.string()), kept)
            yield pa.RecordBatch.from_arrays(
                [*rest, kept, pa.array(words, pa.int64()), pa.array(removed, pa.int64())],
                names=[*names, "kept_text", "n_words", "n_removed"],
            )

    return run


def repeated_spans(docs: DataFrame, text: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, windows): per document key, the repeated k-mers and the counted windows that repeat."""
    keyed = docs.select("_a", "_b", F.col(text).alias("_text"))
    nodes = keyed.mapInArrow(_nodes(window, k), "node long, sides long, _a long, _b long, pos int")
    kinds = nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.count("sides").alias("inner"), F.min("sides").alias("lo"), F.max("sides").alias("hi")
    )
    graph = kinds.where("n > 1").select("node", ((F.col("inner") == F.col("n")) & (F.col("lo") == F.col("hi"))).cast("int").alias("straight"))
    # both sides of the joins below are plain shuffles of tables, so Spark can split a hot k-mer or window
    graph = stored(graph, "graph")
    coded = nodes.join(graph, "node").select("_a", "_b", (F.col("pos") * 2 + F.col("straight")).alias("code"))
    known = stored(coded.groupBy("_a", "_b").agg(F.array_sort(F.collect_set("code")).alias("known")), "repeated-nodes")

    near = keyed.join(known, ["_a", "_b"]).select("_a", "_b", "_text", "known")
    border = near.mapInArrow(_border(window, k), "h1 long, h2 long, _a long, _b long, pos int")
    border = stored(border, "border-windows")
    twice = stored(border.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "repeated-windows")
    found = border.join(twice, ["h1", "h2"]).groupBy("_a", "_b").agg(F.array_sort(F.collect_set("pos")).alias("found"))
    return known, found


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """Remove every word that lies in a window of `window` words which also starts anywhere else.

    Adds kept_text (kept words joined by one space), n_words and n_removed; other columns stay, input
    columns of these names are replaced. Windows are judged on the input, in the same document too, and
    all occurrences go, the first one included. A null text has no words and stays null, an empty text
    stays empty, a text of fewer words than a window keeps all. Rows are told apart by key and text; rows
    equal in both count as occurrences of each other, so their windows go. Null keys are a key. A hot
    passage is summed map-side; joins back to its rows are plain equi-joins, which Spark splits when skewed.
    """
    rest = keep_others(df, ["kept_text", "n_words", "n_removed", "_a", "_b"])
    rest = [c for c in rest if c != text]
    keyed = df.withColumns({
        "_a": F.xxhash64(key, text), "_b": F.xxhash64(F.lit(1), text, key),
    })
    known, found = repeated_spans(keyed, text, window, k)
    joined = (
        keyed.select("_a", "_b", *rest, F.col(text).alias("_text"))
        .join(known, ["_a", "_b"], "left").join(found, ["_a", "_b"], "left")
        .select(*rest, F.col("_text"), "known", "found")
    )
    n = len(rest)
    fields = [joined.schema[c] for c in rest]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["kept_text string", "n_words long", "n_removed long"])
    return joined.mapInArrow(_cut(window, k, n, n + 1, n + 2), schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows of 35 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )
