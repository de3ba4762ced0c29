"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.llm.common import table
from ledgerlift.session import stored

#: Rows the codebooks are fitted on (drawn by a hash of the id), centroids of each half, and the share of all
#: entries after which a query stops opening cells. Vectors without any structure need the share that high:
#: tests measure a recall of at least 0.9 against brute force.
SAMPLE_ROWS, CENTROIDS, SHARE = 20_000, 64, 0.45
#: Entries and queries that meet in one task at a time.
BLOCK = 2048


def usable(vector: Column) -> Column:
    """True for a vector of finite numbers that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def entries_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, u): one row per id with a usable vector of the commonest length, v as doubles, u of norm 1."""
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("_norm", norm).select("id", "v", F.transform("v", lambda x: x / F.col("_norm")).alias("u"))


def means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centroids of different points, by Lloyd's rounds from evenly spread distinct ones."""
    points = np.unique(points, axis=0)
    book = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(rounds):
        near = _distances(points, book).argmin(1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, points)
        held = np.bincount(near, minlength=len(book))
        book = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], book)
    return book


def codebooks(entries: DataFrame, n: int, half: int, centroids: int) -> list[np.ndarray]:
    """Centroids of the first and second halves, from a sample of at most about SAMPLE_ROWS vectors."""
    chance = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = entries.where(F.pmod(F.xxhash64(F.lit("codebook"), "id"), F.lit(1 << 30)) <= int(chance * (1 << 30)))
    u = np.array([r["u"] for r in sample.orderBy("id").select("u").collect()])
    return [means(x, centroids) for x in (u[:, :half], u[:, half:])]


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * x @ book.T


def _cells(books: list[np.ndarray], half: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                u = np.stack(rows["u"].to_numpy())
                i, j = (_distances(x, b).argmin(1) for x, b in zip((u[:, :half], u[:, half:]), books))
                yield pd.DataFrame({"id": rows["id"], "v": rows["v"], "i": i.astype(np.int32), "j": j.astype(np.int32)})

    return run


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: float) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by the sum of their distances, until the cells opened hold `enough` entries.

    The heap holds one pair per row of the sorted grid that has been reached (the multi-sequence walk).
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    held = 0
    while heap and held < enough:
        _, r, c = heapq.heappop(heap)
        if c == 0 and r + 1 < len(x):
            heapq.heappush(heap, (x[r + 1] + y[0], r + 1, 0))
        if c + 1 < len(y):
            heapq.heappush(heap, (x[r] + y[c + 1], r, c + 1))
        i, j = int(a[r]), int(b[c])
        if sizes[i, j]:
            held += int(sizes[i, j])
            yield i, j


def _probes(books: list[np.ndarray], half: int, sizes: np.ndarray, enough: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            u = np.stack(rows["u"].to_numpy())
            first, second = (_distances(x, b) for x, b in zip((u[:, :half], u[:, half:]), books))
            out = []
            for n, (id_, v) in enumerate(zip(rows["id"], rows["v"])):
                opened: dict[int, list[int]] = {}
                for i, j in traverse(first[n], second[n], sizes, enough):
                    opened.setdefault(i, []).append(j)
                out += [(id_, v, i, js) for i, js in opened.items()]
            yield pd.DataFrame(out, columns=["query_id", "q", "i", "js"])

    return run


def _rerank(most: int, centroids: int):
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(queries) or not len(entries):
            return empty
        q, v = np.stack(queries["q"].to_numpy()), np.stack(entries["v"].to_numpy())
        qn, vn = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", v, v))
        ids, of, j = queries["query_id"].to_numpy(), entries["id"].to_numpy(), entries["j"].to_numpy()
        opened = np.zeros((len(q), centroids), bool)
        for n, js in enumerate(queries["js"]):
            opened[n, js] = True
        score = (q @ v.T) / (qn[:, None] * vn[None])
        score[~opened[:, j] | (ids[:, None] == of[None])] = -np.inf
        # all that could be among the nearest, ties included; their scores are then worked out pair by pair
        top = min(most, score.shape[1])
        least = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]
        a, b = np.nonzero((score >= least[:, None] - 1e-9) & (score > -np.inf))
        exact = np.einsum("ij,ij->i", q[a], v[b]) / (qn[a] * vn[b])
        order = np.lexsort((of[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < most
        return pd.DataFrame({"query_id": ids[a[keep]], "vec_id": of[b[keep]], "score": exact[keep]})

    return run


def nearest(
    df: DataFrame, queries: Column, most: int = 5, key: str = "vec_id", vector: str = "embedding",
    centroids: int = CENTROIDS, share: float = SHARE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest entries found for every row that `queries` names.

    Every usable vector is an entry of the cell of its two halves' nearest centroids. A query walks the
    pairs of centroids by summed distance until the cells opened hold `share` of all entries, and all entries of
    those cells are reranked by the cosine of the original vectors in double precision, ties to the smaller
    id. Cells are met by their first centroid, cut into blocks of entries and of queries, so neither a cell
    with a third of all rows nor a crowd of queries lands in one task. The table of cell sizes is bounded by
    the square of `centroids`.

    Null ids take no part; neither do vectors that are null, empty, zero or hold null or non-finite
    numbers, nor those of another length than the commonest. Rows that repeat an id count once, by the
    smallest vector. Fewer than `most` other entries are all returned; an empty table gives no rows.
    """
    entries = stored(entries_of(df, key, vector), "entries")
    n = entries.count()
    asked = entries.join(df.where(queries).select(F.col(key).cast("bigint").alias("id")).distinct(), "id", "left_semi")
    half = 0
    if n:
        half = max(1, len(entries.first()["u"]) // 2)
    books = codebooks(entries, n, half, centroids) if n else [np.zeros((1, 1))] * 2
    cells = stored(entries.mapInPandas(_cells(books, half), "id long, v array<double>, i int, j int"), "cells")
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    for row in cells.groupBy("i", "j").count().collect():
        sizes[row["i"], row["j"]] = row["count"]
    enough = max(share * n, 10 * most + 1)
    # walking is far dearer than its rows are large: deal the queries out whatever their bytes
    dealt = asked.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    probes = dealt.mapInPandas(_probes(books, half, sizes, enough), "query_id long, q array<double>, i int, js array<int>")

    # entry blocks by row of the grid: a table of `centroids` numbers
    blocks = [max(1, math.ceil(int(s) / BLOCK)) for s in sizes.sum(axis=1)]
    groups = max(1, math.ceil(asked.count() / BLOCK))
    of = F.element_at(F.array(*map(F.lit, blocks)), F.col("i") + 1)
    left = probes.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    left = left.withColumn("e", F.explode(F.sequence(F.lit(0), of - 1)))
    right = cells.withColumn("e", F.pmod(F.xxhash64("id"), of).cast("int"))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = left.groupBy("i", "e", "g").cogroup(right.groupBy("i", "e", "g")).applyInPandas(
        _rerank(most, len(books[1])), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(
        "query_id", "rank", "vec_id", "score"
    )


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
