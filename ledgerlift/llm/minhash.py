"""Near-duplicate documents by min-max hashing, bands and links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import table
from ledgerlift.llm.graph import components
from ledgerlift.llm.words import Lane, Slice, mix, slices
from ledgerlift.session import small_batches, stored

SHINGLE = 5
#: 64 hash functions give a minimum and a maximum each: 128 values in 32 bands of 4. A pair at 0.75 shares
#: no band with a chance of (1 - 0.75**4)**32, five in a million.
FUNCTIONS, BANDS, ROWS = 64, 32, 4
SIMILAR = (75, 100)
#: Pairs whose signatures agree in less than this share are not read in full; at a similarity of 0.75 that is
#: over five standard deviations away.
LIKELY = 0.55
#: Rows of a block whose signatures are held, and rows that stream by them in one task.
HELD, STREAMED = 512, 65536
#: Rows whose texts and sets are in a worker's hands at once.
AT_ONCE = 1024
_U = np.uint64
_XOR = mix(np.arange(1, FUNCTIONS + 1, dtype=_U) * _U(77))
_ODD = mix(np.arange(1, FUNCTIONS + 1, dtype=_U) * _U(191)) | _U(1)


def shingle_sets(part: Slice, lane: Lane, size: int) -> list[np.ndarray]:
    """The distinct shingles of each document, as sorted 64-bit hashes; a shorter document is one shingle."""
    runs = lane.runs(lane.of_words(part.data, part.starts, part.ends))
    n = len(part.starts)
    all_runs = runs.hash(np.arange(max(n - size + 1, 0)), np.arange(size, n + 1)) if n >= size else np.zeros(0, _U)
    sets = []
    for lo, hi in zip(part.at[:-1], part.at[1:]):
        if hi - lo >= size:
            sets.append(np.unique(all_runs[lo : hi - size + 1]))
        elif hi > lo:
            sets.append(runs.hash(np.array([lo]), np.array([hi])))
        else:
            sets.append(np.zeros(0, _U))
    return sets


def min_max(sets: list[np.ndarray], most: int = 1 << 16) -> np.ndarray:
    """Signatures: a row of minimum, maximum, minimum, ... per set; sets must not be empty."""
    out = np.empty((len(sets), 2 * FUNCTIONS), np.uint32)
    sizes = np.array([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), most, "right")))
        flat = np.concatenate(sets[first:last])
        starts = np.concatenate([[0], np.cumsum(sizes[first:last])[:-1]])
        for j in range(FUNCTIONS):
            value = (((flat ^ _XOR[j]) * _ODD[j]) >> _U(32)).astype(np.uint32)
            out[first:last, 2 * j] = np.minimum.reduceat(value, starts)
            out[first:last, 2 * j + 1] = np.maximum.reduceat(value, starts)
        first = last
    return out


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = Lane(6, fold_case=True)
        for batch in batches:
            for part in slices(batch.column(1)):
                sets = shingle_sets(part, lane, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                signs = min_max([sets[i] for i in full]) if full else np.zeros((0, 2 * FUNCTIONS), np.uint32)
                sig: list = [None] * part.n
                for i, row in zip(full, signs):
                    sig[i] = row.tobytes()
                digest = [
                    pa.array(np.array([mix(s ^ c).sum(dtype=_U) for s in sets], _U).view(np.int64))
                    for c in (_U(0x51ED270B), _U(0xA24BAED4))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.n), pa.array([len(s) for s in sets], pa.int64()), *digest, pa.array(sig, pa.binary())],
                    names=["id", "n", "d1", "d2", "sig"],
                )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of AT_ONCE rows, so what a worker makes of one does not depend on Spark's batches."""
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(first, AT_ONCE)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wide = 2 * FUNCTIONS
    for batch in _pieces(batches):
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, wide) for i in (2, 3))
        near = (x == y).mean(axis=1) >= LIKELY
        yield pa.RecordBatch.from_arrays(
            [batch.column(i).filter(pa.array(near)) for i in (0, 1)], names=["a", "b"]
        )


def _confirm(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = Lane(6, fold_case=True)
        sets = lambda text: [s for part in slices(text) for s in shingle_sets(part, lane, size)]
        for batch in _pieces(batches):
            left = batch.column(2).dictionary_encode()
            known, code = sets(left.dictionary), left.indices.to_numpy(zero_copy_only=False)
            other = sets(batch.column(3))
            linked = np.zeros(batch.num_rows, bool)
            for i, c in enumerate(code):
                linked[i] = _similar(known[c], other[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(linked)) for i in (0, 1)], names=["a", "b"]
            )

    return run


def _agreeing(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of their values two groups of signatures share, pair by pair."""
    same = np.zeros((len(sig), len(others)), np.uint8)
    for j in range(2 * FUNCTIONS):
        same += sig[:, j, None] == others[None, :, j]
    return same


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


class _Block:
    """The held members of a block: ids, components, signatures, texts, and the sets of those that were needed."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.sets: dict[int, np.ndarray] = {}

    def columns(self) -> list[np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(c) for c in zip(*self.parts))]
        return list(self.parts[0])


def _across(size: int):
    """Links across components, from rows sorted by block: a block's first rows are held, the rest stream by."""
    wide = 2 * FUNCTIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = Lane(6, fold_case=True)
        sets_of = lambda texts: [s for part in slices(pa.array(texts, pa.string())) for s in shingle_sets(part, lane, size)]

        def missing(known: dict[int, np.ndarray], at: np.ndarray, texts: np.ndarray) -> None:
            new = [int(i) for i in np.unique(at) if int(i) not in known]
            known.update(zip(new, sets_of(texts[new])))

        block, key = _Block(), None
        for batch in _pieces(batches):
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            first, ids, roots, out = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
            sig = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint32).reshape(-1, wide)
            texts = batch.column(8).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1) | (first[1:] != first[:-1])) + 1
            linked = []
            for lo, hi in zip([0, *change], [*change, len(ids)]):
                if key is None or (keys[lo] != key).any():
                    block, key = _Block(), keys[lo]
                here = (ids[lo:hi], roots[lo:hi], sig[lo:hi], texts[lo:hi])
                if first[lo] == 0:
                    block.parts.append(here)
                    continue
                if not block.parts:
                    continue
                a, ra, sa, ta = block.columns()
                near = _agreeing(sa, here[2]) >= LIKELY * wide
                near &= ra[:, None] != here[1][None]
                near &= ~out[None, lo:hi] | (a[:, None] < here[0][None])
                x, y = np.nonzero(near)
                if len(x):
                    mine: dict[int, np.ndarray] = {}
                    missing(block.sets, x, ta)
                    missing(mine, y, here[3])
                    linked += [(a[i], here[0][j]) for i, j in zip(x, y) if _similar(block.sets[int(i)], mine[int(j)])]
            if linked:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[i] for p in linked], pa.int64()) for i in (0, 1)], names=["a", "b"]
                )

    return run


def _open_links(hits: DataFrame, roots: DataFrame, sketches: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links (a, b) between components that meet in a bucket, for all buckets that hold several.

    Buckets are put together by their largest component, so a document that meets it in many bands moves once. Members
    outside that component are held against all members, in blocks of HELD by STREAMED: by signature first,
    and where that says likely by the sets of the whole texts. Only links become rows.
    """
    placed = hits.where("size > 2").join(roots, hits["id"] == roots["node"], "left").select(
        "band", "id", F.coalesce("root", "id").alias("root")
    )
    by_root = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    split = by_root.groupBy("band").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")
    ).where("roots > 1")
    met = stored(placed.join(split.select("band", "main"), "band").select("main", "id", "root").distinct(), "open-buckets")
    met = met.withColumn("out", F.col("root") != F.col("main"))
    chunks = lambda n, most: F.ceil(F.count(n) / F.lit(most)).cast("int")
    sizes = met.groupBy("main").agg(chunks(F.when(F.col("out"), 1), HELD).alias("xs"), chunks(F.lit(1), STREAMED).alias("ys"))
    rows = met.join(sizes, "main").join(sketches.select("id", "sig"), "id").join(texts, "id")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("bigint")
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    # a row streams by every held block of its own part, and is held for every part if it is outside
    held = F.transform(every("ys"), lambda y: F.struct(part("xs").alias("x"), y.alias("y"), F.lit(0).alias("first")))
    streams = F.transform(every("xs"), lambda x: F.struct(x.alias("x"), part("ys").alias("y"), F.lit(1).alias("first")))
    places = F.when(F.col("out"), F.concat(held, streams)).otherwise(streams)
    blocks = rows.select("main", F.inline(places), "id", "root", "out", "sig", "text").repartition("main", "x", "y")
    found = blocks.sortWithinPartitions("main", "x", "y", "first").mapInArrow(_across(size), "a long, b long")
    return stored(found.distinct(), "links")


def _by_signature(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    of = lambda name: sketches.select(F.col("id").alias(name), F.col("sig").alias(f"sig_{name}"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b")
    return pairs.mapInArrow(_likely, "a long, b long").distinct()


def _links(likely: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) that are similar by the sets of their whole texts.

    b's text moves once a pair; a hub's text stands still beside its pairs, which Spark splits when many.
    """
    likely = stored(likely, "likely-pairs")
    said = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
    whole = likely.join(said("b"), "b").join(said("a"), "a").select("a", "b", "text_a", "text_b")
    return stored(whole.mapInArrow(_confirm(size), "a long, b long").distinct(), "links")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per row of `df`: key, n_shingles, component_id, kept.

    Documents of equal sets are one class, named by its smallest key; only classes are compared. Classes that
    share a band are candidates. In a band's bucket every member is held against the bucket's hub, the member
    with the most band neighbours (the original among its copies), which gives as many pairs as members. Where
    a bucket still falls into several components afterwards, all pairs across components are held against each other, block by
    block, so no link is lost, and buckets that are one component make no further pairs.

    A null, empty or wordless text has no shingles and is linked with nothing; a row with a null key is
    linked with nothing, has no component and is kept. Rows that share a key are one document. Keys are
    integers. An empty table gives no rows. Other columns are not read.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    sketches = stored(docs.mapInArrow(_sketch(size), "id long, n long, d1 long, d2 long, sig binary"), "sketches")
    named = sketches.where("n > 0 and id is not null")
    classes = stored(named.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "classes")
    heads = named.select("id", "sig").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    band = F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    ))
    bands = heads.select("id", band.alias("band"))
    crowded = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    hits = stored(bands.join(crowded, "band").distinct(), "band-hits")

    degree = hits.groupBy("id").agg(F.sum("size").alias("degree"))
    hubs = hits.join(degree, "id").groupBy("band").agg(
        (-F.max(F.struct("degree", (-F.col("id")).alias("id")))["id"]).alias("a")
    )
    spokes = hits.join(hubs, "band").where("id != a").select("a", F.col("id").alias("b")).distinct()
    shared = hits.select("id").distinct()
    texts = stored(docs.join(shared, "id", "left_semi"), "candidate-texts")
    links = _links(_by_signature(spokes, sketches), texts, size)

    roots = components(links)
    links = links.unionByName(_open_links(hits, roots, sketches, texts, size))
    roots = components(links)

    member = sketches.select("id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    return (
        member.join(roots, member["rep"] == roots["node"], "left")
        .select(
            F.col("id").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
