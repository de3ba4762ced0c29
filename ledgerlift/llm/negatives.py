"""Hard negatives: rows of other labels whose scores lie in a window below a positive's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.llm.common import table
from ledgerlift.session import stored

#: Anchors and rows that meet in one task at a time, anchors of it whose scores are worked out together, and groups that
#: labels are dealt into while positives are looked for.
BLOCK, STRIP, LABEL_GROUPS = 4096, 256, 64
LONGEST = 2**63 - 1


def vectors_of(df: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, v, asked): one row per id with a label and a whole vector of the commonest length, v as whole numbers."""
    number = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    good = F.coalesce(~bad, F.lit(False)) & F.col(key).isNotNull() & F.col(label).isNotNull()

    def whole(x: Column) -> Column:
        y = F.greatest(F.least(number(x) * scale, F.lit(1.7e308)), F.lit(-1.7e308))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole

    rows = df.where(good).select(
        F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.transform(vector, whole).alias("v"),
        F.coalesce("_asked", F.lit(False)).alias("asked"),
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))
    once = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"), F.max("asked").alias("asked"))
    return once.select("id", "row.label", "row.v", "asked")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond 64 bits they stop at the largest or smallest."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, -LONGEST, LONGEST).astype(np.int64)


def _met(left: DataFrame, right: DataFrame, group: Column, body: Callable, schema: str) -> DataFrame:
    """`body` over all pairs of blocks of `left` and `right` whose rows agree in `group`, a number below LABEL_GROUPS.

    A group is cut into blocks of about BLOCK rows on either side, so a label with a third of all rows is spread out.
    """
    sizes = []
    for side in (left, right):
        held = dict(side.groupBy(group.alias("g")).count().collect())  # at most LABEL_GROUPS rows
        sizes.append([max(1, -(-held.get(g, 0) // BLOCK)) for g in range(LABEL_GROUPS)])
    lefts, rights = (F.element_at(F.array(*map(F.lit, s)), F.col("g") + 1) for s in sizes)
    cell, right = ["g", "a", "b"], right.toDF(*right.columns)  # both sides may be read from one table
    x = left.withColumn("g", group).withColumn("a", F.pmod(F.xxhash64("id"), lefts).cast("int"))
    x = x.withColumn("b", F.explode(F.sequence(F.lit(0), rights - 1)))
    y = right.withColumn("g", group).withColumn("b", F.pmod(F.xxhash64("id"), rights).cast("int"))
    y = y.withColumn("a", F.explode(F.sequence(F.lit(0), lefts - 1)))
    return x.groupBy(*cell).cogroup(y.groupBy(*cell)).applyInPandas(body, schema)


def _strips(anchors: pd.DataFrame, rows: pd.DataFrame):
    """Anchor by anchor: its place, and its scores with all rows."""
    if not len(anchors) or not len(rows):
        return
    v = np.stack(rows["v"].to_numpy())
    for first in range(0, len(anchors), STRIP):
        scores = products(np.stack(anchors["v"].to_numpy()[first : first + STRIP]), v)
        for k in range(len(scores)):
            yield first + k, scores[k]


def _frame(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    cols = list(zip(*parts)) or [[np.zeros(0, np.int64)]] * len(names)
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, cols)})


def _first_of(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` highest scores, ties by smaller id."""
    near = np.arange(len(score))
    if len(score) > most:
        near = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    return near[np.lexsort((ids[near], -score[near]))[:most]]


def _positives(most: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        own, of = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        for k, score in _strips(anchors, rows):
            same = np.flatnonzero((labels == of[k]) & (ids != own[k]))
            best = same[_first_of(score[same], ids[same], most)]
            out.append((np.full(len(best), own[k]), ids[best], score[best]))
        return _frame(out, ["anchor_id", "positive_id", "score"])

    return run


def _slots(most: int):
    """The first `most` rows of other labels in each slot of an anchor.

    The positives' upper limits, falling, cut the scores into disjoint slots: slot i holds those that are
    at most the limit of positive i but above that of the next one.
    """

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        own, of, highs, low = (anchors[c].to_numpy() for c in ("id", "label", "highs", "lowest"))
        for k, score in _strips(anchors, rows):
            limits = np.asarray(highs[k], np.int64)
            # below the lowest window no row can be an answer
            other = np.flatnonzero((labels != of[k]) & (score <= limits[0]) & (score >= low[k]))
            slot = np.searchsorted(-limits, -score[other], side="right") - 1
            for i in np.unique(slot):
                inside = other[slot == i]
                best = inside[_first_of(score[inside], ids[inside], most)]
                out.append((np.full(len(best), own[k]), np.full(len(best), i), score[best], ids[best]))
        return _frame(out, ["anchor_id", "slot", "score", "negative_id"])

    return run


def _share(score: Column, percent: int) -> Column:
    """percent * score / 100, exact for every 64-bit score."""
    return score.cast("decimal(20,0)") * percent / 100


def mine(
    df: DataFrame, anchors: Column, positives: int = 5, most: int = 3, low: int = 50, high: int = 95,
    scale: int = 256, key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor's positives.

    Components become floor(scale * x), scores are inner products in whole numbers; higher ones come first, ties by smaller id. An
    anchor's positives are its first `positives` other rows of its label. For each of them, the first `most` rows of
    other labels are returned whose score is from `low` to `high` percent of the positive's (none if that is negative).

    The windows of an anchor overlap, so they are not searched one by one. The positives' upper limits cut its
    scores into disjoint slots; every block of rows yields the first `most` of each slot (a combiner), the blocks'
    yields are merged slot by slot, and a fold from the lowest slot up merges each with the best below it: what
    it then holds are the first rows under that positive's limit, and lower limits only end such a list early.

    Anchors meet rows in blocks of BLOCK by BLOCK, positives within groups of labels only, so no task takes more than two
    blocks and a label with a third of all rows is spread like any other. Before each merge an anchor has at
    most (positives * most) rows per block of rows.

    Rows without id, label or vector, with a null or non-finite component or with another length than the commonest
    take no part. Rows that repeat an id are one, that of the smallest label and vector. Anchors without positives and
    positives without negatives have no rows; an empty table has none. Scores beyond 64 bits stop at
    the largest or smallest. Other columns are not read.
    """
    vectors = stored(vectors_of(df.withColumn("_asked", anchors), key, label, vector, scale), "vectors")
    asked = vectors.where("asked")
    group = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")
    found = _met(asked, vectors, group, _positives(positives), "anchor_id long, positive_id long, score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    limits = found.select(
        "anchor_id",
        F.struct(
            "place", "positive_id", "score",
            F.ceil(_share(F.col("score"), low)).cast("bigint").alias("low"),
            F.floor(_share(F.col("score"), high)).cast("bigint").alias("high"),
        ).alias("p"),
    )
    limits = stored(limits.groupBy("anchor_id").agg(F.sort_array(F.collect_list("p")).alias("positives")), "positives")

    limited = asked.join(limits, asked["id"] == limits["anchor_id"]).select(
        "id", "label", "v", F.col("positives.high").alias("highs"), F.array_min("positives.low").alias("lowest")
    )
    found = _met(limited, vectors, F.lit(0), _slots(most), "anchor_id long, slot int, score long, negative_id long")
    first = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "negative_id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    row = F.struct("slot", F.negative("score").alias("down"), "negative_id")
    slots = found.groupBy("anchor_id").agg(F.collect_list(row).alias("slots"))

    def merge(state: Column, i: Column) -> Column:
        own = F.transform(F.filter("slots", lambda r: r["slot"] == i), lambda r: F.struct(r["down"], r["negative_id"]))
        top = F.slice(F.array_sort(F.concat(state["top"], own)), 1, most)
        p = F.element_at("positives", i + 1)
        inside = F.filter(top, lambda t: F.negative(t["down"]) >= p["low"])
        rows = F.transform(inside, lambda t, k: F.struct(
            p["positive_id"].alias("positive_id"), (k + 1).alias("rank"), t["negative_id"].alias("negative_id"),
            p["score"].alias("positive_score"), F.negative(t["down"]).alias("negative_score"),
        ))
        return F.struct(top.alias("top"), F.concat(state["rows"], rows).alias("rows"))

    start = F.struct(
        F.array().cast("array<struct<down:bigint,negative_id:bigint>>").alias("top"),
        F.array().cast(
            "array<struct<positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>>"
        ).alias("rows"),
    )
    upwards = F.sequence(F.size("positives") - 1, F.lit(0), F.lit(-1))
    answers = slots.join(limits, "anchor_id").select("anchor_id", F.aggregate(upwards, start, merge)["rows"].alias("rows"))
    return answers.select("anchor_id", F.inline("rows")).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, after some labels are moved."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLE = {
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
