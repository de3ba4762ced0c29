"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep_others, table, word_count
from ledgerlift.operators.ordering import row_numbers, running_total
from ledgerlift.session import stored

#: A source's target, and with it a document's copies, stop at this multiple.
MOST = 3
_DIGITS = 13  # hexadecimal digits of the random number


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number above 0 and below 1 that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    whole = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / float(16**_DIGITS)


def _worth(worth: str | None) -> Column:
    if worth is None:
        return F.lit(1.0)
    value = F.col(worth).cast("double")
    return F.when((value > 0) & (value < float("inf")), value).otherwise(F.lit(0.0))


def targets(sources: DataFrame) -> DataFrame:
    """`sources` (source, source_size, weight) with `target`: shares of all sizes by weight.

    A target stops at MOST times its source's size and the excess is shared again by weight among the
    others, until none is above. Each round is one aggregate over the sources, which settles at least one.
    """
    sources = stored(sources, "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share = None
    while True:
        full = F.lit(False) if share is None else F.col("weight") * F.lit(share) > MOST * F.col("source_size")
        fixed, weight = sources.agg(
            F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0))
        ).first()
        now = (total - fixed) / weight if weight else 0.0
        if now == share:
            break
        share = now
    full = F.col("weight") * F.lit(share) > MOST * F.col("source_size")
    return sources.withColumn(
        "target", F.when(full, (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(share))
    )


def scales(drawn: DataFrame) -> DataFrame:
    """(source, scale): what a document's worth is multiplied by to be its chance of one more copy.

    `drawn` holds source, size, worth (above 0) and rest, the words its source still takes. A chance stops at 1: such
    documents are certain, their words are taken off, and the others' chances grow until no further one is certain. Each round is
    one aggregate per source. Where all of a source are certain, the scale is that of the last round.
    """
    drawn = stored(drawn, "drawn")
    scale, sure = drawn.select("source").distinct().withColumn("scale", F.lit(0.0)), -1
    while True:
        known = drawn.join(scale.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        full = F.col("worth") * F.col("scale") >= 1
        found = stored(known.groupBy("source").agg(
            F.max("rest").alias("rest"), F.max("scale").alias("before"), F.count(F.when(full, 1)).alias("sure"),
            F.sum(F.when(full, F.col("size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("worth"))).alias("open"),
        ), "scales")
        now = found.agg(F.sum("sure")).first()[0] or 0
        if now == sure:
            return scale
        grown = F.greatest((F.col("rest") - F.col("fixed")) / F.nullif(F.col("open"), F.lit(0.0)), F.col("before"))
        scale, sure = found.select("source", F.coalesce(grown, "before").alias("scale")), now


def mixture(
    df: DataFrame, weights=(1, 2, 3), key: str = "doc_id", text: str = "text", source: str = "source", worth: str | None = None
) -> DataFrame:
    """All rows of `df` with size (words), source_size, target (of the source, in words), taken and copies.

    Sources take `weights` in turn, by code point, null last, and share the words of all documents. A
    document is expected target / source_size times: the whole part is certain copies, the fraction is its
    chance of one more. Pareto order sampling draws these: documents are ranked by u / (1 - u) over the odds
    of their chance, u a hash of the key, and the first ones are taken until their words are nearest to what
    the certain copies leave open. So a source's words miss its target by half a document at most.

    Without `worth`, chances are equal within a source. With it, a column of numbers, the chance of one more copy is in
    proportion to a document's worth: those whose chance would be above 1 get the copy for certain, the others
    are drawn by their own odds. Null, negative and non-finite worths are 0 and get no copy beyond the whole ones; a source whose
    documents of worth hold fewer words than are open takes each once more and stays below its target.

    The ranks are summed over range blocks (key, rank), so a source that holds a third of all rows is
    spread; what is joined back to the documents is one row per source. Rows without text or words have size
    0 and take nothing. A null source is a source, null keys draw like an empty key, repeated rows are drawn
    apart where their keys or texts differ and otherwise stand or fall together. An empty table gives no
    rows; input columns with the names of the added ones are replaced.
    """
    names = ["size", "source_size", "target", "taken", "copies"]
    rest = keep_others(df, names)
    u = uniform(F.col(key))
    tied = df.select(
        *rest,
        word_count(F.col(text)).alias("size"),
        (u / (1 - u)).alias("_odds"),
        F.xxhash64(key, text).alias("_tie"),
        _worth(worth).alias("_worth"),
    )
    light = stored(tied.select(F.col(source).alias("source"), "size", "_odds", "_tie", "_worth"), "sizes")
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_numbers(sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "_no")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    goal = targets(ranked.select("source", "source_size", turn.alias("weight"))).select("source", "source_size", "target")
    expected = F.try_divide("target", "source_size")
    plan = goal.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(expected)).otherwise(0).cast("bigint").alias("_whole"),
    ).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    sourced = lambda plan: light.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    if worth is None:
        chance = F.try_divide("_rest", "source_size")
        odds = F.try_divide(F.col("_odds"), F.try_divide(chance, 1 - chance))
    else:
        open_ = sourced(plan).where("_rest > 0 and size > 0 and _worth > 0")
        scale = scales(open_.select("source", "size", F.col("_worth").alias("worth"), F.col("_rest").alias("rest")))
        plan = plan.join(scale.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        chance = F.coalesce(F.least(F.col("_worth") * F.col("scale"), F.lit(1.0)), F.lit(0.0))
        odds = F.when(chance > 0, F.col("_odds") * (1 - chance) / chance)  # the certain ones come first
    rank = F.struct(odds.alias("q"), F.col("_tie").alias("tie"))

    drawn = sourced(plan).where(F.expr("_rest > 0 and size > 0") & odds.isNotNull()).select(
        "source", "size", "_rest", odds.alias("_q"), "_tie"
    )
    summed = running_total(drawn, ["source"], ["_q", "_tie"], "size", "_upto")
    cut = summed.where(F.col("_upto") - F.col("size") / 2 < F.col("_rest")).groupBy("source").agg(
        F.max(F.struct(F.col("_q").alias("q"), F.col("_tie").alias("tie"))).alias("_cut")
    )
    plan = stored(
        plan.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mixture-plan"
    ).withColumnRenamed("source", "_source")
    more = (F.col("_rest") > 0) & (F.col("size") > 0) & odds.isNotNull() & F.coalesce(rank <= F.col("_cut"), F.lit(False))
    copies = F.col("_whole") + more.cast("bigint")
    return (
        tied.join(plan, F.col(source).eqNullSafe(F.col("_source")))
        .withColumn("copies", copies)
        .select(*rest, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """One row per copy; documents that take no copy go."""
    cols = [c for c in mixed.columns if c != "copies"]
    return mixed.where("copies > 0").select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = {
    "op8_mixing": r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source,
    CAST(CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(
      string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '')) END
      AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0)
      / 4503599627370496.0e0 AS u
  FROM documents),
src AS MATERIALIZED (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
tot AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total, sum(weight) AS weight FROM src),
step(n, share) AS (
  SELECT 0, total / weight FROM tot
  UNION ALL
  SELECT n + 1, (SELECT (max(total) - sum(CASE WHEN s.weight * st.share > 3 * source_size THEN 3 * source_size ELSE 0 END))
     / nullif(sum(CASE WHEN s.weight * st.share > 3 * source_size THEN 0 ELSE s.weight END), 0) FROM src s, tot)
  FROM step st WHERE n < 40),
last AS (SELECT arg_max(share, n) AS share FROM step),
goal AS MATERIALIZED (
  SELECT source, source_size, CASE WHEN weight * share > 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
    ELSE weight * share END AS target FROM src, last),
plan AS MATERIALIZED (
  SELECT *, target - whole * source_size AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goal)),
ranked AS MATERIALIZED (
  SELECT d.*, p.source_size, p.target, p.whole, p.rest,
    CASE WHEN p.rest > 0 AND d.size > 0 THEN (u / (1 - u)) / ((p.rest / p.source_size) / (1 - p.rest / p.source_size)) END AS q
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
summed AS (SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id
    ROWS UNBOUNDED PRECEDING) AS upto FROM ranked),
counted AS (SELECT *, whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0e0 < rest THEN 1 ELSE 0 END AS copies FROM summed)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM counted""",
}
