"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.llm.common import table
from ledgerlift.session import stored

#: Cells of the smallest sketch, growth on failure, cells per digest, passes of peeling before a retry, and cells
#: per digest of two versions in the first try. Cells without a digest have no row, so a roomy sketch costs no more.
CELLS, GROWTH, HASHES, PASSES, ROOM = 24, 4, 3, 6, 4
#: Lines of more characters than this are cut: every line is.
LONG_LINE = 0
#: Words at a sentence's start that end no paragraph; of later ones one in RUN_WORDS does, told by its hash.
FIRST_WORDS, RUN_WORDS = 8, 8
#: Rows that are put in order together, and the most blocks (then blocks grow; their sort spills).
BLOCK_ROWS, MOST_BLOCKS = 4096, 4096
#: Digests of all versions that one task sketches and peels.
TASK_DIGESTS = 1 << 17
_ROW = ["_block", "_rn"]
_LOWEST = -(2**63)


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs that hold more than blanks.

    A line is cut behind its sentences, and these behind every word after the first FIRST_WORDS whose hash is a
    multiple of RUN_WORDS. No cut depends on what follows, nor on lengths, and one inside a longer run depends
    on its word alone, so equal starts have equal paragraphs, as have equal stretches of long runs.
    """
    ends = lambda w, i: (i >= FIRST_WORDS) & (F.pmod(F.xxhash64(w), F.lit(RUN_WORDS)) == 0)
    words = lambda s: F.array_join(F.transform(F.split(s, " "), lambda w, i: F.when(ends(w, i), F.concat(w, F.lit("\n"))).otherwise(w)), " ")
    cut = lambda s: F.split(F.replace(words(s), F.lit("\n "), F.lit("\n")), "\n")
    sentences = F.split(F.regexp_replace(text, r"(?<=[.!?]) ", "\n"), "\n")
    parts = F.filter(F.flatten(F.transform(sentences, cut)), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, digests, next_text, next_digests, _block, _rn: every row beside the next by descending key, the last beside the first.

    Rows are cut into blocks at quantiles of the key and sorted within; the first row of a block also goes
    to the end of the block above it (the very first to the end of the last), so no task sees more than its
    block. Null keys come last; equal keys are in order of their texts' hashes. Digests are worked out once for
    each row of a block, behind the shuffle, which carries texts only.
    """
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(_LOWEST))
    keys = df.select(k.alias("k"))
    n = keys.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
    cuts = []
    if blocks > 1:
        at = F.percentile_approx("k", [i / blocks for i in range(1, blocks)], 20 * blocks)
        cuts = sorted(set(keys.agg(at.alias("q")).first()["q"]))
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    block = lambda c: F.size(F.filter(bounds, lambda b: b <= c))
    tops = sorted((r["b"], r["top"]) for r in keys.groupBy(block(F.col("k")).alias("b")).agg(F.max("k").alias("top")).collect())
    # one row per block: the row to add, and where
    guests = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]
    guests = df.sparkSession.createDataFrame(guests, "_top long, _to int")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), k.alias("_k"))
    rows = rows.join(F.broadcast(guests), F.col("_k") == F.col("_top"), "left")
    here = F.struct(block(F.col("_k")).alias("_block"), F.lit(False).alias("guest"))
    there = F.struct(F.col("_to").alias("_block"), F.lit(True).alias("guest"))
    rows = rows.select(
        "key", "text", "_k", F.inline(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there)))
    )
    order = Window.partitionBy("_block").orderBy("guest", F.desc("_k"), F.xxhash64("text"), "text")
    rows = rows.repartition("_block").withColumn("digests", paragraphs(F.col("text")))
    after = {"next_text": F.lead("text").over(order), "next_digests": F.lead("digests").over(order), "_rn": F.row_number().over(order)}
    return rows.withColumns(after).where(~F.col("guest")).select("key", "text", "digests", *after, "_block")


def _check(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed + 1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _places(key: Column, cells: Column, seed: int) -> list[Column]:
    """A digest's cells: one in each third of the table."""
    third = (cells / HASHES).cast("bigint")
    return [
        (F.pmod(F.xxhash64(key, F.lit(seed + 11 * (h + 1))), third) + h * third).cast("int") for h in range(HASHES)
    ]


def sketch(rows: DataFrame, by: list[str], cells: Column, seed: int = 0, sign: Column | None = None) -> DataFrame:
    """Cells (by, cell, n, k, c) of the digests in column `digests`: count, xor of digests, xor of checks.

    `cells`, the size of a row's table, is made of columns in `by`. Cells without a digest have no row. Rows of
    `sign` -1 are taken away: the sketches of two versions, one less the other, in one aggregation.
    """
    sign = F.lit(1) if sign is None else sign
    one = rows.select(*by, sign.alias("sign"), F.explode("digests").alias("d"))
    entry = lambda place: F.struct(place.alias("cell"), F.col("sign").alias("n"), F.col("d").alias("k"), F.col("check").alias("c"))
    spread = one.withColumn("check", _check(F.col("d"), seed)).select(
        *by, F.inline(F.array(*[entry(p) for p in _places(F.col("d"), cells, seed)]))
    )
    return _sum(spread, [*by, "cell"])


def _sum(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells added up; those that come to nothing have no row."""
    added = cells.groupBy(*by).agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return added.where("cell < 0 or n != 0 or k != 0 or c != 0")


def peel(cells: DataFrame, by: list[str], size: Column, seed: int = 0, passes: int = PASSES) -> DataFrame:
    """(by, delta, failed) of subtracted sketches: the number of digests recovered, and whether cells remain.

    A cell that holds one digest (count of 1 or -1, a check that fits, and this the digest's place) gives it up; it is then
    taken out of its other cells, which may free more. A pass frees the cells of one third of the table, the
    thirds in turn: a digest has one cell in each, so none is found twice in a pass, and a pass is one
    aggregation over the cells that are left, within the partitions that `cells` has by `by`. Recovered digests are counted in cell -1.
    """
    now, third = cells, (size / HASHES).cast("bigint")
    for p in range(passes):
        t, key = p % HASHES, F.col("k")
        places = _places(key, size, seed)
        pure = (F.col("cell") >= t * third) & (F.col("cell") < (t + 1) * third) & (F.abs("n") == 1)
        pure = pure & (F.col("c") == _check(key, seed)) & (F.col("cell") == places[t])
        row = lambda cell, n, k, c: F.struct(cell.alias("cell"), n.alias("n"), k.alias("k"), c.alias("c"))
        none = F.lit(0).cast("bigint")
        taken = [row(F.lit(-1), F.lit(1), none, none)]
        taken += [row(place, -F.col("n"), key, F.col("c")) for h, place in enumerate(places) if h != t]
        itself = row(F.col("cell"), F.col("n"), key, F.col("c"))
        spread = now.select(*by, F.inline(F.when(pure, F.array(*taken)).otherwise(F.array(itself))))
        now = _sum(spread, [*by, "cell"])
    return now.groupBy(*by).agg(
        F.sum(F.when(F.col("cell") < 0, F.col("n")).otherwise(0)).alias("delta"), F.max(F.col("cell") >= 0).alias("failed")
    )


def _size(x: str, y: str, attempt: int) -> Column:
    """Cells for a pair: the first size with ROOM for its digests, GROWTH times larger with every attempt."""
    both = ROOM * (F.size(x) + F.size(y)).cast("double")
    steps = F.greatest(F.ceil(F.log(both / CELLS) / F.log(F.lit(float(GROWTH)))), F.lit(0))
    return (CELLS * F.pow(F.lit(float(GROWTH)), F.when(both > 0, steps).otherwise(0) + attempt)).cast("bigint")


def differences(versions: DataFrame) -> DataFrame:
    """(_block, _rn, pair, delta): how many paragraph digests tell two versions apart, for every row and pair.

    `versions` has _block, _rn and the digest arrays a, b and c; pair 1 is a against b, pair 2 a against c.
    Sketches are built per version, subtracted per pair and peeled; pairs that cannot be peeled are tried
    again with GROWTH times the cells and other hashes until none is left. Pairs without a difference
    have no row.
    """
    todo = versions.select(*_ROW, "a", "b", "c", F.lit(True).alias("one"), F.lit(True).alias("two"))
    # digests are few bytes and make many rows: tasks are cut by their number
    digests = versions.agg(F.sum(F.size("a") + F.size("b") + F.size("c"))).first()[0] or 0
    tasks = max(int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-digests // TASK_DIGESTS))
    done, attempt = [], 0
    by = [*_ROW, "pair", "size"]
    while True:
        seed = 1000 * attempt
        sides = [(1, "a", "b", "one"), (2, "a", "c", "two")]
        part = lambda pair, x, y, on, v: F.struct(
            F.lit(pair).alias("pair"), F.lit(1 if v == "a" else -1).alias("sign"), F.col(on).alias("on"),
            _size(x, y, attempt).alias("size"), F.col(v).alias("digests"),
        )
        placed = todo.repartition(tasks, *_ROW)
        each = placed.select(*_ROW, F.inline(F.array(*[part(*s, v) for s in sides for v in s[1:3]]))).where("on")
        less = sketch(each, by, F.col("size"), seed, F.col("sign"))
        got = stored(peel(less, by, F.col("size"), seed), "peeled")
        done.append(got.where("not failed").select(*_ROW, "pair", "delta"))
        again = got.where("failed")
        if again.isEmpty():
            return reduce(DataFrame.unionByName, done)
        again = again.groupBy(*_ROW).agg(F.max(F.col("pair") == 1).alias("one"), F.max(F.col("pair") == 2).alias("two"))
        todo = versions.select(*_ROW, "a", "b", "c").join(again, _ROW)
        attempt += 1


def written(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, fingerprint): the cells in use as text, each as number, count, digests and checks."""
    cell = F.concat_ws(
        ":", F.col("cell").cast("string"), F.col("n").cast("string"), F.lower(F.hex("k")), F.lower(F.hex("c"))
    )
    held = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cell", cell.alias("s")))).alias("cells"))
    return held.select(*by, F.array_join(F.transform("cells", lambda x: x["s"]), " ").alias("fingerprint"))


def likeness(x: Column, y: Column, delta: Column) -> Column:
    """Shared paragraphs over all paragraphs of two versions, from their sizes and difference; 1 if both are empty."""
    both = x + y
    return F.coalesce((both - delta) / F.nullif(both + delta, F.lit(0)), F.lit(1.0)).cast("double")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    A null text is empty; the fingerprint of a text without paragraphs is an empty
    sketch, `iblt24`. Equal texts have equal fingerprints; texts of the same distinct paragraphs do too.
    Repeated rows each have a row; an empty table gives none; other columns are not read.
    """
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    versions = docs.withColumn("edited", edited).select(
        F.col("key").alias("doc_id"), *_ROW, n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("digests").alias("a"), paragraphs(F.col("edited")).alias("b"), F.col("next_digests").alias("c"),
    )
    versions = stored(versions, "versions")
    delta = differences(versions).groupBy(*_ROW).agg(
        F.max(F.when(F.col("pair") == 1, F.col("delta"))).alias("one"), F.max(F.when(F.col("pair") == 2, F.col("delta"))).alias("two")
    )
    part = lambda v: F.struct(F.lit(v).alias("v"), F.col(v).alias("digests"))
    each = versions.select(*_ROW, "a", "b").repartition(*_ROW).select(*_ROW, F.inline(F.array(part("a"), part("b"))))
    marks = written(sketch(each, [*_ROW, "v"], F.lit(CELLS)), [*_ROW, "v"])
    marks = marks.groupBy(*_ROW).agg(
        F.max(F.when(F.col("v") == "a", F.col("fingerprint"))).alias("fa"), F.max(F.when(F.col("v") == "b", F.col("fingerprint"))).alias("fb")
    )
    name = lambda c: F.concat_ws(" ", F.lit(f"iblt{CELLS}"), F.col(c))
    sizes = [F.size(v).alias(f"n_{v}") for v in "abc"]
    base = versions.select(*_ROW, "doc_id", "n_chars", "edited_sha256", *sizes)
    size = lambda v: F.col(f"n_{v}")
    out = base.join(marks, _ROW, "left").join(delta, _ROW, "left")
    diff = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", name("fa").alias("fingerprint"), name("fb").alias("edited_fingerprint"),
        likeness(size("a"), size("b"), diff("one")).alias("near_edited"),
        likeness(size("a"), size("c"), diff("two")).alias("near_next"),
    )
