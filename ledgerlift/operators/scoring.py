"""Complexity scores, readiness and review lists over parsed programs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.corpus import texts, unnest

CAP = 8

# Procedure lists; each caller has its own.
ADVANCED_PROCS = ["IML", "GRAPH", "ETS", "REPORT", "TABULATE", "MIXED"]
STATISTICAL_PROCS = ["REG", "GLM", "LOGISTIC", "UNIVARIATE", "GENMOD", "PHREG", "LIFETEST", "NLIN", "MEANS", "FREQ"]
GAP_PROCS = ["LOGISTIC", "REG", "GLM", "MIXED", "IML", "REPORT", "TABULATE"]
REVIEW_PROCS_DISCOVERY = ["LOGISTIC", "REG", "GLM", "MIXED", "GENMOD", "PHREG", "LIFETEST", "NLIN", "IML", "REPORT", "TABULATE"]
REVIEW_PROCS_MIGRATION = ["LOGISTIC", "REG", "GLM", "MIXED", "GENMOD", "PHREG", "LIFETEST", "NLIN", "IML"]
FACTOR_PROCS = ["LOGISTIC", "REG", "GLM", "MIXED", "UNIVARIATE"]
COVERED_PROCS = ["SQL", "SORT", "FREQ", "MEANS", "FORMAT", "UNIVARIATE"]


def above(value: Column, *steps: tuple[int, int], otherwise: int = 0) -> Column:
    """Points of the first limit the value exceeds."""
    out = None
    for limit, points in steps:
        out = F.when(value > limit, points) if out is None else out.when(value > limit, points)
    return out.otherwise(otherwise)


def flag(cond: Column, points: int) -> Column:
    return F.when(cond, points).otherwise(0)


def n(name: str) -> Column:
    return F.size(F.col(name))


def _capped(*parts: Column) -> Column:
    return F.least(reduce(lambda a, b: a + b, parts), F.lit(CAP))


def plp() -> Column:
    """Programming logic."""
    macros = n("macro_definitions") + F.least(n("macro_variables"), F.lit(5))
    return _capped(
        above(macros, (5, 5), (0, 3), otherwise=1),
        flag(F.col("has_hash_objects"), 3),
        flag(F.col("has_dynamic_sql"), 2),
        above(F.col("if_then_chains"), (20, 3), (10, 2), (5, 1)),
        above(F.col("join_count"), (6, 2), (2, 1)),
        above(n("data_steps"), (10, 2), (5, 1)),
        above(F.col("line_count"), (1000, 2), (500, 1)),
    )


def pdi() -> Column:
    """Dependencies and integration."""
    return _capped(
        above(n("datasets_read"), (8, 4), (3, 2), otherwise=1),
        above(n("includes"), (3, 3), (0, 1)),
        above(n("libnames"), (3, 2), (0, 1)),
        above(n("unc_paths"), (0, 1)),
        above(n("proc_imports") + n("proc_exports"), (4, 2), (0, 1)),
        above(n("filenames"), (2, 1)),
        flag(F.col("has_dynamic_sql"), 1),
    )


def pvd() -> Column:
    """Volume and variety of data."""
    engines = F.size(F.array_distinct(F.col("proc_imports")["dbms"]))
    return _capped(
        above(n("merge_statements"), (3, 3), (0, 2), otherwise=1),
        flag(F.col("has_zip_processing"), 2),
        above(n("infile_statements"), (0, 1)),
        above(n("format_specs"), (10, 2), (5, 1)),
        above(engines, (2, 2), (1, 1)),
    )


def prs() -> Column:
    """Language-specific resources."""
    used = F.col("procs_used")
    kind = (
        F.when(F.arrays_overlap(used, texts(*ADVANCED_PROCS)), 5)
        .when(F.arrays_overlap(used, texts(*STATISTICAL_PROCS)), 3)
        .otherwise(1)
    )
    return _capped(
        kind,
        flag(F.col("has_hash_objects"), 2),
        above(n("named_literals"), (0, 1)),
        flag(F.array_contains(used, "FORMAT"), 1),
        above(n("procs_used"), (7, 2), (3, 1)),
    )


def dimension_level(score: Column) -> Column:
    return F.when(score <= 2, "Baixa").when(score <= 5, "Media").otherwise("Alta")


def _band(ct: Column, labels: list[str]) -> Column:
    return F.when(ct <= 8, labels[0]).when(ct <= 14, labels[1]).when(ct <= 20, labels[2]).otherwise(labels[3])


def complexity(parsed: DataFrame) -> DataFrame:
    """The four dimension scores, their total, levels and effort band."""
    scored = parsed.withColumns({"plp": plp(), "pdi": pdi(), "pvd": pvd(), "prs": prs()})
    ct = F.col("plp") + F.col("pdi") + F.col("pvd") + F.col("prs")
    return scored.withColumns({
        **{f"{d}_level": dimension_level(F.col(d)) for d in ("plp", "pdi", "pvd", "prs")},
        "ct": ct,
        "complexity_level": _band(ct, ["LOW", "MEDIUM", "HIGH", "VERY_HIGH"]),
        "effort": _band(ct, ["8-24 HH", "32-80 HH", "80-160 HH", ">160 HH"]),
    })


def _rows(df: DataFrame, keep: list[str], *candidates: tuple[Column, dict[str, Column]]) -> DataFrame:
    """One output row per program and candidate whose condition holds."""
    structs = [
        F.when(cond, F.struct(*[v.alias(k) for k, v in fields.items()])) for cond, fields in candidates
    ]
    return unnest(df, keep, F.array_compact(F.array(*structs)))


def manual_review(scored: DataFrame, stat_procs: list[str] = REVIEW_PROCS_DISCOVERY) -> DataFrame:
    """One row per program and reason it needs a person."""
    used = F.array_intersect("procs_used", texts(*stat_procs))
    reason = lambda sev, text, detail: {"severity": F.lit(sev), "reason": F.lit(text), "detail": detail}
    return _rows(
        scored, ["program_id", "filename"],
        (F.col("has_hash_objects"), reason("HIGH", "hash objects", F.lit(""))),
        (F.col("has_dynamic_sql"), reason("HIGH", "dynamic code", F.lit(""))),
        (F.size(used) > 0, reason("MEDIUM", "statistical procedures", F.array_join(used, ", "))),
        (F.col("complexity_level") == "VERY_HIGH", reason("MEDIUM", "very high complexity", F.col("ct").cast("string"))),
    )


def map_libraries(parsed: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per library of a program with its catalog and schema, or a warning.

    `mapping` has the columns library (lower case), catalog, schema.
    """
    libs = unnest(parsed, ["program_id"], F.col("libnames")).withColumn("library", F.lower("name"))
    return libs.join(mapping, "library", "left").select(
        "program_id", "name", "path_or_engine", "catalog", "schema",
        F.col("schema").isNotNull().alias("mapped"),
        F.when(F.col("schema").isNull(), F.concat(F.lit("No library mapping for "), F.col("name"))).alias("warning"),
    )


def _mapped_libraries(parsed: DataFrame, mapping: DataFrame) -> DataFrame:
    """`parsed` with _known, the number of its libraries that the mapping table has a target for."""
    libs = unnest(parsed, ["program_id"], F.transform("libnames", lambda l: F.struct(F.lower(l["name"]).alias("library"))))
    hits = libs.join(mapping.where("schema is not null").select("library").distinct(), "library", "left_semi")
    counts = hits.groupBy("program_id").agg(F.count(F.lit(1)).alias("_known"))
    return parsed.join(counts, "program_id", "left").fillna(0, ["_known"])


def pattern_coverage(parsed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Recognised and covered patterns per program and the covered share in percent.

    `mapping` is the table that map_libraries takes.
    """
    parsed = _mapped_libraries(parsed, mapping)
    known = F.col("_known")
    used = F.col("procs_used")
    covered_procs = F.size(F.array_intersect(used, texts(*COVERED_PROCS)))
    has_source = F.size("datasets_read") > 0
    merges = F.when(n("merge_statements") >= 2, 1).otherwise(0)
    total = (
        n("libnames") + n("data_steps") + merges + n("procs_used") + n("macro_definitions")
        + flag(F.col("has_hash_objects"), 1) + flag(F.col("has_dynamic_sql"), 1)
    )
    covered = known + F.when(has_source, n("data_steps")).otherwise(0) + merges + covered_procs + n("macro_definitions")
    return parsed.withColumns({
        "total_patterns": total,
        "covered_patterns": covered,
        "coverage_pct": F.when(total == 0, F.lit(100.0)).otherwise(F.bround(covered / total * 100, 1)),
    }).drop("_known")


def gap_report(parsed: DataFrame) -> DataFrame:
    """One row per program and gap that has no direct translation."""
    used = F.array_intersect("procs_used", texts(*GAP_PROCS))
    gaps = F.concat(
        F.transform(used, lambda p: F.concat(F.lit("PROC "), p)),
        F.when(F.col("has_hash_objects"), texts("hash objects")).otherwise(F.array().cast("array<string>")),
        F.when(F.col("has_dynamic_sql"), texts("dynamic code")).otherwise(F.array().cast("array<string>")),
    )
    return unnest(parsed, ["program_id", "filename"], F.transform(gaps, lambda g: F.struct(g.alias("gap"))))


def program_issues(parsed: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per program and issue: gaps, and warnings about libraries without a target."""
    gaps = gap_report(parsed).select("program_id", F.lit("GAP").alias("kind"), F.col("gap").alias("text"))
    warnings = map_libraries(parsed, mapping).where("warning is not null")
    return gaps.unionByName(warnings.select("program_id", F.lit("WARNING").alias("kind"), F.col("warning").alias("text")))


def converted_ratio(parsed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Programs without gaps, all programs, average coverage."""
    free = (
        ~F.arrays_overlap("procs_used", texts(*GAP_PROCS)) & ~F.col("has_hash_objects") & ~F.col("has_dynamic_sql")
    )
    return pattern_coverage(parsed, mapping).agg(
        F.sum(free.cast("bigint")).alias("converted"), F.count(F.lit(1)).alias("total_programs"),
        F.avg("coverage_pct").alias("avg_coverage"),
    )


def score_factors(parsed: DataFrame) -> DataFrame:
    """One row per contributing factor with its weight (the older weighting)."""
    fixed = lambda name, count, points: {"factor": F.lit(name), "n": count, "points": points}
    parts = [
        (n("data_steps") > 0, fixed("DATA steps", n("data_steps"), n("data_steps"))),
        (n("merge_statements") > 0, fixed("MERGE", n("merge_statements"), n("merge_statements") * 5)),
        (F.array_contains("procs_used", "SQL"), fixed("PROC SQL", F.lit(1), F.lit(3))),
        *[
            (F.array_contains("procs_used", p), fixed(f"PROC {p}", F.lit(1), F.lit(5))) for p in FACTOR_PROCS
        ],
        (n("macro_definitions") > 0, fixed("Macros", n("macro_definitions"), n("macro_definitions") * 2)),
        (F.col("has_hash_objects"), fixed("Hash objects", F.lit(1), F.lit(5))),
        (F.col("has_dynamic_sql"), fixed("Dynamic code", F.lit(1), F.lit(5))),
    ]
    return _rows(parsed, ["program_id", "filename"], *parts)


def feature_index(parsed: DataFrame) -> DataFrame:
    """Special features and the programs that use them, one row per pair."""
    tags = [
        (F.col("has_hash_objects"), "hash objects"),
        (F.col("has_dynamic_sql"), "dynamic code"),
        (n("merge_statements") > 0, "merge"),
    ]
    return _rows(parsed, ["filename"], *[(cond, {"feature": F.lit(name)}) for cond, name in tags]).select(
        "feature", "filename"
    )


def macro_inventory(parsed: DataFrame) -> DataFrame:
    return parsed.where(n("macro_definitions") > 0).select(
        "filename", F.array_join("macro_definitions", ", ").alias("macros")
    )


def proc_usage(parsed: DataFrame) -> DataFrame:
    """Programs per procedure, most used first."""
    used = unnest(parsed, [], F.transform("procs_used", lambda p: F.struct(p.alias("proc")))).groupBy("proc").agg(F.count(F.lit(1)).alias("programs"))
    return used.withColumn("translatable", F.when(F.col("proc").isin(GAP_PROCS), "GAP").otherwise("Sim")).orderBy(
        F.desc("programs"), "proc"
    )


def inventory_view(parsed: DataFrame) -> DataFrame:
    """The parsed row as the two-phase flow passes it on: three facts are lost between phases."""
    none = F.array().cast("array<string>")
    return parsed.withColumns({
        "libnames": F.array().cast("array<struct<name:string,path_or_engine:string>>"),
        "datasets_read": none,
        "merge_statements": none,
    })


def waves(scored: DataFrame) -> DataFrame:
    """Programs per migration wave: quick wins, core, advanced."""
    level = F.col("complexity_level")
    wave = F.when(level == "LOW", "Quick Wins").when(level == "VERY_HIGH", "Modelos Avancados").otherwise("Core ETL")
    return scored.groupBy(wave.alias("wave")).agg(F.count(F.lit(1)).alias("programs"))
