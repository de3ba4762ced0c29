"""Complexity scores and readiness lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.checks.common import rounded
from ledgerlift.checks.corpus import LINES, MERGE_LIST, READS, STEPS_LIST, ex, pat, srt, upper_all
from ledgerlift.operators import corpus as C
from ledgerlift.operators import scoring as S
from ledgerlift.plans.views import view, with_views

def _parsed(s, d):
    return C.parse_programs(view(s, d, "programs"))


def _scored(s, d):
    return S.complexity(_parsed(s, d))


def _mapping(s, d):
    """Library targets from the corpus itself: every library but dw is mapped."""
    libs = _parsed(s, d).select(F.inline("libnames")).select(F.lower("name").alias("library")).distinct()
    return libs.where("library <> 'dw'").select("library", F.lit("sas_migration").alias("catalog"), F.concat(F.lit("bronze_"), "library").alias("schema"))


def _score(col):
    return lambda s, d: _scored(s, d).select("program_id", col, f"{col}_level")


QUERIES = {
    "score_plp": _score("plp"),
    "score_pdi": _score("pdi"),
    "score_pvd": _score("pvd"),
    "score_prs": _score("prs"),
    "complexity": lambda s, d: _scored(s, d).select("program_id", "ct", "complexity_level", "effort"),
    "manual_review": lambda s, d: S.manual_review(_scored(s, d)),
    "manual_review_migration": lambda s, d: S.manual_review(_scored(s, d), S.REVIEW_PROCS_MIGRATION),
    "map_libraries": lambda s, d: S.map_libraries(_parsed(s, d), _mapping(s, d)),
    "pattern_coverage": lambda s, d: S.pattern_coverage(_parsed(s, d), _mapping(s, d)).select(
        "program_id", "total_patterns", "covered_patterns", "coverage_pct"),
    "inventory_view_coverage": lambda s, d: S.pattern_coverage(S.inventory_view(_parsed(s, d)), _mapping(s, d)).select(
        "program_id", "total_patterns", "covered_patterns"),
    "gap_report": lambda s, d: S.gap_report(_parsed(s, d)),
    "program_issues": lambda s, d: S.program_issues(_parsed(s, d), _mapping(s, d)),
    "gap_list": lambda s, d: S.gap_report(_parsed(s, d)).select("gap").distinct(),
    "converted_ratio": lambda s, d: rounded(S.converted_ratio(_parsed(s, d), _mapping(s, d)), 4, "avg_coverage"),
    "score_factors": lambda s, d: S.score_factors(_parsed(s, d)),
    "feature_index": lambda s, d: S.feature_index(_parsed(s, d)),
    "macro_inventory": lambda s, d: S.macro_inventory(_parsed(s, d)),
    "proc_usage": lambda s, d: S.proc_usage(_parsed(s, d)),
    "complexity_distribution": lambda s, d: _scored(s, d).groupBy("complexity_level").agg(F.count(F.lit(1)).alias("n")),
    "waves": lambda s, d: S.waves(_scored(s, d)),
}

PARSED = f"""f AS (SELECT program_id, filename, content, {LINES} AS lines, len({ex('macro_def')}) AS macros, {ex('macro_def')} AS macro_list,
  len({ex('let')}) AS lets, regexp_matches(content, {pat('hash')}) AS hash, regexp_matches(content, {pat('dynamic')}) AS dyn,
  len({ex('if_then', 0)}) AS ifs, len({ex('left_join', 0)}) + len({ex('inner_join', 0)}) AS joins, len({STEPS_LIST}) AS steps,
  len({READS()}) AS reads, len({ex('include')}) AS incs, len({ex('libname')}) AS libs, {upper_all(ex('libname'))} AS lib_list,
  len({srt(ex('unc_path', 0))}) AS uncs, len({ex('proc_import', 3)}) + len({ex('proc_export', 3)}) AS io,
  len({srt(upper_all(ex('proc_import', 3)))}) AS engines, len({ex('filename')}) AS files, len({MERGE_LIST}) AS merges,
  regexp_matches(content, {pat('filename_zip')}) AS zip, len({ex('infile')}) AS infiles, len({srt(upper_all(ex('format_spec', 0)))}) AS fmts,
  len({srt(ex('named_literal', 0))}) AS lits, {srt(upper_all(ex('proc')))} AS procs FROM programs)"""
LEVEL = lambda c: f"CASE WHEN {c} <= 2 THEN 'Baixa' WHEN {c} <= 5 THEN 'Media' ELSE 'Alta' END AS {c}_level"
SCORED = PARSED + """,
dims AS (SELECT *,
  least(8, CASE WHEN macros + least(lets, 5) = 0 THEN 1 WHEN macros + least(lets, 5) <= 5 THEN 3 ELSE 5 END + 3 * hash::INT + 2 * dyn::INT
    + CASE WHEN ifs > 20 THEN 3 WHEN ifs > 10 THEN 2 WHEN ifs > 5 THEN 1 ELSE 0 END + CASE WHEN joins > 6 THEN 2 WHEN joins > 2 THEN 1 ELSE 0 END
    + CASE WHEN steps > 10 THEN 2 WHEN steps > 5 THEN 1 ELSE 0 END + CASE WHEN lines > 1000 THEN 2 WHEN lines > 500 THEN 1 ELSE 0 END) AS plp,
  least(8, CASE WHEN reads > 8 THEN 4 WHEN reads > 3 THEN 2 ELSE 1 END + CASE WHEN incs > 3 THEN 3 WHEN incs > 0 THEN 1 ELSE 0 END
    + CASE WHEN libs > 3 THEN 2 WHEN libs > 0 THEN 1 ELSE 0 END + (uncs > 0)::INT + CASE WHEN io > 4 THEN 2 WHEN io > 0 THEN 1 ELSE 0 END
    + (files > 2)::INT + dyn::INT) AS pdi,
  least(8, CASE WHEN merges > 3 THEN 3 WHEN merges > 0 THEN 2 ELSE 1 END + 2 * zip::INT + (infiles > 0)::INT
    + CASE WHEN fmts > 10 THEN 2 WHEN fmts > 5 THEN 1 ELSE 0 END + CASE WHEN engines > 2 THEN 2 WHEN engines > 1 THEN 1 ELSE 0 END) AS pvd,
  least(8, CASE WHEN list_has_any(procs, ['IML', 'GRAPH', 'ETS', 'REPORT', 'TABULATE', 'MIXED']) THEN 5
    WHEN list_has_any(procs, ['REG', 'GLM', 'LOGISTIC', 'UNIVARIATE', 'GENMOD', 'PHREG', 'LIFETEST', 'NLIN', 'MEANS', 'FREQ']) THEN 3 ELSE 1 END
    + 2 * hash::INT + (lits > 0)::INT + list_contains(procs, 'FORMAT')::INT + CASE WHEN len(procs) > 7 THEN 2 WHEN len(procs) > 3 THEN 1 ELSE 0 END) AS prs
  FROM f),
scored AS (SELECT *, plp + pdi + pvd + prs AS ct, CASE WHEN plp + pdi + pvd + prs <= 8 THEN 'LOW' WHEN plp + pdi + pvd + prs <= 14 THEN 'MEDIUM'
  WHEN plp + pdi + pvd + prs <= 20 THEN 'HIGH' ELSE 'VERY_HIGH' END AS complexity_level FROM dims)"""
GAPS = ["LOGISTIC", "REG", "GLM", "MIXED", "IML", "REPORT", "TABULATE"]
REVIEW = GAPS[:4] + ["GENMOD", "PHREG", "LIFETEST", "NLIN"] + GAPS[4:]
quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)


def p(sql):
    return with_views("programs", sql)


def _review(procs):
    used = f"list_filter(procs, lambda x: list_contains([{quoted(procs)}], x))"
    return p(f"""WITH {SCORED} SELECT program_id, filename, 'HIGH' AS severity, 'hash objects' AS reason, '' AS detail FROM scored WHERE hash
      UNION ALL SELECT program_id, filename, 'HIGH', 'dynamic code', '' FROM scored WHERE dyn
      UNION ALL SELECT program_id, filename, 'MEDIUM', 'statistical procedures', array_to_string({used}, ', ') FROM scored WHERE len({used}) > 0
      UNION ALL SELECT program_id, filename, 'MEDIUM', 'very high complexity', CAST(ct AS VARCHAR) FROM scored WHERE complexity_level = 'VERY_HIGH'""")


COVER = PARSED + """,
cov AS (SELECT *, libs + steps + (merges >= 2)::INT + len(procs) + macros + hash::INT + dyn::INT AS total_patterns,
  len(list_filter(lib_list, lambda l: l <> 'DW')) + CASE WHEN reads > 0 THEN steps ELSE 0 END + (merges >= 2)::INT
  + len(list_filter(procs, lambda x: x IN ('SORT', 'SQL', 'FREQ', 'MEANS', 'FORMAT', 'UNIVARIATE'))) + macros AS covered_patterns FROM f),
pct AS (SELECT *, CASE WHEN total_patterns = 0 THEN 100.0e0 ELSE
  CAST(round_even(CAST(covered_patterns AS DOUBLE) / total_patterns * 100, 1) AS DOUBLE) END AS coverage_pct FROM cov)"""
FACTORS = [("DATA steps", "steps", "steps", "steps > 0"), ("MERGE", "merges", "merges * 5", "merges > 0"),
           ("PROC SQL", "1", "3", "list_contains(procs, 'SQL')"),
           *[(f"PROC {x}", "1", "5", f"list_contains(procs, '{x}')") for x in ("LOGISTIC", "REG", "GLM", "MIXED", "UNIVARIATE")],
           ("Macros", "macros", "macros * 2", "macros > 0"), ("Hash objects", "1", "5", "hash"), ("Dynamic code", "1", "5", "dyn")]
GAP_SQL = f"""gaps AS (SELECT program_id, filename, 'PROC ' || x AS gap FROM (SELECT program_id, filename, unnest(procs) AS x FROM f)
    WHERE x IN ({quoted(GAPS)})
  UNION ALL SELECT program_id, filename, 'hash objects' FROM f WHERE hash UNION ALL SELECT program_id, filename, 'dynamic code' FROM f WHERE dyn)"""

ORACLE = {
    **{f"score_{c}": p(f"WITH {SCORED} SELECT program_id, {c}, {LEVEL(c)} FROM scored") for c in ("plp", "pdi", "pvd", "prs")},
    "complexity": p(f"""WITH {SCORED} SELECT program_id, ct, complexity_level, CASE complexity_level WHEN 'LOW' THEN '8-24 HH'
      WHEN 'MEDIUM' THEN '32-80 HH' WHEN 'HIGH' THEN '80-160 HH' ELSE '>160 HH' END AS effort FROM scored"""),
    "manual_review": _review(REVIEW),
    "manual_review_migration": _review(REVIEW[:-2]),
    "map_libraries": p(f"""WITH l AS (SELECT program_id, unnest({upper_all(ex('libname'))}) AS name,
        unnest(list_transform({ex('libname', 2)}, lambda v: trim(v))) AS path_or_engine FROM programs)
      SELECT *, CASE WHEN name <> 'DW' THEN 'sas_migration' END AS catalog, CASE WHEN name <> 'DW' THEN 'bronze_' || lower(name) END AS schema,
        name <> 'DW' AS mapped, CASE WHEN name = 'DW' THEN 'No library mapping for DW' END AS warning FROM l"""),
    "pattern_coverage": p(f"WITH {COVER} SELECT program_id, total_patterns, covered_patterns, coverage_pct FROM pct"),
    "inventory_view_coverage": p(f"""WITH {PARSED} SELECT program_id, steps + len(procs) + macros + hash::INT + dyn::INT AS total_patterns,
      len(list_filter(procs, lambda x: x IN ('SORT', 'SQL', 'FREQ', 'MEANS', 'FORMAT', 'UNIVARIATE'))) + macros AS covered_patterns FROM f"""),
    "gap_report": p(f"WITH {PARSED}, {GAP_SQL} SELECT * FROM gaps"),
    "program_issues": p(f"""WITH {PARSED}, {GAP_SQL} SELECT program_id, 'GAP' AS kind, gap AS text FROM gaps UNION ALL
      SELECT program_id, 'WARNING', 'No library mapping for ' || l FROM (SELECT program_id, unnest(lib_list) AS l FROM f) WHERE l = 'DW'"""),
    "gap_list": p(f"WITH {PARSED}, {GAP_SQL} SELECT DISTINCT gap FROM gaps"),
    "converted_ratio": p(f"""WITH {COVER} SELECT CAST(sum((NOT hash AND NOT dyn AND NOT list_has_any(procs, [{quoted(GAPS)}]))::INT) AS BIGINT) AS converted,
      count(*) AS total_programs, round(avg(coverage_pct), 4) AS avg_coverage FROM pct"""),
    "score_factors": p(f"WITH {PARSED} " + " UNION ALL ".join(
        f"SELECT program_id, filename, '{n}' AS factor, {k} AS n, {v} AS points FROM f WHERE {w}" for n, k, v, w in FACTORS)),
    "feature_index": p(f"""WITH {PARSED} SELECT 'hash objects' AS feature, filename FROM f WHERE hash UNION ALL
      SELECT 'dynamic code', filename FROM f WHERE dyn UNION ALL SELECT 'merge', filename FROM f WHERE merges > 0"""),
    "macro_inventory": p(f"WITH {PARSED} SELECT filename, array_to_string(macro_list, ', ') AS macros FROM f WHERE macros > 0"),
    "proc_usage": p(f"""WITH {PARSED} SELECT x AS proc, count(*) AS programs, CASE WHEN x IN ({quoted(GAPS)}) THEN 'GAP' ELSE 'Sim' END AS translatable
      FROM (SELECT unnest(procs) AS x FROM f) GROUP BY x"""),
    "complexity_distribution": p(f"WITH {SCORED} SELECT complexity_level, count(*) AS n FROM scored GROUP BY 1"),
    "waves": p(f"""WITH {SCORED} SELECT CASE complexity_level WHEN 'LOW' THEN 'Quick Wins' WHEN 'VERY_HIGH' THEN 'Modelos Avancados'
      ELSE 'Core ETL' END AS wave, count(*) AS programs FROM scored GROUP BY 1"""),
}
