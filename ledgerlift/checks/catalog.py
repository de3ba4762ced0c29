"""Catalog, governance and the environment report."""

from __future__ import annotations

from ledgerlift.operators import catalog as K
from ledgerlift.plans.views import BASE_SCHEMAS, BASE_TABLES, view, with_views
from ledgerlift.checks.rules import ALL
from ledgerlift.checks.scoring import SCORED
from ledgerlift.checks.lineage import MENTIONS
from ledgerlift.plans import report as E


def _in(s, d):
    return view(s, d, "datasets_meta"), view(s, d, "columns_meta")


def _tables(s, d):
    return {t: view(s, d, t) for t in BASE_TABLES}


QUERIES = {
    "pii_columns": lambda s, d: K.pii_columns(_in(s, d)[1]).select("dataset_name", "position", "name"),
    "pii_exact_flag": lambda s, d: K.pii_exact_flag(_in(s, d)[1]).select("dataset_name", "position", "name", "type", "is_pii"),
    "infer_domain": lambda s, d: K.infer_domain(*_in(s, d)),
    "reference_table_flag": lambda s, d: K.reference_table_flag(_in(s, d)[0]),
    "sensitivity": lambda s, d: K.sensitivity(*_in(s, d)),
    "pii_alerts": lambda s, d: K.pii_alerts(*_in(s, d)),
    "catalog_datasets": lambda s, d: K.catalog_datasets(*_in(s, d)),
    "catalog_summary": lambda s, d: K.catalog_summary(*_in(s, d)),
    "profile_catalog": lambda s, d: K.profile_catalog(s, _tables(s, d))[0],
    "profile_catalog_summary": lambda s, d: K.catalog_summary(*K.profile_catalog(s, _tables(s, d))),
    "table_row_counts": lambda s, d: K.row_counts(_tables(s, d)),
    "environment_report": lambda s, d: E.environment_report(view(s, d, "programs"), *_in(s, d)),
}

WORD = "regexp_matches(lower(name), 'cpf|email|phone|telefone|salary|salario|ssn|rg|nome|name|address|endereco')"
DOM = """CASE WHEN regexp_matches(t, 'customer|client|pessoa|cadastro') THEN 'Customer' WHEN regexp_matches(t, 'payment|transaction|premium|amount|financial|revenue') THEN 'Financial'
  WHEN regexp_matches(t, 'risk|score|model|scoring') THEN 'Risk' WHEN regexp_matches(t, 'product|produto|item') THEN 'Product'
  WHEN regexp_matches(t, 'claim|sinistro') THEN 'Claims' WHEN regexp_matches(t, 'policy|apolice|contract') THEN 'Policy' ELSE 'General' END"""
REFT = "(row_count BETWEEN 1 AND 100 OR regexp_matches(lower(dataset_name), 'lookup|ref|product|code|type'))"
CAT = f"""x AS (SELECT d.dataset_name, d.row_count, d.column_count, lower(d.dataset_name || ' ' || string_agg(c.name, ' ' ORDER BY c.position)) AS t,
    coalesce(string_agg(c.name, ', ' ORDER BY c.position) FILTER ({WORD}), '') AS pii_columns, count(*) FILTER ({WORD}) AS n_pii
  FROM datasets_meta d JOIN columns_meta c ON c.dataset_name = d.dataset_name GROUP BY 1, 2, 3),
cat AS (SELECT dataset_name, row_count, column_count, {DOM} AS domain, CASE WHEN n_pii > 0 THEN 'Restricted' WHEN {REFT} THEN 'Public' ELSE 'Internal' END AS sensitivity,
  pii_columns, n_pii FROM x)"""


def m(sql):
    return with_views("columns_meta datasets_meta", sql)


FIELDS = [(t, i, f.split()[0]) for t, ddl in BASE_SCHEMAS.items() for i, f in enumerate(ddl.split(", "))]
COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS dataset_name, count(*) AS row_count FROM {t}" for t in BASE_TABLES)
LIVE = f"""columns_meta AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {i}, '{c}')" for t, i, c in FIELDS)}) v(dataset_name, position, name)),
datasets_meta AS (SELECT a.*, b.column_count FROM ({COUNTS}) a JOIN (SELECT dataset_name, count(*) AS column_count FROM columns_meta GROUP BY 1) b
  ON a.dataset_name = b.dataset_name)"""
SUMMARY = """SELECT 'total_datasets' AS measure, count(*) AS value FROM cat UNION ALL SELECT 'total_columns', CAST(sum(column_count) AS BIGINT) FROM cat
  UNION ALL SELECT 'datasets_with_pii', count(*) FILTER (n_pii > 0) FROM cat UNION ALL SELECT 'domain:' || domain, count(*) FROM cat GROUP BY 1
  UNION ALL SELECT 'sensitivity:' || sensitivity, count(*) FROM cat GROUP BY 1"""

ORACLE = {
    "pii_columns": m(f"SELECT dataset_name, position, name FROM columns_meta WHERE {WORD}"),
    "pii_exact_flag": m("""SELECT dataset_name, position, name, type, lower(name) IN ('cpf', 'email', 'phone', 'telefone', 'salary', 'salario', 'ssn', 'rg', 'nome',
      'name', 'address', 'endereco') AS is_pii FROM columns_meta"""),
    "infer_domain": m(f"WITH {CAT} SELECT dataset_name, domain FROM cat"),
    "reference_table_flag": m(f"SELECT *, {REFT} AS is_reference FROM datasets_meta"),
    "sensitivity": m(f"WITH {CAT} SELECT dataset_name, sensitivity FROM cat"),
    "pii_alerts": m(f"""WITH {CAT} SELECT dataset_name, pii_columns, sensitivity, domain, 'mask before migration; review privacy compliance' AS advice
      FROM cat WHERE n_pii > 0"""),
    "catalog_datasets": m(f"WITH {CAT} SELECT * FROM cat"),
    "catalog_summary": m(f"WITH {CAT} {SUMMARY}"),
    "profile_catalog": f"WITH {LIVE} SELECT * FROM datasets_meta",
    "profile_catalog_summary": f"WITH {LIVE}, {CAT} {SUMMARY}",
    "table_row_counts": COUNTS,
    "environment_report": with_views("programs columns_meta datasets_meta", f"""WITH {SCORED}, {MENTIONS}, every AS ({ALL}),
      r AS (SELECT 'programs' AS measure, CAST(count(*) AS VARCHAR) AS value FROM scored UNION ALL SELECT 'lines', CAST(sum(lines) AS VARCHAR) FROM scored
        UNION ALL SELECT 'strategy', CASE WHEN bool_or(complexity_level IN ('HIGH', 'VERY_HIGH')) THEN 'Phased migration recommended' ELSE 'Straightforward migration feasible' END FROM scored
        UNION ALL SELECT 'complexity:' || complexity_level, CAST(count(*) AS VARCHAR) FROM scored GROUP BY 1
        UNION ALL SELECT 'procs', CAST(count(DISTINCT x) AS VARCHAR) FROM (SELECT unnest(procs) AS x FROM scored)
        UNION ALL SELECT 'datasets', CAST(count(*) AS VARCHAR) FROM datasets_meta
        UNION ALL SELECT 'data_rows', CAST(sum(row_count) FILTER (row_count > 0) AS VARCHAR) FROM datasets_meta
        UNION ALL SELECT 'lineage_edges', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT id, prog, relationship FROM g)
        UNION ALL SELECT 'lineage_nodes', CAST((SELECT count(DISTINCT id) FROM g) + (SELECT count(*) FROM programs) AS VARCHAR)
        UNION ALL SELECT 'findings:' || severity, CAST(count(*) AS VARCHAR) FROM every GROUP BY 1)
      SELECT * FROM r"""),
}
