"""Statements for the target platforms."""

from __future__ import annotations

from ledgerlift.checks.schema import HOUSE, IS_DATE, IS_STAMP, LAKE
from ledgerlift.operators import statements as T
from ledgerlift.plans.views import view, with_views

SPACES = {"lakehouse": "main.bronze", "warehouse": "SALES.RAW"}


def _meta(s, d):
    return view(s, d, "datasets_meta"), view(s, d, "columns_meta")


def _create(target):
    return lambda s, d: T.create_statements(*_meta(s, d), target, SPACES[target], "delta")


def _load(target, recurring):
    return lambda s, d: T.load_statements(view(s, d, "datasets_meta"), target, SPACES[target], "/landing", recurring)


def _check(target):
    return lambda s, d: T.check_statements(*_meta(s, d), target, SPACES[target])


QUERIES = {
    "create_statements_lakehouse": _create("lakehouse"),
    "create_statements_warehouse": _create("warehouse"),
    "load_statements_lakehouse": _load("lakehouse", False),
    "load_statements_warehouse": _load("warehouse", False),
    "load_statements_lakehouse_recurring": _load("lakehouse", True),
    "load_statements_warehouse_recurring": _load("warehouse", True),
    "check_statements_lakehouse": _check("lakehouse"),
    "check_statements_warehouse": _check("warehouse"),
}

TYPES = {"lakehouse": LAKE, "warehouse": HOUSE.format(IS_DATE, IS_STAMP)}
NL = "chr(10)"


def _name(target, name="dataset_name"):
    return f"'{SPACES[target]}.' || {'lower' if target == 'lakehouse' else 'upper'}({name})"


def _cols(target):
    cased = "lower" if target == "lakehouse" else "upper"
    return f"c AS (SELECT dataset_name, position, {cased}(name) AS n, {TYPES[target]} AS t, type, label FROM columns_meta)"


def _create_sql(target):
    tail = f" || {NL} || 'USING delta'" if target == "lakehouse" else ""
    quoted = r"replace(replace(label, '\', '\\'), '''', '\''')" if target == "lakehouse" else "replace(label, '''', '''''')"
    return with_views("columns_meta datasets_meta", f"""WITH {_cols(target)},
      l AS (SELECT dataset_name, string_agg('  ' || n || ' ' || t || CASE WHEN coalesce(label, '') = '' THEN '' ELSE ' COMMENT ''' || {quoted} || '''' END,
        ',' || {NL} ORDER BY position, n) AS lines FROM c GROUP BY dataset_name)
      SELECT dataset_name, 'create' AS kind, 'CREATE TABLE IF NOT EXISTS ' || {_name(target)} || ' (' || {NL} || lines || {NL} || ')'{tail} AS statement
      FROM datasets_meta LEFT JOIN l USING (dataset_name)""")


def _load_sql(target, recurring):
    if target == "lakehouse":
        text = (f"""'CREATE OR REFRESH STREAMING TABLE ' || {_name(target)} || {NL} || 'AS SELECT * FROM STREAM read_files(''/landing/' || dataset_name
          || '/'', format => ''csv'', header => true)'""" if recurring else
                f"""'COPY INTO ' || {_name(target)} || {NL} || 'FROM ''/landing/' || dataset_name || '.csv''' || {NL} || 'FILEFORMAT = CSV' || {NL}
          || 'FORMAT_OPTIONS (''header'' = ''true'', ''inferSchema'' = ''true'', ''delimiter'' = '','')' || {NL} || 'COPY_OPTIONS (''mergeSchema'' = ''true'')'""")
    else:
        copy = f"""'COPY INTO ' || {_name(target)} || {NL} || 'FROM @landing/' || dataset_name || '{'/' if recurring else '.csv'}' || {NL}
          || 'FILE_FORMAT = (TYPE = ''CSV'' SKIP_HEADER = 1 FIELD_OPTIONALLY_ENCLOSED_BY = ''"'')'"""
        text = (f"'CREATE OR REPLACE PIPE SALES.RAW.PIPE_' || upper(dataset_name) || {NL} || 'AUTO_INGEST = TRUE' || {NL} || 'AS ' || {copy}"
                if recurring else f"{copy} || {NL} || 'ON_ERROR = ''CONTINUE'''")
    return with_views("datasets_meta", f"SELECT dataset_name, '{'load_recurring' if recurring else 'load'}' AS kind, {text} AS statement FROM datasets_meta")


def _check_sql(target):
    space = SPACES[target]
    hashed = "'bit_xor(xxhash64(' || names || '))'" if target == "lakehouse" else "'hash_agg(*)'"
    head = "'SELECT ''' || dataset_name || ''' AS dataset, '"
    alias = lambda a: f"' AS {a}_' || n"
    return with_views("columns_meta datasets_meta", f"""WITH {_cols(target)},
      l AS (SELECT dataset_name, count(*) AS k, string_agg(n, ', ' ORDER BY position, n) AS names,
        string_agg('min(' || n || ')' || {alias('min')} || ', max(' || n || ')' || {alias('max')} || CASE WHEN t LIKE 'DATE%' OR t LIKE 'TIMESTAMP%' THEN '' ELSE ', avg(' || n || ')' || {alias('avg')} END
          || ', count(*) - count(' || n || ')' || {alias('nulls')}, ', ' ORDER BY position, n) FILTER (type = 'num') AS stats FROM c GROUP BY dataset_name),
      a AS (SELECT *, CASE WHEN coalesce(row_count, -1) < 0 THEN 'NULL AS expected, count(*) AS actual, ''UNKNOWN'''
        ELSE row_count || ' AS expected, count(*) AS actual, CASE WHEN count(*) = ' || row_count || ' THEN ''PASS'' ELSE ''FAIL'' END' END AS counted
        FROM datasets_meta LEFT JOIN l USING (dataset_name)),
      x AS (SELECT dataset_name, 'row_count' AS kind, {head} || '''row_count'' AS check_name, ' || counted || ' AS status FROM ' || {_name(target)} AS statement FROM a
      UNION ALL SELECT dataset_name, 'schema', {head} || '''schema'' AS check_name, ' || k || ' AS expected, count(*) AS actual, CASE WHEN count(*) = ' || k
        || ' THEN ''PASS'' ELSE ''FAIL'' END AS status FROM {space.split('.')[0]}.information_schema.columns WHERE lower(table_schema) = ''{space.split('.')[1].lower()}'''
        || ' AND lower(table_name) = ''' || lower(dataset_name) || '''' FROM a
      UNION ALL SELECT dataset_name, 'column_stats', {head} || stats || ' FROM ' || {_name(target)} FROM a
      UNION ALL SELECT dataset_name, 'checksum', {head} || {hashed} || ' AS checksum FROM ' || {_name(target)} FROM a)
      SELECT * FROM x WHERE statement IS NOT NULL""")


ORACLE = {
    **{f"create_statements_{t}": _create_sql(t) for t in SPACES},
    **{f"load_statements_{t}": _load_sql(t, False) for t in SPACES},
    **{f"load_statements_{t}_recurring": _load_sql(t, True) for t in SPACES},
    **{f"check_statements_{t}": _check_sql(t) for t in SPACES},
}
