"""Steps of the program corpus as SQL statements.

The SQL beside them does not read the text: it says, from the parts the programs are made of, which
steps each has and what they must become.
"""

from __future__ import annotations

from ledgerlift.operators import convert as C
from ledgerlift.plans.views import view

LIBRARIES = {"raw": "bronze", "work": ""}


def _steps(s, d):
    return C.convert_steps(view(s, d, "programs"), LIBRARIES)


QUERIES = {
    "convert_steps": lambda s, d: _steps(s, d).select("filename", "place", "part", "kind", "status", "statement"),
    "converted_programs": lambda s, d: C.converted_programs(_steps(s, d)).drop("program_id", "script"),
}

#: Condition on the part, kind, status and statement of every step, in the order of the text.
STEPS = [
    ("true", "LIBNAME", "'converted'", "'USE bronze'"),
    ("p % 10 = 1", "LIBNAME", "'review'", "NULL"),
    ("p % 4 = 0", "MACRO", "'review'", "NULL"),
    ("true", "SORT", "'converted'", """'CREATE OR REPLACE TABLE s AS SELECT * EXCEPT (_rn) FROM (SELECT *, row_number() OVER
 (PARTITION BY id ORDER BY id) AS _rn FROM bronze.t' || size || ') WHERE _rn = 1'""".replace("\n", "")),
    ("p % 11 = 2", "SQL", "'converted'", """'CREATE OR REPLACE TABLE q AS SELECT a.id AS qid, b.v AS qv FROM bronze.a a LEFT JOIN bronze.b b ON a.id = b.id
 INNER JOIN bronze.c c ON a.id = c.id'""".replace("\n", "")),
    ("p % 3 = 0", "MERGE", "CASE WHEN p % 9 = 0 THEN 'gap' ELSE 'review' END",
     "'CREATE OR REPLACE TABLE o' || p || ' AS SELECT ' || kept || ' FROM s LEFT JOIN bronze.addr USING (id)'"),
    ("p % 3 <> 0", "DATA", "'review'",
     "'CREATE OR REPLACE TABLE o' || p || ' AS SELECT ' || kept || ' FROM o' || CASE WHEN p >= 7 THEN p - 7 ELSE 0 END"),
    ("p % 10 = 4", "DATA", "'converted'", "'CREATE OR REPLACE TABLE z AS SELECT C1131900000, C1212190000 FROM o' || p"),
    ("p % 10 = 4", "DATA", "'review'", "'CREATE OR REPLACE TABLE y AS SELECT C1131900000 FROM bronze.none'"),
    ("p % 7 = 2", "DATA", "'review'", "'CREATE OR REPLACE TABLE ac AS SELECT * FROM s'"),
    ("type = 'PROMO'", "LOGISTIC", "'gap'", "NULL"),
    ("type = 'SMALL'", "FREQ", "'review'", "NULL"),
    ("type = 'LARGE'", "MEANS", "'review'", "NULL"),
    ("type = 'MEDIUM'", "TABULATE", "'gap'", "NULL"),
    ("type = 'MEDIUM'", "FORMAT", "'review'", "NULL"),
    ("type = 'MEDIUM'", "IML", "'gap'", "NULL"),
    ("size % 2 = 0", "EXPORT", "'converted'", """'INSERT OVERWRITE DIRECTORY ''/out/' || size || '_sap_direto.csv'' USING csv
 OPTIONS (''header'' ''true'', ''sep'' '','') SELECT * FROM s'""".replace("\n", "")),
    ("p % 9 = 4", "EXPORT", "'gap'", "NULL"),
    ("p % 18 = 5", "EXPORT", "'gap'", "NULL"),
    ("p % 10 = 6", "IMPORT", "'converted'", """'CREATE OR REPLACE TABLE imp USING csv OPTIONS (''path'' ''/in/' || size || '_sap_direto.csv'',
 ''header'' ''true'', ''sep'' '';'')'""".replace("\n", "")),
    ("p % 22 = 9", "DATA", "'review'", "NULL"),
    ("p % 21 <= 4", "DATA", "'converted'", "'CREATE OR REPLACE TABLE resumo_aging AS SELECT * FROM s'"),
]
WANTED = """p AS (SELECT p_partkey AS p, p_size AS size, p_type AS type, 'prog_' || p_partkey || '.sas' AS filename,
    CASE WHEN p_partkey % 13 = 4 THEN 'id, total' ELSE 'id, C1131900000, C3152710000' END AS kept FROM part),
w AS (""" + " UNION ALL ".join(
    f"SELECT filename, {i} AS seq, '{kind}' AS kind, {status} AS status, {text} AS statement FROM p WHERE {test}"
    for i, (test, kind, status, text) in enumerate(STEPS)) + ")"

ORACLE = {
    "convert_steps": f"""WITH {WANTED} SELECT filename, CAST(row_number() OVER (PARTITION BY filename ORDER BY seq) AS INTEGER) AS place, 1 AS part,
      kind, status, CAST(statement AS VARCHAR) AS statement FROM w""",
    "converted_programs": f"""WITH {WANTED} SELECT filename, count(*) AS statements, count(*) FILTER (status = 'converted') AS converted,
      count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'gap') AS gap,
      round(100.0 * count(*) FILTER (status = 'converted') / count(*), 1) AS share FROM w GROUP BY filename""",
}
