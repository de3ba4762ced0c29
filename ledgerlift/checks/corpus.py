"""Facts of the program corpus."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerlift.operators import corpus as C
from ledgerlift.plans.views import view, with_views


def _programs(s, d):
    return view(s, d, "programs")


def _joined(field):
    return lambda s, d: C.extract(_programs(s, d), field).select("program_id", F.array_join(field, "|").alias(field))


def _exploded(field, *cols):
    return lambda s, d: C.extract(_programs(s, d), field).select("program_id", F.inline(field)).select("program_id", *cols)


def _steps(s, d):
    lists = ["set_sources", "assigned", "length_vars", "format_vars", "attrib_vars", "keep_vars", "drop_vars", "defined", "acct_referenced"]
    return C.steps_table(_programs(s, d)).select(
        "program_id", "step_no", "target", "start_line", *[F.array_join(c, "|").alias(c) for c in lists], "body")


def _accounts(s, d):
    out = C.extract(_programs(s, d), "accounting_variables").select("program_id", "accounting_variables.*")
    return out.select("program_id", *[F.array_join(c, "|").alias(c) for c in out.columns[1:]])


def _counts(s, d):
    fields = ["line_count", "size_bytes", "join_count", "if_then_chains"]
    return C.extract(_programs(s, d), *fields).select("program_id", *fields)


def _flags(s, d):
    fields = ["has_hash_objects", "has_dynamic_sql", "has_zip_processing", "has_infile_processing"]
    return C.extract(_programs(s, d), *fields).select("program_id", *fields)


QUERIES = {
    "x_libnames": _exploded("libnames", "name", "path_or_engine"),
    "x_data_steps": _joined("data_steps"),
    "x_procs": _joined("procs_used"),
    "x_datasets_read": _joined("datasets_read"),
    "x_datasets_read_clean": lambda s, d: C.extract(_programs(s, d), "datasets_read", clean=True).select(
        "program_id", F.array_join("datasets_read", "|").alias("datasets_read")),
    "x_datasets_written": _joined("datasets_written"),
    "x_macro_defs": _joined("macro_definitions"),
    "x_macro_calls": _joined("macro_calls"),
    "x_merge_words": _joined("merge_statements"),
    "x_includes": _joined("includes"),
    "x_infiles": _joined("infile_statements"),
    "x_filenames": _exploded("filenames", "fileref", "path"),
    "x_macro_vars": _exploded("macro_variables", "name", "value"),
    "x_proc_imports": _exploded("proc_imports", "datafile", "out_dataset", "dbms"),
    "x_proc_exports": _exploded("proc_exports", "data", "outfile", "dbms"),
    "x_formats": _joined("format_specs"),
    "x_named_literals": _joined("named_literals"),
    "x_unc_paths": _joined("unc_paths"),
    "x_flags": _flags,
    "x_counts": _counts,
    "x_keep_vars": _joined("keep_variables"),
    "x_assignments": _joined("variable_assignments"),
    "x_accounts": _accounts,
    "x_strip_comments": lambda s, d: C.with_clean(_programs(s, d)).select("program_id", "clean"),
    "x_step_scopes": _steps,
    "x_sql_creates": lambda s, d: C.sql_creates_table(_programs(s, d)).select(
        "program_id", "table", "start_line", F.array_join("aliases", "|").alias("aliases")),
    "x_value_maps": lambda s, d: C.value_maps_table(_programs(s, d)).drop("filename"),
    "x_sections": lambda s, d: _programs(s, d).select("program_id", C.sections(F.col("content")).alias("s")).select("program_id", "s.*"),
    "x_export_types": lambda s, d: _programs(s, d).select("program_id", F.array_join(C.export_types(F.col("content")), "|").alias("types")),
    "parse_programs": lambda s, d: C.parse_programs(_programs(s, d)).select(
        "program_id", "filename", "line_count", "size_bytes", F.size("libnames").alias("libnames"),
        F.size("data_steps").alias("data_steps"), F.size("procs_used").alias("procs"), F.size("datasets_read").alias("reads"),
        F.size("datasets_written").alias("writes"), F.size("macro_variables").alias("macro_vars"),
        F.size("proc_exports").alias("exports"), F.size("format_specs").alias("formats")),
}

# --- SQL ----------------------------------------------------------------------------------


def pat(name: str) -> str:
    """The pattern as a SQL literal, with the flags the other engine lacks taken off."""
    p = C.PATTERNS[name]
    m = re.match(r"\(\?([A-Za-z]+)\)", p)
    if m:
        flags = m.group(1).replace("U", "").replace("d", "")
        p = (f"(?{flags})" if flags else "") + p[m.end():]
    return "'" + p.replace("'", "''") + "'"


def ex(name: str, group: int = 1, text: str = "content") -> str:
    return f"regexp_extract_all({text}, {pat(name)}, {group})"


def srt(e: str) -> str:
    return f"list_sort(list_distinct({e}))"


def joined(e: str) -> str:
    return f"array_to_string({e}, '|')"


def upper_all(e: str) -> str:
    return f"list_transform({e}, lambda v: upper(v))"


def trim_all(e: str) -> str:
    return f"list_transform({e}, lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g'))"


def p(sql: str) -> str:
    return with_views("programs", sql)


def one(alias: str, e: str) -> str:
    return p(f"SELECT program_id, {joined(e)} AS {alias} FROM programs")


STEPS_LIST = (f"list_filter(list_transform(flatten(list_transform({ex('data_step')}, lambda t: string_split_regex(trim(t), '\\s+'))), "
              f"lambda w: regexp_replace(w, '\\(.*?\\)', '', 'g')), lambda w: w <> '' AND NOT starts_with(w, '('))")
MERGE_LIST = f"flatten(list_transform({ex('merge')}, lambda m: {ex('word', 1, 'm')}))"
KEYS = ", ".join(f"'{k}'" for k in C.KEYWORDS)
READS = lambda t="content": srt(f"list_concat(list_concat({ex('set', 1, t)}, flatten(list_transform({ex('merge', 1, t)}, lambda m: {ex('word', 1, 'm')}))), list_concat({ex('from', 1, t)}, {ex('join', 1, t)}))")
MACROS = ", ".join(f"'{m}'" for m in C.BUILTIN_MACROS)


def blanked(text: str, name: str) -> str:
    cs = f"regexp_extract_all({text}, {pat(name)})"
    return (f"array_to_string(list_transform(string_split_regex({text}, {pat(name)}), lambda g, i: g || "
            f"coalesce(regexp_replace({cs}[i], '[^\\n]', ' ', 'g'), '')), '')")


CLEAN = f"""c0 AS (SELECT program_id, filename, content, {blanked('content', 'block_comment')} AS c0 FROM programs),
cleaned AS (SELECT program_id, filename, content, {blanked('c0', 'line_comment')} AS clean FROM c0)"""


def nl(e: str) -> str:
    return f"(length({e}) - length(replace({e}, chr(10), '')))"


def hits(source: str, text: str, name: str) -> str:
    """CTE body: one row per match with line and character offset."""
    return f"""SELECT program_id, filename, {text} AS full_text, content, i - 1 AS hit_no, h[i] AS hit,
      CAST(1 + list_sum(list_transform(g[1:i], lambda x: {nl('x')})) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: {nl('x')})), 0) AS BIGINT) AS line,
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS place
    FROM (SELECT *, regexp_extract_all({text}, {pat(name)}) AS h, string_split_regex({text}, {pat(name)}) AS g,
      unnest(generate_series(1, len(regexp_extract_all({text}, {pat(name)})))) AS i FROM {source})"""


def names(e: str) -> str:
    return f"list_filter({upper_all(ex('name', 1, e))}, lambda n: n NOT IN ({KEYS}))"


def declared(name: str) -> str:
    return srt(f"list_filter(flatten(list_transform({ex(name, 1, 'body')}, lambda b: {names('b')})), lambda n: NOT regexp_matches(n, {pat('format_like')}))")


TOK = "list_filter(string_split_regex(b, '\\s+'), lambda t: t <> '')"
FORMATTED = srt(f"""flatten(list_transform({ex('format_block', 1, 'body')}, lambda b: list_transform(list_filter(
  list_transform({TOK}, lambda t, i: {{'t': t, 'n': ({TOK})[i + 1]}}),
  lambda q: regexp_matches(q.t, '^[A-Za-z_]\\w*$') AND NOT regexp_matches(q.t, {pat('format_like')}) AND upper(q.t) NOT IN ({KEYS})
    AND coalesce(regexp_matches(q.n, '\\d+\\.'), false)), lambda q: upper(q.t))))""")

STEPS = CLEAN + f""",
blocks AS ({hits('cleaned', 'clean', 'data_block')}),
heads AS (SELECT *, regexp_extract(hit, {pat('data_block')}, 1) AS head, regexp_extract(hit, {pat('data_block')}, 2) AS body FROM blocks),
steps AS (SELECT program_id, filename, hit_no AS step_no, line AS start_line, head, body,
  upper(string_split_regex(trim(regexp_replace(head, '\\(.*?\\)', '', 'g')), '\\s+')[1]) AS target,
  list_transform({ex('set_source', 1, 'body')}, lambda s: upper(replace(replace(s, '"', ''), '''', ''))) AS set_sources,
  {srt(f"list_filter({upper_all(ex('assignment', 1, 'body'))}, lambda n: n NOT IN ({KEYS}))")} AS assigned,
  {declared('length_block')} AS length_vars, {FORMATTED} AS format_vars, {declared('attrib_block')} AS attrib_vars,
  {srt(f"list_concat(flatten(list_transform({ex('keep', 1, 'body')}, lambda k: {names('k')})), flatten(list_transform({ex('keep_option', 1, 'head')}, lambda k: {names('k')})))")} AS keep_vars,
  {srt(f"flatten(list_transform({ex('drop', 1, 'body')}, lambda k: {names('k')}))")} AS drop_vars,
  {srt(ex('account', 0, 'body'))} AS acct_referenced FROM heads),
scopes AS (SELECT *, {srt('list_concat(list_concat(assigned, length_vars), list_concat(format_vars, attrib_vars))')} AS defined FROM steps)"""

EXPORT_KIND = ("CASE WHEN f LIKE '%sap%' AND f LIKE '%direto%' THEN 'sap_direto' WHEN f LIKE '%sap%' AND f LIKE '%aceito%' THEN 'sap_aceito' "
               "WHEN f LIKE '%analitica%' AND f LIKE '%direto%' THEN 'base_analitica_direto' WHEN f LIKE '%analitica%' AND f LIKE '%aceito%' "
               "THEN 'base_analitica_aceito' WHEN f LIKE '%analitica%' AND f LIKE '%vencido%' THEN 'base_analitica_vencido' "
               "WHEN f LIKE '%concilia%' THEN 'conciliacao' WHEN f LIKE '%resumo%' OR f LIKE '%aging%' THEN 'resumo_aging' "
               "WHEN f LIKE '%usd%' OR f LIKE '%moeda%' THEN 'moeda_estrangeira' ELSE 'outro' END")
TYPES = srt(f"list_transform(list_transform({ex('proc_export', 2)}, lambda v: lower(v)), lambda f: {EXPORT_KIND})")
MAPS = "maps AS (SELECT *, upper(regexp_extract(hit, {0}, 1)) AS src_var, regexp_extract(hit, {0}, 2) AS src_val, " \
       "upper(regexp_extract(hit, {0}, 3)) AS tgt_var, regexp_extract(hit, {0}, 4) AS tgt_val, " \
       "regexp_extract(lower(substr(full_text, 1, CAST(place AS BIGINT))), '(?s).*(aceito|resumo)', 1) AS before FROM map_hits)".format(pat("value_map"))
SECTION = "CASE WHEN before = '' THEN 'geral' ELSE before END"
LINES = ("length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 0 ELSE 1 END")


def _zip(name, *fields):
    lists = ", ".join(f"unnest({e}) AS {a}" for a, e in fields)
    return p(f"SELECT program_id, {lists} FROM programs")


ORACLE = {
    "x_libnames": _zip("libname", ("name", upper_all(ex("libname", 1))), ("path_or_engine", trim_all(ex("libname", 2)))),
    "x_data_steps": one("data_steps", STEPS_LIST),
    "x_procs": one("procs_used", srt(upper_all(ex("proc")))),
    "x_datasets_read": one("datasets_read", READS()),
    "x_datasets_read_clean": p(f"WITH {CLEAN} SELECT program_id, {joined(READS('clean'))} AS datasets_read FROM cleaned"),
    "x_datasets_written": one("datasets_written", srt(f"list_concat({STEPS_LIST}, {ex('sql_create')})")),
    "x_macro_defs": one("macro_definitions", ex("macro_def")),
    "x_macro_calls": one("macro_calls", srt(f"list_filter({ex('macro_call')}, lambda n: lower(n) NOT IN ({MACROS}))")),
    "x_merge_words": one("merge_statements", MERGE_LIST),
    "x_includes": one("includes", trim_all(ex("include"))),
    "x_infiles": one("infile_statements", trim_all(ex("infile"))),
    "x_filenames": _zip("filename", ("fileref", ex("filename", 1)), ("path", trim_all(ex("filename", 2)))),
    "x_macro_vars": _zip("let", ("name", ex("let", 1)), ("value", trim_all(ex("let", 2)))),
    "x_proc_imports": _zip("i", ("datafile", trim_all(ex("proc_import", 1))), ("out_dataset", ex("proc_import", 2)), ("dbms", upper_all(ex("proc_import", 3)))),
    "x_proc_exports": _zip("e", ("data", ex("proc_export", 1)), ("outfile", trim_all(ex("proc_export", 2))), ("dbms", upper_all(ex("proc_export", 3)))),
    "x_formats": one("format_specs", srt(upper_all(ex("format_spec", 0)))),
    "x_named_literals": one("named_literals", srt(ex("named_literal", 0))),
    "x_unc_paths": one("unc_paths", srt(ex("unc_path", 0))),
    "x_flags": p(f"""SELECT program_id, regexp_matches(content, {pat('hash')}) AS has_hash_objects, regexp_matches(content, {pat('dynamic')}) AS has_dynamic_sql,
      regexp_matches(content, {pat('filename_zip')}) AS has_zip_processing, regexp_matches(content, {pat('infile')}) AS has_infile_processing FROM programs"""),
    "x_counts": p(f"""SELECT program_id, {LINES} AS line_count, strlen(content) AS size_bytes,
      len({ex('left_join', 0)}) + len({ex('inner_join', 0)}) AS join_count, len({ex('if_then', 0)}) AS if_then_chains FROM programs"""),
    "x_keep_vars": one("keep_variables", srt(upper_all(f"flatten(list_transform({ex('keep')}, lambda k: {ex('name', 1, 'k')}))"))),
    "x_assignments": one("variable_assignments", srt(upper_all(ex("assignment")))),
    "x_accounts": p(f"""WITH a AS (SELECT program_id, {srt(ex('account_assigned'))} AS a, {srt(ex('account', 0))} AS r FROM programs)
      SELECT program_id, {joined('a')} AS assigned, {joined('r')} AS referenced,
      {joined('list_filter(r, lambda v: NOT list_contains(a, v))')} AS referenced_but_not_assigned FROM a"""),
    "x_strip_comments": p(f"WITH {CLEAN} SELECT program_id, clean FROM cleaned"),
    "x_step_scopes": p(f"""WITH {STEPS} SELECT program_id, step_no, target, start_line, {', '.join(joined(c) + ' AS ' + c for c in
      ('set_sources', 'assigned', 'length_vars', 'format_vars', 'attrib_vars', 'keep_vars', 'drop_vars', 'defined', 'acct_referenced'))}, body FROM scopes"""),
    "x_sql_creates": p(f"""WITH {CLEAN}, made AS ({hits('cleaned', 'clean', 'sql_select')}),
      m AS (SELECT *, substr(full_text, place + 1) AS rest FROM made),
      b AS (SELECT *, string_split_regex(rest, {pat('sql_end')})[1] AS stmt FROM m)
      SELECT program_id, upper(regexp_extract(hit, {pat('sql_select')}, 1)) AS "table", line AS start_line,
      {joined(srt(f"list_filter({upper_all(ex('alias', 1, 'stmt'))}, lambda a: a NOT IN ({KEYS}))"))} AS aliases FROM b"""),
    "x_value_maps": p(f"""WITH map_hits AS ({hits('programs', 'content', 'value_map')}), {MAPS}
      SELECT program_id, src_var, src_val, tgt_var, tgt_val, line, {SECTION} AS section FROM maps"""),
    "x_sections": p(f"""SELECT program_id, regexp_matches(content, {pat('section_direct')}) AS direct, regexp_matches(content, {pat('section_accepted')}) AS accepted,
      regexp_matches(content, {pat('section_summary')}) AS summary, regexp_matches(content, {pat('section_reconciliation')}) AS reconciliation FROM programs"""),
    "x_export_types": one("types", TYPES),
    "parse_programs": p(f"""SELECT program_id, filename, {LINES} AS line_count, strlen(content) AS size_bytes, len({ex('libname')}) AS libnames,
      len({STEPS_LIST}) AS data_steps, len({srt(upper_all(ex('proc')))}) AS procs, len({READS()}) AS reads,
      len({srt(f"list_concat({STEPS_LIST}, {ex('sql_create')})")}) AS writes, len({ex('let')}) AS macro_vars,
      len({ex('proc_export')}) AS exports, len({srt(upper_all(ex('format_spec', 0)))}) AS formats FROM programs"""),
}
