"""Integrity rules over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.checks.corpus import CLEAN, MAPS, SECTION, STEPS, TYPES, ex, hits, pat, srt
from ledgerlift.operators import rules as R
from ledgerlift.plans.views import view, with_views
from ledgerlift.session import stored

SHOWN = ["program", "severity", "category", "line", "subject", "target", "recommendation_type"]


def _programs(s, d):
    return view(s, d, "programs")


def _rule(category):
    return lambda s, d: R.program_findings(_programs(s, d), [category]).select(*SHOWN)


def _corpus(fn):
    return lambda s, d: R.corpus_findings(_programs(s, d), fn).select(*SHOWN)


QUERIES = {
    "build_registry": lambda s, d: R.registry_table(_programs(s, d)),
    "rule_account_unreachable": _rule("VARIAVEL_CONTABIL_INDEFINIDA"),
    "rule_account_nowhere": _rule("VARIAVEL_CONTABIL_INEXISTENTE"),
    "rule_keep_undefined": _rule("KEEP_VARIAVEL_INDEFINIDA"),
    "rule_formula_undefined": _rule("FORMULA_REFERENCIA_INDEFINIDA"),
    "rule_self_reimport": _rule("AUTO_REIMPORTACAO"),
    "rule_map_else_commented": _rule("MAPEAMENTO_ELSE_COMENTADO"),
    "rule_map_no_else": _rule("MAPEAMENTO_SEM_ELSE"),
    "rule_section_missing": _corpus(R.section_missing),
    "rule_account_coverage": _corpus(R.account_coverage),
    "rule_map_internal": _corpus(R.map_internal),
    "rule_map_divergent": _corpus(R.map_divergent),
    "rule_export_missing": _corpus(R.export_missing),
    "findings": lambda s, d: R.find_all(_programs(s, d)).groupBy("category").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("program").alias("programs")),
    "findings_summary": lambda s, d: R.findings_summary(R.find_all(_programs(s, d))),
    "all_values_union": lambda s, d: R.general_gaps(stored(R.facts(_programs(s, d), ["general"]), "facts")),
}

# One level of inheritance is what the corpus holds: a step reads a step of the same program.
REG = STEPS + f""",
own AS (SELECT program_id, target, step_no, unnest(defined) AS variable FROM scopes),
links AS (SELECT c.program_id, c.target, c.step_no, max(b.step_no) AS parent FROM
  (SELECT program_id, target, step_no, unnest(set_sources) AS src FROM scopes) c
  JOIN scopes b ON b.program_id = c.program_id AND b.target = c.src AND b.step_no < c.step_no GROUP BY 1, 2, 3),
inherited AS (SELECT l.program_id, l.target, l.step_no, o.variable FROM links l JOIN own o ON o.program_id = l.program_id AND o.step_no = l.parent),
made AS ({hits('cleaned', 'clean', 'sql_select')}),
aliases AS (SELECT program_id, upper(regexp_extract(hit, {pat('sql_select')}, 1)) AS target,
  unnest({srt(f"list_filter(list_transform(regexp_extract_all(string_split_regex(substr(full_text, place + 1), {pat('sql_end')})[1], {pat('alias')}, 1), lambda v: upper(v)), lambda a: a <> 'SELECT')")}) AS variable FROM made),
reg AS (SELECT DISTINCT program_id, target AS dataset, variable FROM (SELECT program_id, target, variable FROM own UNION ALL
  SELECT program_id, target, variable FROM inherited UNION ALL SELECT program_id, target, variable FROM aliases)),
asg AS (SELECT DISTINCT program_id, unnest(assigned) AS v FROM scopes),
reach AS (SELECT s.program_id, s.step_no, r.variable FROM (SELECT program_id, step_no, unnest(set_sources) AS src FROM scopes) s
  JOIN reg r ON r.program_id = s.program_id AND r.dataset = s.src),
refd AS (SELECT program_id, filename, step_no, start_line, target, body, keep_vars, assigned, unnest(acct_referenced) AS v FROM scopes),
loose AS (SELECT * FROM refd x WHERE NOT list_contains(assigned, v)
  AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.program_id = x.program_id AND r.step_no = x.step_no AND r.variable = x.v)),
kept AS (SELECT program_id, filename, step_no, start_line, target, defined, unnest(keep_vars) AS v FROM scopes)"""


def _f(cat, line, subject, target):
    sev, rec = R.CATEGORIES[cat]
    return (f"filename AS program, '{sev}' AS severity, '{cat}' AS category, {line} AS line, {subject} AS subject, {target} AS target, "
            f"'{rec}' AS recommendation_type")


def p(sql):
    return with_views("programs", sql)


UNREACHABLE = f"""SELECT {_f('VARIAVEL_CONTABIL_INDEFINIDA', 'start_line', 'v', 'target')} FROM loose x
  WHERE list_contains(keep_vars, v) AND EXISTS (SELECT 1 FROM asg a WHERE a.program_id = x.program_id AND a.v = x.v)"""
NOWHERE = f"""SELECT {_f('VARIAVEL_CONTABIL_INEXISTENTE', 'start_line', 'v', 'target')} FROM loose x
  WHERE NOT EXISTS (SELECT 1 FROM asg a WHERE a.program_id = x.program_id AND a.v = x.v)
    AND (list_contains(keep_vars, v) OR regexp_matches(body, '(?im)^\\s*\\w+\\s*=.*\\b' || v || '\\b'))"""
KEEP = f"""SELECT {_f('KEEP_VARIAVEL_INDEFINIDA', 'start_line', 'v', 'target')} FROM kept x
  WHERE regexp_matches(v, '^C\\d{{7,}}$') AND NOT list_contains(defined, v)
    AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.program_id = x.program_id AND r.step_no = x.step_no AND r.variable = x.v)"""
FORMULA = f"""SELECT {_f('FORMULA_REFERENCIA_INDEFINIDA', 'start_line', 'v', 'lhs')} FROM (
    SELECT *, unnest(list_distinct(regexp_extract_all(rhs, '\\bC\\d{{7,}}\\b'))) AS v FROM (
      SELECT *, upper(regexp_extract(t, {pat('formula')}, 1)) AS lhs, upper(regexp_extract(t, {pat('formula')}, 2)) AS rhs FROM (
        SELECT *, unnest({ex('formula', 0, 'body')}) AS t FROM scopes))) x
  WHERE v <> lhs AND NOT list_contains(defined, v)
    AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.program_id = x.program_id AND r.step_no = x.step_no AND r.variable = x.v)"""
STEM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^.*/', ''), '\\.[^.]*$', ''), '^\\d+_', ''), '_\\d+$', '')"
REIMPORT = f"""SELECT {_f('AUTO_REIMPORTACAO', '0', 'r.path', 'w.path')} FROM
  (SELECT program_id, filename, unnest({ex('export_outfile', 1, 'clean')}) AS path FROM cleaned) w JOIN
  (SELECT program_id AS pid, unnest(list_concat({ex('infile_path', 1, 'clean')}, {ex('import_datafile', 1, 'clean')})) AS path FROM cleaned) r
  ON w.program_id = r.pid AND {STEM.format('w.path')} = {STEM.format('r.path')}"""
CHAINS = f"""{CLEAN}, map_hits AS ({hits('cleaned', 'clean', 'value_map')}), {MAPS},
chain AS (SELECT program_id, filename, any_value(content) AS content, any_value(full_text) AS clean, src_var, tgt_var, min(line) AS first_line, max(line) AS last_line,
  array_to_string({srt('list(src_val)')}, ', ') AS covered FROM maps WHERE src_var LIKE '%SISTEMA_ORIGEM%' GROUP BY program_id, filename, src_var, tgt_var),
tail AS (SELECT *, unnest(generate_series(last_line + 1, len(string_split(clean, chr(10))))) AS ln FROM chain),
seen AS (SELECT *, CASE WHEN regexp_matches(string_split(clean, chr(10))[ln], '(?i)^\\s*ELSE\\s+' || tgt_var) THEN 'else'
  WHEN regexp_matches(string_split(content, chr(10))[ln], '(?i)/\\*.*ELSE.*\\*/') THEN 'commented'
  WHEN regexp_matches(string_split(clean, chr(10))[ln], '(?i)^\\s*(RUN|QUIT)\\s*;') THEN 'none' END AS kind FROM tail),
ends AS (SELECT program_id, src_var, tgt_var, min(ln) AS ln, arg_min(kind, ln) AS kind FROM seen WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
out AS (SELECT c.*, e.ln, coalesce(e.kind, 'none') AS kind FROM chain c LEFT JOIN ends e USING (program_id, src_var, tgt_var))"""
COMMENTED = f"SELECT {_f('MAPEAMENTO_ELSE_COMENTADO', 'ln', 'covered', 'tgt_var')} FROM out WHERE kind = 'commented'"
NO_ELSE = f"SELECT {_f('MAPEAMENTO_SEM_ELSE', 'first_line', 'covered', 'tgt_var')} FROM out WHERE kind = 'none'"
NULLT = "CAST(NULL AS VARCHAR)"
SECT = f"""dir AS (SELECT filename, regexp_matches(content, {pat('section_accepted')}) AS accepted, regexp_matches(content, {pat('section_summary')}) AS summary,
    regexp_matches(content, {pat('section_reconciliation')}) AS reconciliation FROM programs WHERE regexp_matches(content, {pat('section_direct')}))"""
SECTIONS = " UNION ALL ".join(
    f"SELECT {_f('SECAO_AUSENTE', '0', chr(39) + k + chr(39), NULLT)} FROM dir WHERE NOT {k} AND (SELECT bool_or({k}) FROM dir)"
    for k in ("accepted", "summary", "reconciliation"))
ACC = f"""accs AS (SELECT filename, {srt(ex('account_assigned'))} AS vs FROM programs WHERE regexp_matches(content, {pat('section_direct')})),
main_acc AS (SELECT * FROM accs WHERE len(vs) >= 5),
all_acc AS (SELECT {srt('flatten(list(vs))')} AS vs FROM main_acc)"""
ACC_MISSING = "list_filter((SELECT vs FROM all_acc), lambda v: NOT list_contains(vs, v))"
COUNTED = "len({0}) || ' of ' || len((SELECT vs FROM {1}))"
COVERAGE = f"SELECT {_f('CONTA_CONTABIL_AUSENTE', '0', COUNTED.format(ACC_MISSING, 'all_acc'), NULLT)} FROM main_acc WHERE len({ACC_MISSING}) > 0"
RAWMAPS = f"map_hits AS ({hits('programs', 'content', 'value_map')}), {MAPS}"
VALUES = f"""{RAWMAPS}, v AS (SELECT filename, coalesce(list(DISTINCT src_val) FILTER ({SECTION} = 'geral'), []) AS g,
    coalesce(list(DISTINCT src_val) FILTER ({SECTION} = 'aceito'), []) AS a FROM maps WHERE src_var LIKE '%SISTEMA_ORIGEM%' GROUP BY filename),
all_v AS (SELECT {srt('flatten(list(g))')} AS vs FROM v)"""
LOST = "list_sort(list_filter(g, lambda x: NOT list_contains(a, x)))"
INTERNAL = f"SELECT {_f('MAPEAMENTO_INCONSISTENTE_INTERNO', '0', f'array_to_string({LOST}, chr(44) || chr(32))', NULLT)} FROM v WHERE len(a) > 0 AND len({LOST}) > 0"
OTHER = "list_filter((SELECT vs FROM all_v), lambda x: NOT list_contains(g, x))"
DIVERGENT = f"SELECT {_f('MAPEAMENTO_DIVERGENTE_ENTRE_PROGRAMAS', '0', COUNTED.format(OTHER, 'all_v'), NULLT)} FROM v WHERE len(g) > 0 AND len({OTHER}) > 0"
EXP = f"""ty AS (SELECT filename, {TYPES} AS t FROM programs), mainx AS (SELECT * FROM ty WHERE list_has_any(t,
    ['sap_direto', 'sap_aceito', 'base_analitica_direto', 'base_analitica_aceito'])),
every_x AS (SELECT flatten(list(t)) AS et FROM mainx),
lackx AS (SELECT filename, list_filter(['base_analitica_aceito', 'sap_aceito'], lambda x: NOT list_contains(t, x)
    AND list_contains(et, x)) AS l FROM mainx, every_x)"""
EXPORTS = f"SELECT {_f('EXPORT_AUSENTE', '0', 'array_to_string(l, chr(44) || chr(32))', NULLT)} FROM lackx WHERE len(l) > 0"

PARTS = [(REG, [UNREACHABLE, NOWHERE, KEEP, FORMULA, REIMPORT]), (CHAINS, [COMMENTED, NO_ELSE]), (SECT, [SECTIONS]), (ACC, [COVERAGE]),
         (VALUES, [INTERNAL, DIVERGENT]), (EXP, [EXPORTS])]
ALL = " UNION ALL ".join(f"SELECT * FROM (WITH {ctes} {' UNION ALL '.join(bodies)})" for ctes, bodies in PARTS)

ORACLE = {
    "build_registry": p(f"WITH {REG} SELECT * FROM reg"),
    "rule_account_unreachable": p(f"WITH {REG} {UNREACHABLE}"),
    "rule_account_nowhere": p(f"WITH {REG} {NOWHERE}"),
    "rule_keep_undefined": p(f"WITH {REG} {KEEP}"),
    "rule_formula_undefined": p(f"WITH {REG} {FORMULA}"),
    "rule_self_reimport": p(f"WITH {CLEAN} {REIMPORT}"),
    "rule_map_else_commented": p(f"WITH {CHAINS} {COMMENTED}"),
    "rule_map_no_else": p(f"WITH {CHAINS} {NO_ELSE}"),
    "rule_section_missing": p(f"WITH {SECT} {SECTIONS}"),
    "rule_account_coverage": p(f"WITH {ACC} {COVERAGE}"),
    "rule_map_internal": p(f"WITH {VALUES} {INTERNAL}"),
    "rule_map_divergent": p(f"WITH {VALUES} {DIVERGENT}"),
    "rule_export_missing": p(f"WITH {EXP} {EXPORTS}"),
    "findings": p(f"WITH every AS ({ALL}) SELECT category, count(*) AS findings, count(DISTINCT program) AS programs FROM every GROUP BY category"),
    "findings_summary": p(f"""WITH every AS ({ALL}) SELECT severity, count(*) AS findings, count(DISTINCT program) AS programs,
      string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM every GROUP BY severity"""),
    "all_values_union": p(f"WITH {VALUES} SELECT filename, len({OTHER}) AS n_missing, len((SELECT vs FROM all_v)) AS n_known FROM v WHERE len(g) > 0 AND len({OTHER}) > 0"),
}
