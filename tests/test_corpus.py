import pytest
from pyspark.sql import functions as F

from ledgerlift.operators import corpus as C
from ledgerlift.operators import lineage as L
from ledgerlift.operators import rules as R
from ledgerlift.operators import scoring as S

PROGRAM = """/* first
   note: set ghost */
LIBNAME in '/x';
%MACRO go(a); %MEND go;
%go(1);
DATA work.one two (keep=id C1234567);
  SET in.src;
  C1234567 = a + 1;
  FORMAT when DDMMYY10.;
RUN;
* remark with ; DATA work.mid; SET work.one; val = C1234567; RUN;
DATA work.last; SET work.mid;
  KEEP C1234567 C7654321;
RUN;
PROC SQL; CREATE TABLE work.t AS SELECT x AS y FROM in.z; QUIT;
PROC SORT DATA=work.t; RUN;
"""


def programs(spark, *texts):
    return spark.createDataFrame([(i, f"p{i}.sas", t) for i, t in enumerate(texts)], "program_id int, filename string, content string")


def test_facts(spark):
    row = C.parse_programs(programs(spark, PROGRAM)).first()
    assert row["data_steps"][:2] == ["work.one", "two"] and row["data_steps"][-2:] == ["work.mid", "work.last"]
    assert row["procs_used"] == ["SORT", "SQL"]
    assert row["macro_definitions"] == ["go"] and row["macro_calls"] == ["go"]
    assert "ghost" in row["datasets_read"] and "in.z" in row["datasets_read"]
    assert [tuple(x) for x in row["libnames"]] == [("IN", "/x")]
    assert row["line_count"] == PROGRAM.count("\n")


def test_clean_mode_ignores_comments(spark):
    row = C.extract(programs(spark, PROGRAM), "datasets_read", clean=True).first()
    assert "ghost" not in row["datasets_read"] and "in.src" in row["datasets_read"]


def test_comments_keep_their_lines(spark):
    text = C.with_clean(programs(spark, PROGRAM)).first()["clean"]
    assert text.count("\n") == PROGRAM.count("\n") and "note" not in text and "remark" not in text


def test_step_scopes_lines_and_variables(spark):
    steps = {r["target"]: r for r in C.steps_table(programs(spark, PROGRAM)).collect()}
    assert steps["WORK.ONE"]["start_line"] == 6 and steps["WORK.ONE"]["keep_vars"] == ["C1234567", "ID"]
    assert steps["WORK.ONE"]["defined"] == ["C1234567", "WHEN"]
    assert steps["WORK.LAST"]["start_line"] == 12 and steps["WORK.LAST"]["set_sources"] == ["WORK.MID"]


def test_registry_follows_set_chains_in_order(spark):
    known = {}
    for r in R.registry_table(programs(spark, PROGRAM)).collect():
        known.setdefault(r["dataset"], set()).add(r["variable"])
    assert known["WORK.MID"] == known["WORK.LAST"] == {"C1234567", "WHEN"}
    assert known["WORK.T"] == {"Y"}


def test_later_step_replaces_and_earlier_cannot_inherit(spark):
    text = "DATA b; SET a;\n x = 1;\nRUN;\nDATA a;\n y = 2;\nRUN;\nDATA a;\n z = 3;\nRUN;\n"
    got = {(r["dataset"], r["variable"]) for r in R.registry_table(programs(spark, text)).collect()}
    assert got == {("B", "X"), ("A", "Z")}


def test_undefined_account_in_keep(spark):
    found = {(r["category"], r["subject"]) for r in R.program_findings(programs(spark, PROGRAM)).collect()}
    assert ("VARIAVEL_CONTABIL_INEXISTENTE", "C7654321") in found
    assert ("KEEP_VARIAVEL_INDEFINIDA", "C7654321") in found
    assert not any(s == "C1234567" and c == "KEEP_VARIAVEL_INDEFINIDA" for c, s in found)


def test_else_found_commented_or_absent(spark):
    chain = 'IF cod_sistema_origem = "A" THEN t = "1";\nELSE IF cod_sistema_origem = "B" THEN t = "2";\n'
    df = programs(spark, chain + 'ELSE t = "3";\n', chain + '/* ELSE t = "3"; */\n', chain)
    got = {(r["program"], r["category"], r["line"]) for r in R.program_findings(df).collect()}
    assert got == {("p1.sas", "MAPEAMENTO_ELSE_COMENTADO", 3), ("p2.sas", "MAPEAMENTO_SEM_ELSE", 1)}
    strict = R.prepare(df).select("filename", F.size(R.map_no_else(strict=True)).alias("n"))
    assert {r["filename"]: r["n"] for r in strict.collect()} == {"p0.sas": 0, "p1.sas": 1, "p2.sas": 1}


def test_empty_program_scores_the_floor(spark):
    row = S.complexity(C.parse_programs(programs(spark, "/* empty file */\n"))).first()
    assert (row["plp"], row["pdi"], row["pvd"], row["prs"], row["complexity_level"]) == (1, 1, 1, 1, "LOW")


def test_single_program_lineage(spark):
    parsed = spark.createDataFrame([("p.sas", ["a"], ["B"])], "filename string, datasets_read array<string>, datasets_written array<string>")
    assert L.lineage_nodes(parsed).count() == 3 and L.lineage_edges(parsed).count() == 2


def test_reachability_on_a_cycle_matches_a_walk(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    got = {(r["start"], r["node"]) for r in L.reachable(edges, edges.selectExpr("source node"), 9).where("start <> node").collect()}
    want = {(s, t) for s in "abc" for t in "abcd" if s != t}
    assert got == want


def test_reachability_has_no_bound_unless_given(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(44)], "source string, target string")
    starts = spark.createDataFrame([("n0",)], "node string")
    assert L.reachable(edges.where("source in ('n0', 'n1')"), starts).count() == 2
    with pytest.warns(UserWarning, match="max_hops=1"):
        assert L.reachable(edges, starts, 1).count() == 1


def test_program_impact_counts(spark):
    parsed = spark.createDataFrame(
        [("p1", ["a"], ["b"]), ("p2", ["b"], ["c"]), ("p3", ["b"], ["a"])],
        "filename string, datasets_read array<string>, datasets_written array<string>")
    impact = L.program_impact(L.lineage_nodes(parsed), L.lineage_edges(parsed))
    got = {r["label"]: (r["upstream"], r["downstream"], r["readers"], r["total"]) for r in impact.collect()}
    assert got == {"p1": (1, 1, 2, 2), "p2": (1, 1, 0, 2), "p3": (1, 1, 1, 2)}


def test_closure_of_given_starts_stops_after_the_hops_asked_for(spark):
    parsed = spark.createDataFrame(
        [("p1", ["a"], ["b"]), ("p2", ["b", "x"], ["c", "d"]), ("p3", ["c"], ["a"]), ("p4", ["d"], ["e"])],
        "filename string, datasets_read array<string>, datasets_written array<string>")
    edges = L.lineage_edges(parsed)
    starts = spark.createDataFrame([("dataset:b",)], "node string")
    got = {(r["node"], r["direction"], r["hops"]) for r in L.lineage_closure(edges, starts, 2).collect()}
    assert got == {("program:p1", "upstream", 1), ("dataset:a", "upstream", 2), ("program:p2", "downstream", 1),
                   ("dataset:c", "downstream", 2), ("dataset:d", "downstream", 2)}
    whole = L.downstream(edges, starts, 99)
    assert {r["node"] for r in whole.collect()} == {f"program:p{i}" for i in (1, 2, 3, 4)} | {f"dataset:{c}" for c in "acde"}


def test_section_of_a_mapping_is_the_last_one_named(spark):
    line = 'IF cod_sistema_origem = "{}" THEN t = "1";\n'
    text = line.format("A") + "/* ACEITO */\n" + "x = 1;\n" * 200 + line.format("B") + "/* resumo */\n" + line.format("C")
    got = [(r["src_val"], r["line"], r["section"]) for r in C.value_maps_table(programs(spark, text)).orderBy("line").collect()]
    assert got == [("A", 1, "geral"), ("B", 203, "aceito"), ("C", 205, "resumo")]


def test_else_is_looked_for_to_the_end_of_the_step(spark):
    chain = 'DATA a; SET b;\nIF cod_sistema_origem = "A" THEN t = "1";\n'
    df = programs(spark, chain + "x = 1;\n" * 30 + 'ELSE t = "3";\nRUN;\n', chain + 'RUN;\nDATA c;\nELSE t = "3";\nRUN;\n')
    got = {(r["program"], r["category"]) for r in R.program_findings(df, ["MAPEAMENTO_SEM_ELSE"]).collect()}
    assert got == {("p1.sas", "MAPEAMENTO_SEM_ELSE")}


def test_aliases_of_an_unfinished_create_are_all_found(spark):
    text = "PROC SQL; CREATE TABLE w.t AS SELECT " + ", ".join(f"c{i} AS a{i}" for i in range(400))
    row = C.sql_creates_table(programs(spark, text)).first()
    assert len(row["aliases"]) == 400


def test_findings_say_what_they_mean_and_what_to_do(spark):
    rows = R.find_all(programs(spark, PROGRAM)).collect()
    assert rows and all(r["impact"] and r["recommendation"] for r in rows)
