import random
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators import joins as J
from ledgerlift.operators import ordering as O
from ledgerlift.operators import procs as P
from ledgerlift.operators import reshape as H


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_running_total_with_a_hot_key_matches_a_plain_loop(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, i int, w int").repartition(7)
    want, run = set(), {}
    for k, i, w in sorted(data, key=lambda r: (r[0], r[1])):
        run[k] = run.get(k, 0) + w
        want.add((k, i, w, run[k]))
    assert {tuple(r) for r in O.running_total(df, ["k"], ["i"], "w", "t").collect()} == want


def test_row_numbers_with_missing_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, i int")
    assert rows(O.row_numbers(df, ["k"], ["i"])) == [("a", 2, 1), (None, 1, 1), (None, 3, 2)]


def test_percentiles_match_brute_force(spark):
    rng = random.Random(5)
    data = [rng.randrange(50) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in data], "v int")
    got = O.percentiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert list(got) == quantiles(data, n=4, method="inclusive")


def test_averaged_percentile_at_a_jump(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    assert O.percentiles(df, [], "v", {"m": 0.5, "q": 0.3}, "averaged").first()[:] == (2.5, 2.0)


def test_merge_pairs_rows_by_position_and_repeats_the_last(spark):
    a = spark.createDataFrame([("k", 1, "a1"), ("k", 2, "a2"), ("k", 3, "a3"), ("l", 1, "a4")], "k string, i int, s string")
    b = spark.createDataFrame([("k", 1, "b1", 10), ("k", 2, "b2", 20), ("m", 1, "b3", 30)], "k string, j int, s string, v int")
    got = rows(J.merge_by(a, b, ["k"], "any", (["i"], ["j"])).select("k", "i", "s", "j", "v", "in_a", "in_b"))
    assert got == sorted([
        ("k", 1, "b1", 1, 10, True, True), ("k", 2, "b2", 2, 20, True, True), ("k", 3, "a3", 2, 20, True, True),
        ("l", 1, "a4", None, None, True, False), ("m", None, "b3", 1, 30, False, True)], key=str)


def test_missing_keys_join_only_when_asked(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(None, "n"), (2, "t")], "k int, w string")
    assert rows(J.lookup_join(a, b, ["k"])) == [(2, 2, "t"), (None, 1, "n")]
    assert rows(J.lookup_join(a, b, ["k"], null_safe=False)) == [(2, 2, "t"), (None, 1, None)]


def test_first_last_and_nodupkey(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 7)], "k string, i int")
    assert rows(O.first_last(df, ["k"], ["i"])) == [("a", 1, 1, 0), ("a", 2, 0, 1), ("b", 5, 1, 1), (None, 7, 1, 1)]
    assert rows(O.nodupkey(df, ["k"], ["i"])) == [("a", 1), ("b", 5), (None, 7)]


def test_freq_cumulative(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    got = {r["k"]: (r["frequency"], r["percent"], r["cum_frequency"]) for r in P.freq(df, ["k"], cumulative=True).collect()}
    assert got == {None: (1, 25.0, 1), "a": (1, 25.0, 2), "b": (2, 50.0, 4)}


def test_coverage_gaps_count_and_name_what_is_missing(spark):
    data = [(f"e{i % 7}", f"v{i * i % 23}") for i in range(60)]
    df = spark.createDataFrame(data, "e string, v string")
    every = {v for _, v in data}
    own = {e: {b for a, b in data if a == e} for e, _ in data}
    got = {tuple(r) for r in H.coverage_gaps(df, "e", "v").collect()}
    assert got == {(e, len(every - have), len(every)) for e, have in own.items() if every - have}
    assert {r[0] for r in H.missing_values(df, "e", "v", "e3").collect()} == every - own["e3"]
    universe = {tuple(r) for r in H.coverage_universe(df, "v", "e").collect()}
    assert universe == {(v, sum(v in have for have in own.values())) for v in every}


def test_value_list(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string")
    assert rows(P.value_list(df, "k")) == [(1, "a"), (2, "b")]


def test_merge_with_a_hot_key(spark):
    data = [("hot" if i % 10 else f"k{i}", i, i * 2) for i in range(2000)]
    left = spark.createDataFrame(data, "k string, i int, s int")
    right = spark.createDataFrame([("hot", 7, -1), ("k10", 8, -2), ("only b", 9, -3), (None, 5, -4)], "k string, w int, s int")
    value = {"hot": (7, -1), "k10": (8, -2), "only b": (9, -3), None: (5, -4)}
    both = {(k, i, value[k][1], value[k][0], True, True) for k, i, _ in data if k in value}
    alone = {(k, i, s, None, True, False) for k, i, s in data if k not in value}
    late = {(k, None, value[k][1], value[k][0], False, True) for k in ("only b", None)}
    want = {"any": both | alone | late, "a": both | alone, "b": both | late, "ab": both}
    for keep, expected in want.items():
        out = J.merge_by(left, right, ["k"], keep).select("k", "i", "s", "w", "in_a", "in_b")
        assert {tuple(r) for r in out.collect()} == expected, keep
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FullOuter" not in plan and "RightOuter" not in plan


def test_merge_refuses_several_right_rows_of_a_key(spark):
    left = spark.createDataFrame([("a", 1)], "k string, i int")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int")
    with pytest.raises(Exception, match="several rows of one key"):
        J.merge_by(left, right, ["k"], "a").collect()


def test_order_check_names_tied_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, i int")
    assert rows(O.check_order(df, ["k"], ["i"])) == [("a", 1, 2)]


def test_sketched_quantiles_are_within_their_error(spark):
    df = spark.range(1, 20001).select((F.col("id") * 7919 % 20011).alias("v"))
    exact = sorted(r[0] for r in df.collect())
    got = P.approx_quantiles(df, ["v"], [0.25, 0.5, 0.75], 0.01).first()
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        place = sum(v <= got[name] for v in exact) / len(exact)
        assert abs(place - p) <= 0.01


def test_library_checks_name_what_differs(spark):
    from ledgerlift.operators import reconcile as V

    cols = "dataset_name string, name string, type string"
    want = spark.createDataFrame([("t", "A", "num"), ("t", "b", "char"), ("t", "c", None), ("gone", "x", "num")], cols)
    have = spark.createDataFrame([("t", "a", "num"), ("t", "B", "num"), ("t", "c", None), ("t", "d", "num"), ("new", "x", "num")], cols)
    got = {tuple(r) for r in V.check_schemas(want, have).collect()}
    assert got == {
        ("t", "schema", "", 3.0, 4.0, "FAIL"), ("gone", "schema", "", 1.0, 0.0, "FAIL"), ("new", "schema", "", 0.0, 1.0, "FAIL"),
        ("t", "schema_type", "b", 1.0, 1.0, "FAIL"), ("t", "schema_extra", "d", 0.0, 1.0, "FAIL"), ("gone", "schema_missing", "x", 1.0, 0.0, "FAIL"),
        ("new", "schema_extra", "x", 0.0, 1.0, "FAIL"),
    }
    counts = "dataset_name string, row_count long"
    known = spark.createDataFrame([("t", 5), ("u", 5), ("v", -1), ("w", None), ("gone", 1)], counts)
    loaded = spark.createDataFrame([("t", 5), ("u", 4), ("v", 7), ("w", 8)], counts)
    assert {(r.dataset, r.expected, r.actual, r.status) for r in V.check_row_counts(known, loaded).collect()} == {
        ("t", 5.0, 5.0, "PASS"), ("u", 5.0, 4.0, "FAIL"), ("v", None, 7.0, "UNKNOWN"), ("w", None, 8.0, "UNKNOWN"), ("gone", 1.0, None, "FAIL")}
    assert {(r.dataset, r.status) for r in V.check_tables(known, loaded).collect()} == {
        ("t", "PASS"), ("u", "PASS"), ("v", "PASS"), ("w", "PASS"), ("gone", "WARNING")}
    assert V.reconcile_library(known, want, loaded, have).count() == 17
