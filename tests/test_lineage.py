"""Connected flows and walks over them, against plain versions."""

import random

import pytest

from ledgerlift.checks import lineage as checks
from ledgerlift.operators import lineage as L

SF = "/root/testdata/sf0.001"


def flows_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def frames(spark, nodes, edges):
    return (
        spark.createDataFrame([(n, "dataset", n) for n in nodes], "id string, type string, label string"),
        spark.createDataFrame([(a, b, "reads") for a, b in edges], "source string, target string, relationship string"),
    )


def graph(seed):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(60)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.choice([20, 45]))]
    edges += [("n001", "n001"), edges[0], edges[0][::-1]]  # a self loop, a repeated edge, a cycle
    if seed == 2:
        edges = [(nodes[i], nodes[i + 1]) for i in range(59)]  # one long chain
    if seed == 3:
        edges = [(n, "n030") for n in nodes if n != "n030"]  # one node with all edges
    return nodes, edges


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_flows_are_the_connected_parts(spark, seed):
    nodes, edges = graph(seed)
    got = {r.node: r.flow for r in L.lineage_flows(*frames(spark, nodes, edges)).collect()}
    assert got == flows_of(nodes, edges)


def test_flow_ends(spark):
    nodes, edges = list("abcdefgh"), [("b", "a"), ("a", "c"), ("d", "e"), ("e", "d"), ("f", "f")]
    got = {tuple(r) for r in L.flow_ends(*frames(spark, nodes, edges)).collect()}
    # a cycle has no ends: its smallest node stands in
    assert got == {("a", 3, "b", "c"), ("d", 2, "d", "d"), ("f", 1, "f", "f"), ("g", 1, "g", "g"), ("h", 1, "h", "h")}
    assert L.flow_ends(*frames(spark, [], [])).count() == 0


def test_flows_of_a_corpus_whose_programs_share_datasets(spark):
    parsed = checks._corpus(spark, SF)
    nodes, edges = L.lineage_nodes(parsed), L.lineage_edges(parsed)
    want = flows_of([r.id for r in nodes.collect()], [(r.source, r.target) for r in edges.collect()])
    assert {r.node: r.flow for r in L.lineage_flows(nodes, edges).collect()} == want


def test_closure_walks_both_ways_at_once(spark):
    nodes, edges = frames(spark, list("abcd"), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    starts = spark.createDataFrame([("a",), ("d",), ("zz",)], "node string")
    got = {tuple(r) for r in L.lineage_closure(edges, starts).collect()}
    assert got == {
        ("a", "b", "downstream", 1), ("a", "c", "downstream", 2), ("a", "d", "downstream", 3), ("a", "c", "upstream", 1), ("a", "b", "upstream", 2),
        ("d", "c", "upstream", 1), ("d", "b", "upstream", 2), ("d", "a", "upstream", 3),
    }
    assert got == {tuple(r) for r in L.upstream(edges, starts).selectExpr("start", "node", "'upstream'", "hops").collect()} | {
        tuple(r) for r in L.downstream(edges, starts).selectExpr("start", "node", "'downstream'", "hops").collect()}


def test_links_shrink_from_round_to_round(spark, monkeypatch):
    nodes = [f"n{i:03d}" for i in range(300)]
    sizes, stored = [], L.stored

    def counted(df, label):
        out = stored(df, label)
        if label == "flow-links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(L, "stored", counted)
    edges = list(zip(nodes, nodes[1:]))
    assert {r.flow for r in L.lineage_flows(*frames(spark, nodes, edges)).collect()} == {"n000"}
    assert sizes[0] == 299 and sizes[-1] == 0 and sum(sizes) < 4 * 299


def test_two_names_of_one_number_are_told_apart(spark, monkeypatch):
    key = L._key
    monkeypatch.setattr(L, "_key", lambda seed, way, name: L.F.lit(7).cast("bigint") if seed == 1 else key(seed, way, name))
    nodes, edges = frames(spark, list("abcd"), [("a", "b"), ("b", "c")])
    assert {tuple(r) for r in L.lineage_flows(nodes, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    starts = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in L.downstream(edges, starts).collect()} == {("a", "b", 1), ("a", "c", 2)}


def test_rounds_shuffle_neither_steps_nor_known_pairs(spark, monkeypatch):
    plans, write = [], L.bucket_table

    def kept(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args, **kw)

    monkeypatch.setattr(L, "bucket_table", kept)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, edges = frames(spark, list("abc"), [("a", "b"), ("b", "c")])
        L.reachable(edges, spark.createDataFrame([("a",)], "node string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rounds = [p for p in plans if "LeftAnti" in p]
    assert rounds and all(p.count("Bucketed: true") >= 2 and p.count("Exchange hashpartitioning") == 2 for p in rounds)


def walked(edges, starts):
    """(start, node): steps of the shortest way from the start to another node."""
    after, out = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for s in starts:
        hops, now = {s: 0}, [s]
        while now:
            now = [hops.setdefault(b, hops[a] + 1) and b for a in now for b in sorted(after.get(a, ())) if b not in hops]
        out |= {(s, n): h for n, h in hops.items() if n != s}
    return out


def hops_of(df):
    rows = [((r.start, r.node), r.hops) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("seed, limits", [
    (0, {}), (0, {"CELLS": 7, "TAKEN": 3}), (0, {"FLOW_EDGES": 4, "FEW_LINKS": 5}), (1, {"FLOW_EDGES": 0, "FEW_LINKS": 0}),
    (2, {"CELLS": 7, "TAKEN": 3}), (3, {"CELLS": 7, "TAKEN": 3}),
])
def test_walks_within_flows_find_what_plain_walks_find(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(L, name, value)
    names, pairs = graph(seed)
    nodes, edges = frames(spark, names, pairs)
    flows = L.stored(L.lineage_flows(nodes, edges), "flows")
    assert {r.node: r.flow for r in flows.collect()} == flows_of(names, pairs)
    some = names[::7]
    starts = spark.createDataFrame([(n,) for n in [*some, some[0], "zz", None]], "node string")
    assert hops_of(L.downstream(edges, starts, flows=flows)) == walked(pairs, some)
    if seed in (0, 3):
        assert hops_of(L.upstream(edges, starts, flows=flows)) == walked([p[::-1] for p in pairs], some)


def test_closure_without_starts_is_that_of_every_node(spark):
    names, pairs = graph(0)
    nodes, edges = frames(spark, names, [*pairs, (None, "n002"), ("n002", None)])
    down, up = walked(pairs, names), walked([p[::-1] for p in pairs], names)
    for flows in (None, L.lineage_flows(nodes, edges)):
        got = L.lineage_closure(edges, flows=flows)
        assert hops_of(got.where("direction = 'downstream'")) == down and hops_of(got.where("direction = 'upstream'")) == up
    with pytest.warns(UserWarning, match="max_hops=1"):
        near = L.lineage_closure(edges, max_hops=1, flows=flows)
    assert hops_of(near.where("direction = 'upstream'")) == {k: h for k, h in up.items() if h == 1}


@pytest.fixture
def orders(spark, tmp_path):
    """A folder with a table of orders: one flow of a chain, one with a cycle."""
    rows = [(i, c) for i, c in enumerate([10, 11, 12, 12, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9])]
    df = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").selectExpr(
        "*", "'O' AS o_orderstatus", "1e0 AS o_totalprice", "timestamp_ntz '1998-01-01' AS o_orderdate", "'1' AS o_orderpriority")
    df.write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_registered_closure_leaves_no_node_out(spark, orders):
    pairs = [(r.source, r.target) for r in checks.QUERIES["lineage_edges"](spark, orders).collect()]
    names = {n for p in pairs for n in p}
    got = checks.QUERIES["lineage_closure"](spark, orders)
    assert hops_of(got.where("direction = 'downstream'")) == walked(pairs, names)
    assert hops_of(got.where("direction = 'upstream'")) == walked([p[::-1] for p in pairs], names)


@pytest.mark.parametrize("name", ["downstream", "upstream", "lineage_closure"])
def test_registered_walks_take_no_round_per_hop(spark, orders, monkeypatch, name):
    written, bucket_table = [], L.bucket_table
    monkeypatch.setattr(L, "bucket_table", lambda *args, **kw: written.append(args[1]) or bucket_table(*args, **kw))
    assert checks.QUERIES[name](spark, orders).count() > 20
    assert written == []  # one table per hop before


def test_mentions_of_lists_with_gaps(spark):
    rows = [("p1", ["A", None, "a"], ["B"], ["/x/Y"]), ("p2", [], ["C"], []), ("p3", None, ["D"], ["z"])]
    parsed = spark.createDataFrame(rows, "filename string, datasets_read array<string>, datasets_written array<string>, includes array<string>")
    got = {tuple(r) for r in L.lineage_edges(parsed).collect()}
    assert got == {
        ("dataset:a", "program:p1", "reads"), (None, "program:p1", "reads"), ("program:p1", "dataset:b", "writes"),
        ("include:/x/Y", "program:p1", "includes"), ("program:p2", "dataset:c", "writes"),
    }  # a program that lacks a whole list has none
    nodes = {(r.id, r.type, r.label) for r in L.lineage_nodes(parsed).collect() if r.type == "dataset"}
    assert nodes == {("dataset:a", "dataset", "A"), ("dataset:b", "dataset", "B"), ("dataset:c", "dataset", "C"), (None, "dataset", None)}
