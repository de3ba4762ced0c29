"""Lineage graph of a program corpus: nodes, edges, reachability, statistics."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.session import bucket_table, bucketed, buckets, stored

# The facts of a program that become edges, in the order nodes are first seen:
# fact, node type, relationship, whether the fact is the edge's source.
EDGE_FACTS = [
    ("datasets_read", "dataset", "reads", True),
    ("datasets_written", "dataset", "writes", False),
    ("macro_definitions", "macro", "defines", False),
    ("macro_calls", "macro", "calls", True),
    ("includes", "include", "includes", True),
]
#: Links (two numbers) that one task joins into flows at most; more go through rounds first.
FEW_LINKS = 2_000_000
#: Edges of a flow that one task walks over at most; a larger flow is walked over in rounds.
FLOW_EDGES = 1 << 18
#: Pairs of a start and a node of its flow that a walk marks at once.
CELLS = 1 << 22
#: Edges and starts, of whole flows, taken up at once.
TAKEN = 1 << 16


def _mentions(parsed: DataFrame) -> DataFrame:
    """One row per program and named thing: the program's node, the thing's node, kind and role."""
    present = [(i, *f) for i, f in enumerate([f for f in EDGE_FACTS if f[0] in parsed.columns], start=1)]
    facts = F.array(*[
        F.struct(F.lit(kind).alias("type"), F.lit(role).alias("relationship"), F.lit(inbound).alias("inbound"), F.lit(i).alias("rank"), F.col(fact).alias("named"))
        for i, fact, kind, role, inbound in present
    ])
    # lists are spread, not walked by lambdas, which Spark does not compile; the outer forms are those of `unnest`
    told = reduce(Column.__and__, [F.col(f[1]).isNotNull() for f in present])
    program = F.concat(F.lit("program:"), F.col("filename"))
    rows = parsed.select(program.alias("program"), "filename", F.inline_outer(F.when(told, facts)))
    kept = ["program", "filename", "type", "relationship", "inbound", "rank"]
    rows = rows.select(*kept, F.posexplode_outer("named").alias("_place", "label")).where("_place is not null")
    name = F.when(F.col("type") == "include", F.col("label")).otherwise(F.lower("label"))
    return rows.select(*kept, "label", F.concat("type", F.lit(":"), name).alias("node"))


def lineage_edges(parsed: DataFrame) -> DataFrame:
    rows = _mentions(parsed)
    return rows.select(
        F.when(F.col("inbound"), F.col("node")).otherwise(F.col("program")).alias("source"),
        F.when(F.col("inbound"), F.col("program")).otherwise(F.col("node")).alias("target"),
        "relationship",
    ).distinct()


def lineage_nodes(parsed: DataFrame) -> DataFrame:
    """Each node once; the label is the spelling met first by program, fact kind and name."""
    program = F.concat(F.lit("program:"), F.col("filename"))
    own = parsed.select(
        program.alias("id"), F.lit("program").alias("type"), F.struct(
            F.col("filename").alias("at"), F.lit(0).alias("rank"), F.col("filename").alias("label")).alias("first"))
    things = _mentions(parsed).select(
        F.col("node").alias("id"), "type", F.struct(F.col("filename").alias("at"), "rank", "label").alias("first"))
    merged = own.unionByName(things).groupBy("id", "type").agg(F.min("first").alias("first"))
    return merged.select("id", "type", F.col("first")["label"].alias("label"))


def _key(seed: int, way: str, name: str) -> Column:
    """A number for the name of a node on a way; none for no name."""
    return F.when(F.col(name).isNotNull(), F.xxhash64(F.lit(seed), F.lit(way), F.col(name)))


def _keyed(*named: tuple[str, DataFrame, str]) -> tuple[int, DataFrame]:
    """(seed, names): the first seed by which `_key` tells all names apart, and (key, way, id) of each.

    Names come as (way, table, column). Two names of one number are looked for, not hoped against.
    """
    ids = [df.select(F.lit(way).alias("way"), F.col(c).alias("id")) for way, df, c in named]
    names = stored(reduce(DataFrame.unionByName, ids).where("id is not null").distinct(), "names")
    ways = sorted({way for way, _, _ in named})
    for seed in count(1):
        key = reduce(lambda other, w: F.when(F.col("way") == w, _key(seed, w, "id")).otherwise(other), ways, F.lit(None).cast("bigint"))
        keyed = names.select(key.alias("key"), "way", "id")
        if keyed.groupBy("key").count().where("count > 1").isEmpty():
            return seed, keyed


def _rounds(ways: dict[str, tuple[DataFrame, DataFrame]], max_hops: int | None = None) -> DataFrame:
    """(way, start, node, hops): breadth first over the edges and from the starts of each way, all ways at once.

    Nodes are numbers on the way. Each round joins only the pairs found in the round before with the steps, which lie in
    buckets by their source, drops the pairs already known, which lie in buckets by the pair, and adds the rest to
    them: only the pairs of a round and what they reach are shuffled, neither the steps nor what is known. Cycles
    end, the plan of a round does not grow with the rounds before, and a lost executor costs at most one round.
    """
    seed, names = _keyed(*[x for w, (edges, starts) in ways.items() for x in ((w, edges, "source"), (w, edges, "target"), (w, starts, "node"))])
    spark = names.sparkSession
    steps = [e.select(_key(seed, w, "source").alias("source"), _key(seed, w, "target").alias("target")) for w, (e, _) in ways.items()]
    steps = reduce(DataFrame.unionByName, steps).where("source is not null").repartition(buckets(spark), "source").distinct()
    steps = bucketed(steps, "steps", "source")
    begun = stored(reduce(DataFrame.unionByName, [
        s.select(_key(seed, w, "node").alias("start"), F.lit(w).alias("way"), F.col("node").alias("named")).distinct() for w, (_, s) in ways.items()
    ]), "starts")
    at = lambda df, hop: df.select("start", "node", F.lit(hop).alias("hop"))
    table = bucket_table(at(begun.withColumn("node", F.col("start")), 0), "reached", "start", "node")
    known = lambda: spark.table(table)
    for hop in count(1):
        met = known().where(F.col("hop") == hop - 1).select("start", F.col("node").alias("source"))
        reached = steps.join(met, "source").select("start", F.col("target").alias("node")).distinct()
        new = reached.join(known().select("start", "node"), ["start", "node"], "left_anti")
        if max_hops is not None and hop > max_hops:
            if not new.isEmpty():
                warnings.warn(f"paths go on after max_hops={max_hops}; nodes beyond are left out", stacklevel=4)
            break
        bucket_table(at(new, hop), "reached", "start", "node", name=table)
        if known().where(F.col("hop") == hop).isEmpty():
            break
    found = known().where("hop > 0").join(begun, "start").join(names.select(F.col("key").alias("node"), "id"), "node", "left")
    return found.select("way", F.col("named").alias("start"), F.col("id").alias("node"), F.col("hop").alias("hops"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by `at`, in tables of about TAKEN rows that end where a value of `at` ends."""
    held, rows, due = [], 0, TAKEN
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < due:
            continue
        table = pa.Table.from_batches(held)
        at = table["at"].to_numpy()
        ends = np.flatnonzero(at[1:] != at[:-1])
        if len(ends):
            yield table.slice(0, ends[-1] + 1)
            table = table.slice(ends[-1] + 1)
        held, rows = table.to_batches(), len(table)
        due = max(TAKEN, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)


def _reached(first: np.ndarray, to: np.ndarray, begun: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start's place in `begun`, node, hops): breadth first along the edges from first[v] to first[v + 1] of `to`, from all starts at once.

    The cell of a start and a node is base[start] + node.
    """
    cells = int(base[-1])
    seen, last = np.zeros(cells, bool), np.empty(cells, np.int32)
    base = base[:-1]
    start, node = np.arange(len(begun)), begun
    seen[base + node] = True
    found: list[tuple[np.ndarray, ...]] = []
    for hop in count(1):
        many = first[node + 1] - first[node]
        ahead = np.cumsum(many)
        start = np.repeat(start, many)
        node = to[np.arange(len(start)) + np.repeat(first[node] - (ahead - many), many)]
        cell = base[start] + node
        new = np.flatnonzero(~seen[cell])
        cell = cell[new]
        place = np.arange(len(new), dtype=np.int32)
        last[cell] = place
        once = last[cell] == place
        new, cell = new[once], cell[once]
        if not len(new):
            break
        seen[cell] = True
        start, node = start[new], node[new]
        found.append((start.astype(np.int32), node.astype(np.int32), np.full(len(new), hop, np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int32),) * 3


def _within(cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (at, source, target), sorted by `at`, to (start, node, hops). A row without a target is a start."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            at = np.unique(table["at"].to_numpy(), return_inverse=True)[1]
            step = table["target"].is_valid().to_numpy()
            names = pa.concat_arrays([*table["source"].chunks, *table["target"].drop_null().chunks]).dictionary_encode()
            known = len(names.dictionary)
            # nodes are numbered flow by flow; a flow dealt out several times has its nodes in every part
            keys, numbers = np.unique(np.concatenate([at, at[step]]) * known + names.indices.to_numpy(), return_inverse=True)
            source, target = numbers[: len(at)], numbers[len(at) :]
            said = lambda v: names.dictionary.take(pa.array(keys[v] % known))
            order = np.argsort(source[step], kind="stable")
            to = target[order]
            first = np.concatenate([[0], np.cumsum(np.bincount(source[step], minlength=len(keys)))])
            begun = np.unique(source[~step])
            lowest = np.searchsorted(keys // known, np.arange(at[-1] + 2))
            flow = keys[begun] // known
            total = np.concatenate([[0], np.cumsum(lowest[flow + 1] - lowest[flow])])
            i = 0
            while i < len(begun):
                j = max(i + 1, int(np.searchsorted(total, total[i] + cells, "right")) - 1)
                base = np.concatenate([total[i:j] - total[i] - lowest[flow[i:j]], [total[j] - total[i]]])
                start, node, hops = _reached(first, to, begun[i:j], base)
                for k in range(0, len(start), TAKEN):
                    cut = slice(k, k + TAKEN)
                    yield pa.RecordBatch.from_arrays(
                        [said(begun[i:j][start[cut]]), said(node[cut]), pa.array(hops[cut])], ["start", "node", "hops"])
                i = j

    return walk


def _walk(ways: dict[str, tuple[DataFrame, DataFrame]], max_hops: int | None, flows: DataFrame | None = None) -> DataFrame:
    """(way, start, node, hops): breadth first over the edges and from the starts of each way.

    With flows (node, flow) that hold the edges' nodes, a flow of up to FLOW_EDGES edges is walked over by one task, or
    by several that share its starts where they may find many pairs; only edges and starts are shuffled. Larger flows,
    and walks with a bound or without flows, go in rounds over all executors.
    """
    if flows is None or max_hops is not None:
        return _rounds(ways, max_hops)
    placed = lambda df, c: df.join(flows.select(F.col("node").alias(c), "flow"), c)
    found = []
    for way, (edges, starts) in ways.items():
        steps = stored(placed(edges.select("source", "target").where("target is not null"), "source"), "walk-steps")
        begun = stored(placed(starts.select(F.col("node").alias("start")).distinct(), "start"), "walk-starts")
        n = lambda df, name: df.groupBy("flow").agg(F.count(F.lit(1)).alias(name))
        sizes = n(begun, "starts").join(n(steps, "steps"), "flow")
        # a connected flow has at most one node more than edges
        sizes = stored(sizes.withColumn("parts", F.ceil(F.col("starts") * (F.col("steps") + 1) / CELLS)), "walk-sizes")
        small, large = sizes.where(F.col("steps") <= FLOW_EDGES), sizes.where(F.col("steps") > FLOW_EDGES)
        # two parts of one number are walked over together, which finds the same
        at = lambda part: F.xxhash64("flow", part).alias("at")
        every = steps.join(small, "flow").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        rows = every.select(at("part"), "source", "target").unionByName(begun.join(small, "flow").select(
            at(F.pmod(F.xxhash64("start"), "parts")), F.col("start").alias("source"), F.lit(None).cast("string").alias("target")))
        dealt = rows.repartition(buckets(flows.sparkSession), "at").sortWithinPartitions("at")
        near = dealt.mapInArrow(_within(CELLS), "start string, node string, hops int")
        found.append(near.select(F.lit(way).alias("way"), "start", "node", "hops"))
        if not large.isEmpty():
            of = large.select("flow")
            found.append(_rounds({way: (steps.join(of, "flow"), begun.join(of, "flow").select(F.col("start").alias("node")))}))
    return reduce(DataFrame.unionByName, found)


def reachable(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops): what each start (column node) reaches along source -> target, in at most `max_hops` steps if given.

    Without max_hops it ends where nothing new is found; a bound that leaves paths unfollowed is warned of.
    """
    return _walk({"on": (edges, starts)}, max_hops).drop("way")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def downstream(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, flows: DataFrame | None = None) -> DataFrame:
    """Descendants of each start, the start itself left out; quicker with the `lineage_flows` of the edges' nodes."""
    return _walk({"on": (edges, starts)}, max_hops, flows).drop("way").where("node <> start")


def upstream(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, flows: DataFrame | None = None) -> DataFrame:
    """Ancestors of each start, the start itself left out; quicker with the `lineage_flows` of the edges' nodes."""
    return downstream(_turned(edges), starts, max_hops, flows)


def lineage_closure(
    edges: DataFrame, starts: DataFrame | None = None, max_hops: int | None = None, flows: DataFrame | None = None
) -> DataFrame:
    """(start, node, direction, hops): all that the starts depend on and all that depends on them; of every node if no starts are given.

    What every node depends on is what depends on every node, told the other way round: one walk, one way.
    """
    if starts is None:
        pairs = _walk({"on": (edges, edges.select(F.col("source").alias("node")))}, max_hops, flows).where("node <> start")
        told = lambda start, node, way: F.struct(
            F.col(start).alias("start"), F.col(node).alias("node"), F.lit(way).alias("direction"), F.col("hops").alias("hops"))
        return pairs.select(F.inline(F.array(told("start", "node", "downstream"), told("node", "start", "upstream"))))
    ways = {"upstream": (_turned(edges), starts), "downstream": (edges, starts)}
    walked = _walk(ways, max_hops, flows).where("node <> start")
    return walked.select("start", "node", F.col("way").alias("direction"), "hops")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, over all links (a, b) in one task: (a, to), every node and the least number it is connected with."""
    read = [(x["a"].to_numpy(), x["b"].to_numpy()) for x in batches]
    if not read:
        return
    a, b = (np.concatenate(x) for x in zip(*read))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, to = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := to[to], to):
            to = further
        x, y = to[x], to[y]
        x, y = x[x != y], y[x != y]
    for k in range(0, len(nodes), TAKEN):
        cut = slice(k, k + TAKEN)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[cut]), pa.array(nodes[to[cut]])], ["a", "to"])


def lineage_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, flow): the connected flow a node belongs to, named by its smallest node; a node without edges is its own.

    Nodes are numbers in no order. In a round every node goes over to the least number among itself and its neighbours, and links
    become links of those they went to, numbered anew: both the nodes and the links left shrink by a
    share in every round, so all rounds together move a small multiple of the edges. A round is two aggregations
    joined back to the links: a node with a third of all edges is met by partial aggregates, and its links may be split.
    At most FEW_LINKS links are left to one task, which ends the rounds.
    """
    links = edges.where("source <> target")
    seed, names = _keyed(("", nodes, "id"), ("", links, "source"), ("", links, "target"))
    pair = lambda df, x, y: stored(df.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "flow-links")
    # of a number alone this hash is one to one, so numbering anew keeps nodes apart
    anew = lambda c: F.xxhash64(F.col(c))
    now, rounds = pair(links, _key(seed, "", "source"), _key(seed, "", "target")), []
    while left := now.count():
        if left <= FEW_LINKS:
            rounds.append(stored(now.coalesce(1).mapInArrow(_joined, "a long, to long"), "flow-round"))
            now = stored(now.where("false"), "flow-links")
            continue
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        went = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "flow-round")
        rounds.append(went)
        side = lambda c: went.select(F.col("a").alias(c), anew("to").alias(f"to_{c}"))
        moved = now.join(side("a"), "a").join(side("b"), "b").where("to_a <> to_b")
        now = pair(moved, F.col("to_a"), F.col("to_b"))
    own = nodes.select(F.col("id").alias("node"))
    if not rounds:
        return own.withColumn("flow", F.col("node"))
    flows = None
    for i, went in reversed(list(enumerate(rounds))):
        # a flow is told by the round that left it one node, and that node's number there
        here = went.select("a", anew("to").alias("end"), F.lit(i).alias("round"))
        if flows is not None:
            on = flows.select(F.col("a").alias("end"), F.col("round").alias("later"), F.col("end").alias("last"))
            here = here.join(on, "end", "left").select("a", F.coalesce("last", "end").alias("end"), F.coalesce("later", "round").alias("round"))
        flows = stored(here, "flow-ends")
    members = stored(names.join(flows, names["key"] == flows["a"]).select("id", "end", "round"), "flow-members")
    least = members.groupBy("end", "round").agg(F.min("id").alias("flow"))
    named = members.join(least, ["end", "round"]).select(F.col("id").alias("node"), "flow")
    return own.join(named, "node", "left").select("node", F.coalesce("flow", "node").alias("flow"))


def flow_ends(nodes: DataFrame, edges: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """(flow, nodes, head, tail): a flow's size, its first root and first leaf; its smallest node where it has none (a cycle).

    `flows` are the `lineage_flows` of the same graph, if they are at hand.
    """
    flows = stored(lineage_flows(nodes, edges), "flows") if flows is None else flows
    marked = flows.join(_ends_counted(edges).withColumnRenamed("id", "node"), "node", "left").withColumns({
        "root": F.coalesce("in_degree", F.lit(0)) == 0, "leaf": F.coalesce("out_degree", F.lit(0)) == 0})
    first = lambda flag: F.coalesce(F.min(F.when(F.col(flag), F.col("node"))), F.min("node"))
    return marked.groupBy("flow").agg(F.count(F.lit(1)).alias("nodes"), first("root").alias("head"), first("leaf").alias("tail"))


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """The k nodes with the most edges, ties by name: (node, degree)."""
    total = (F.col("in_degree") + F.col("out_degree")).alias("degree")
    return degree(nodes, edges).select(F.col("id").alias("node"), total).orderBy(F.desc("degree"), "node").limit(k)


def _ends(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    return nodes.join(edges.select(F.col(side).alias("id")).distinct(), "id", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _ends(nodes, edges, "target")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _ends(nodes, edges, "source")


def roots_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    role = lambda df, name: df.select("id", "type", F.lit(name).alias("role"))
    return role(roots(nodes, edges), "root").unionByName(role(leaves(nodes, edges), "leaf"))


def leaf_outputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return leaves(nodes, edges).select("label", "type").orderBy("label", "type")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (measure, value): nodes per type, all nodes, all edges."""
    per_type = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("nodes:"), F.col("type")).alias("measure"), "value")
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("measure"), "value")
    return per_type.unionByName(total(nodes, "nodes")).unionByName(total(edges, "edges"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


def _ends_counted(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of the nodes that have edges."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(
        edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node."""
    return nodes.select("id").join(_ends_counted(edges), "id", "left").select(
        "id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def program_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Things each program takes in and gives out, and programs that read what it gives out, most first.

    One step on either side: as long as the edges. `reachable` follows the programs that matter further.
    """
    is_program = lambda c: F.col(c).startswith("program:")
    count = F.count(F.lit(1))
    ins = edges.where(is_program("target")).select(F.col("target").alias("id"), "source").distinct()
    outs = edges.where(is_program("source")).select(F.col("source").alias("id"), F.col("target").alias("thing")).distinct()
    readers = edges.where(is_program("target")).groupBy(F.col("source").alias("thing")).agg(F.count_distinct("target").alias("readers"))
    given = outs.join(readers, "thing", "left").groupBy("id").agg(count.alias("downstream"), F.sum(F.coalesce("readers", F.lit(0))).alias("readers"))
    taken = ins.groupBy("id").agg(count.alias("upstream"))
    programs = nodes.where("type = 'program'").select("id", "label")
    filled = programs.join(taken, "id", "left").join(given, "id", "left").fillna(0, ["upstream", "downstream", "readers"])
    return filled.select(
        "label", "upstream", "downstream", "readers", (F.col("upstream") + F.col("downstream")).alias("total")
    ).orderBy(F.desc("total"), "label")
