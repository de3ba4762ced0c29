"""Lineage graph of the order flows and of the program corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.checks.corpus import READS, STEPS_LIST, MACROS, ex, srt, trim_all
from ledgerlift.operators import corpus as C
from ledgerlift.operators import lineage as L
from ledgerlift.plans.views import view, with_views
from ledgerlift.session import stored


def _flows(s, d):
    v = view(s, d, "lineage_input")
    return v.select("filename", F.array("ds_read").alias("datasets_read"), F.array("ds_written").alias("datasets_written"))


def _graph(s, d):
    parsed = _flows(s, d)
    return L.lineage_nodes(parsed), L.lineage_edges(parsed)


def _corpus(s, d):
    fields = ["datasets_read", "datasets_written", "macro_definitions", "macro_calls", "includes"]
    return C.extract(view(s, d, "programs"), *fields).drop("content")


def _with_flows(s, d):
    """(nodes, edges, flows) of the graph, each written once; of the nodes only the names."""
    nodes, edges = _graph(s, d)
    nodes, edges = stored(nodes.select("id"), "graph"), stored(edges, "graph")
    return nodes, edges, stored(L.lineage_flows(nodes, edges), "flows")


def _walk(s, d, end, walk):
    """`walk` over the graph from one node of each connected flow: its head or its tail."""
    nodes, edges, flows = _with_flows(s, d)
    starts = stored(L.flow_ends(nodes, edges, flows).select(F.col(end).alias("node")), "starts")
    return walk(edges, starts, flows=flows)


def _closure(s, d):
    """The closure of every node."""
    _, edges, flows = _with_flows(s, d)
    return L.lineage_closure(edges, flows=flows)


QUERIES = {
    "lineage_nodes": lambda s, d: _graph(s, d)[0],
    "lineage_edges": lambda s, d: _graph(s, d)[1],
    "lineage_nodes_corpus": lambda s, d: L.lineage_nodes(_corpus(s, d)),
    "lineage_edges_corpus": lambda s, d: L.lineage_edges(_corpus(s, d)),
    "upstream": lambda s, d: _walk(s, d, "tail", L.upstream),
    "downstream": lambda s, d: _walk(s, d, "head", L.downstream),
    "lineage_closure": _closure,
    "roots_leaves": lambda s, d: L.roots_leaves(*_graph(s, d)),
    "graph_stats": lambda s, d: L.graph_stats(*_graph(s, d)),
    "edge_type_counts": lambda s, d: L.edge_type_counts(L.lineage_edges(_corpus(s, d))),
    "program_impact": lambda s, d: L.program_impact(*_graph(s, d)),
    "leaf_outputs": lambda s, d: L.leaf_outputs(*_graph(s, d)),
    "degree": lambda s, d: L.degree(*_graph(s, d)),
    "hubs": lambda s, d: L.hubs(*_graph(s, d)),
    "lineage_flows": lambda s, d: L.lineage_flows(*_graph(s, d)),
    "flow_ends": lambda s, d: L.flow_ends(*_graph(s, d)),
}

EDGES = """e AS (SELECT DISTINCT * FROM (SELECT 'dataset:' || lower(ds_read) AS source, 'program:' || filename AS target, 'reads' AS relationship FROM lineage_input
  UNION ALL SELECT 'program:' || filename, 'dataset:' || lower(ds_written), 'writes' FROM lineage_input))"""
NODES = """nn AS (SELECT 'program:' || filename AS id, 'program' AS type, filename AS label, filename AS f, 0 AS k FROM lineage_input
  UNION ALL SELECT 'dataset:' || lower(ds_read), 'dataset', ds_read, filename, 1 FROM lineage_input
  UNION ALL SELECT 'dataset:' || lower(ds_written), 'dataset', ds_written, filename, 2 FROM lineage_input),
n AS (SELECT id, type, label FROM nn QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, k, label) = 1)"""
THINGS = [("datasets_read", "dataset", "reads", READS()), ("datasets_written", "dataset", "writes", srt(f"list_concat({STEPS_LIST}, {ex('sql_create')})")),
          ("macro_definitions", "macro", "defines", ex("macro_def")),
          ("macro_calls", "macro", "calls", srt(f"list_filter({ex('macro_call')}, lambda n: lower(n) NOT IN ({MACROS}))")),
          ("includes", "include", "includes", trim_all(ex("include")))]
MENTIONS = "m AS (" + " UNION ALL ".join(
    f"SELECT filename, '{kind}' AS type, '{role}' AS relationship, {i} AS k, unnest({e}) AS label FROM programs"
    for i, (_, kind, role, e) in enumerate(THINGS, start=1)) + """),
g AS (SELECT *, type || ':' || CASE WHEN type = 'include' THEN label ELSE lower(label) END AS id, 'program:' || filename AS prog FROM m)"""


def q(sql):
    return with_views("lineage_input", sql)


HUBS = """SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node
  ORDER BY degree DESC, node LIMIT 20"""


#: Smallest node a node is connected with, by walking from the datasets (a flow without one is a lone node).
FLOWS = """links AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
met AS (SELECT DISTINCT a AS start, a AS node FROM links WHERE a LIKE 'dataset:%' UNION
  SELECT met.start, links.b FROM met JOIN links ON links.a = met.node),
flows AS (SELECT n.id AS node, coalesce(min(met.start), n.id) AS flow FROM n LEFT JOIN met ON met.node = n.id GROUP BY n.id)"""
ENDS = """ends AS (SELECT flow, count(*) AS nodes,
  coalesce(min(node) FILTER (node NOT IN (SELECT target FROM e)), min(node)) AS head,
  coalesce(min(node) FILTER (node NOT IN (SELECT source FROM e)), min(node)) AS tail FROM flows GROUP BY flow)"""


def _hops(end, *directions, among="ends", steps=(FLOWS, ENDS)):
    """Level by level from one node of each flow, or all nodes; the longest shortest way, down a chain of ten datasets and ten programs, is below forty steps."""
    walks, parts = [], []
    for name in directions:
        a, b = ("source", "target") if name == "downstream" else ("target", "source")
        walks.append(f"""{name} AS (SELECT {end} AS start, {end} AS node, 0 AS hops FROM {among} UNION
          SELECT w.start, e.{b}, w.hops + 1 FROM {name} w JOIN e ON e.{a} = w.node WHERE w.hops < 40)""")
        label = f"'{name}' AS direction, " if len(directions) > 1 else ""
        parts.append(f"SELECT start, node, {label}min(hops) AS hops FROM {name} WHERE node <> start GROUP BY start, node")
    return q(f"WITH RECURSIVE {', '.join([EDGES, NODES, *steps, *walks])} {' UNION ALL '.join(parts)}")


ORACLE = {
    "lineage_nodes": q(f"WITH {NODES} SELECT * FROM n"),
    "lineage_edges": q(f"WITH {EDGES} SELECT * FROM e"),
    "lineage_nodes_corpus": with_views("programs", f"""WITH {MENTIONS}, a AS (SELECT id, type, label, filename AS f, k FROM g
      UNION ALL SELECT 'program:' || filename, 'program', filename, filename, 0 FROM programs)
      SELECT id, type, label FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, k, label) = 1"""),
    "lineage_edges_corpus": with_views("programs", f"""WITH {MENTIONS} SELECT DISTINCT
      CASE WHEN relationship IN ('reads', 'calls', 'includes') THEN id ELSE prog END AS source,
      CASE WHEN relationship IN ('reads', 'calls', 'includes') THEN prog ELSE id END AS target, relationship FROM g"""),
    "upstream": _hops("tail", "upstream"),
    "downstream": _hops("head", "downstream"),
    "lineage_closure": _hops("id", "upstream", "downstream", among="n", steps=()),
    "lineage_flows": q(f"WITH RECURSIVE {EDGES}, {NODES}, {FLOWS} SELECT * FROM flows"),
    "flow_ends": q(f"WITH RECURSIVE {EDGES}, {NODES}, {FLOWS}, {ENDS} SELECT * FROM ends"),
    "hubs": q(f"WITH {EDGES} {HUBS}"),
    "roots_leaves": q(f"""WITH {EDGES}, {NODES} SELECT id, type, 'root' AS role FROM n WHERE id NOT IN (SELECT target FROM e)
      UNION ALL SELECT id, type, 'leaf' FROM n WHERE id NOT IN (SELECT source FROM e)"""),
    "graph_stats": q(f"""WITH {EDGES}, {NODES} SELECT 'nodes:' || type AS measure, count(*) AS value FROM n GROUP BY 1
      UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'edges', count(*) FROM e"""),
    "edge_type_counts": with_views("programs", f"""WITH {MENTIONS} SELECT relationship, count(*) AS n FROM
      (SELECT DISTINCT id, prog, relationship FROM g) GROUP BY 1"""),
    "program_impact": q(f"""WITH {EDGES}, {NODES}, i AS (SELECT DISTINCT target AS id, source FROM e WHERE target LIKE 'program:%'),
      o AS (SELECT DISTINCT source AS id, target AS thing FROM e WHERE source LIKE 'program:%'),
      r AS (SELECT source AS thing, count(DISTINCT target) AS k FROM e WHERE target LIKE 'program:%' GROUP BY 1),
      t AS (SELECT n.id, n.label, (SELECT count(*) FROM i WHERE i.id = n.id) AS upstream, (SELECT count(*) FROM o WHERE o.id = n.id) AS downstream,
        (SELECT coalesce(CAST(sum(coalesce(k, 0)) AS BIGINT), 0) FROM o LEFT JOIN r ON r.thing = o.thing WHERE o.id = n.id) AS readers
        FROM n WHERE n.type = 'program')
      SELECT label, upstream, downstream, readers, upstream + downstream AS total FROM t"""),
    "leaf_outputs": q(f"WITH {EDGES}, {NODES} SELECT label, type FROM n WHERE id NOT IN (SELECT source FROM e)"),
    "degree": q(f"""WITH {EDGES}, {NODES} SELECT n.id, (SELECT count(*) FROM e WHERE e.target = n.id) AS in_degree,
      (SELECT count(*) FROM e WHERE e.source = n.id) AS out_degree FROM n"""),
}
