"""Lookups and BY-merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.operators import joins as J
from ledgerlift.plans.views import view, with_views


def _labels(s, d):
    return view(s, d, "nation").select(
        F.when(F.col("n_nationkey") % 3 == 0, -F.col("n_nationkey") - 1).otherwise(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("label"))


def _left(s, d):
    return view(s, d, "lineitem").select(
        F.col("l_partkey").alias("k"), F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_linenumber")).alias("m"),
        F.col("l_orderkey").alias("v"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("p"))


def _right(s, d):
    """One row per (k, m), with a missing m and a shared column x; returned items have keys the left side lacks."""
    return (view(s, d, "lineitem")
            .select(F.when(F.col("l_returnflag") == "R", -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("k"),
                    F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_linenumber")).alias("m"),
                    F.col("l_suppkey").alias("w"), F.col("l_tax").alias("x"))
            .groupBy("k", "m").agg(F.max("w").alias("w"), F.max("x").alias("x")))


LEFT = """l AS (SELECT l_partkey AS k, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS m, l_orderkey AS v,
  l_quantity AS x, l_extendedprice AS p FROM lineitem)"""
RIGHT = """r AS (SELECT CASE WHEN l_returnflag = 'R' THEN -l_partkey ELSE l_partkey END AS k, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS m, max(l_suppkey) AS w,
  max(l_tax) AS x FROM lineitem GROUP BY 1, 2)"""


def _merge_sql(kind):
    return f"""WITH {LEFT}, {RIGHT},
l1 AS (SELECT *, true AS a FROM l), r1 AS (SELECT *, true AS b FROM r)
SELECT CASE WHEN l1.a THEN l1.k ELSE r1.k END AS k, CASE WHEN l1.a THEN l1.m ELSE r1.m END AS m, l1.v, l1.p,
  CASE WHEN r1.b THEN r1.x ELSE l1.x END AS x, r1.w, coalesce(l1.a, false) AS in_a, coalesce(r1.b, false) AS in_b
FROM l1 {kind} JOIN r1 ON l1.k = r1.k AND l1.m IS NOT DISTINCT FROM r1.m"""


def _many(s, d):
    """Purchases of a user against all other events, both many per key."""
    ev = view(s, d, "events")
    a = ev.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("a_id"), F.col("value").alias("x"))
    b = ev.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("x"))
    return J.merge_by(a, b, ["user_id"], "any", (["a_id"], ["b_id"]))


def _range(s, d):
    bands = [(None, 10.0, "low"), (10.0, 25.0, "mid"), (25.0, 40.0, "high")]
    return view(s, d, "lineitem").select(J.range_format(F.col("l_quantity"), bands, "top").alias("band")).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"))


QUERIES = {
    "left_lookup": lambda s, d: J.lookup_join(view(s, d, "installments").select("cod_ramo", "cod_produto", "cod_apolice"),
                                              view(s, d, "reinsurance_pct"), ["cod_ramo", "cod_produto"]),
    "left_lookup_null_safe": lambda s, d: J.lookup_join(_left(s, d), _right(s, d), ["k", "m"], ["w"]),
    "left_lookup_plain": lambda s, d: J.lookup_join(_left(s, d), _right(s, d), ["k", "m"], ["w"], null_safe=False),
    "inner_join": lambda s, d: J.lookup_join(view(s, d, "policies"), view(s, d, "addresses"), ["customer_id"], how="inner"),
    "merge_by_left": lambda s, d: J.merge_by(_left(s, d), _right(s, d), ["k", "m"], "a"),
    "merge_by_both": lambda s, d: J.merge_by(_left(s, d), _right(s, d), ["k", "m"], "ab"),
    "merge_by_right": lambda s, d: J.merge_by(_left(s, d), _right(s, d), ["k", "m"], "b"),
    "merge_by_full": lambda s, d: J.merge_by(_left(s, d), _right(s, d), ["k", "m"], "any"),
    "merge_by_many": _many,
    "hash_lookup": lambda s, d: J.hash_lookup(view(s, d, "claims"), view(s, d, "policies"), ["policy_id"], ["customer_id", "premium_amount"]),
    "hash_lookup_keep": lambda s, d: J.hash_lookup(view(s, d, "claims"), view(s, d, "policies"), ["policy_id"], ["customer_id", "premium_amount"], "null"),
    "format_lookup": lambda s, d: J.apply_format(view(s, d, "customer").select("c_custkey", "c_nationkey"), _labels(s, d), "c_nationkey", "nation_label"),
    "range_format": _range,
    "anti_unmatched": lambda s, d: J.unmatched(view(s, d, "policies"), view(s, d, "addresses"), ["customer_id"]),
    "semi_related": lambda s, d: J.having_marker(view(s, d, "policies"), view(s, d, "addresses"), ["customer_id"]),
}

ORACLE = {
    "left_lookup": with_views("installments reinsurance_pct", """SELECT i.cod_ramo, i.cod_produto, i.cod_apolice, r.percentual_sas
      FROM installments i LEFT JOIN reinsurance_pct r ON i.cod_ramo = r.cod_ramo AND i.cod_produto = r.cod_produto"""),
    "left_lookup_null_safe": f"WITH {LEFT}, {RIGHT} SELECT l.*, r.w FROM l LEFT JOIN r ON l.k = r.k AND l.m IS NOT DISTINCT FROM r.m",
    "left_lookup_plain": f"WITH {LEFT}, {RIGHT} SELECT l.*, r.w FROM l LEFT JOIN r ON l.k = r.k AND l.m = r.m",
    "inner_join": with_views("policies addresses", """SELECT p.*, a.city, a.state FROM policies p
      JOIN addresses a ON p.customer_id = a.customer_id"""),
    "merge_by_left": _merge_sql("LEFT"),
    "merge_by_both": _merge_sql("INNER"),
    "merge_by_right": _merge_sql("RIGHT"),
    "merge_by_full": _merge_sql("FULL"),
    "merge_by_many": """WITH a AS (SELECT user_id, event_id AS a_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
        count(*) OVER (PARTITION BY user_id) AS na FROM events WHERE event_type <> 'purchase'),
      b AS (SELECT user_id, event_id AS b_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
        count(*) OVER (PARTITION BY user_id) AS nb FROM events WHERE event_type = 'purchase'),
      n AS (SELECT user_id, max(na) AS na, max(nb) AS nb FROM (SELECT user_id, na, NULL AS nb FROM a UNION ALL
        SELECT user_id, NULL, nb FROM b) GROUP BY user_id),
      g AS (SELECT user_id, na, nb, unnest(range(1, greatest(coalesce(na, 0), coalesce(nb, 0)) + 1)) AS i FROM n)
      SELECT g.user_id, a.a_id, b.b_id, CASE WHEN g.i <= coalesce(g.nb, 0) THEN b.x ELSE a.x END AS x,
        g.na IS NOT NULL AS in_a, g.nb IS NOT NULL AS in_b
      FROM g LEFT JOIN a ON a.user_id = g.user_id AND a.i = least(g.i, g.na)
      LEFT JOIN b ON b.user_id = g.user_id AND b.i = least(g.i, g.nb)""",
    "hash_lookup": with_views("claims policies", """SELECT c.*, p.customer_id, p.premium_amount FROM claims c
      JOIN policies p ON c.policy_id = p.policy_id"""),
    "hash_lookup_keep": with_views("claims policies", """SELECT c.*, p.customer_id, p.premium_amount FROM claims c
      LEFT JOIN policies p ON c.policy_id = p.policy_id"""),
    "format_lookup": """SELECT c_custkey, c_nationkey, coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, CAST(c_nationkey AS VARCHAR))
      AS nation_label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "range_format": """SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 25 THEN 'mid' WHEN l_quantity < 40 THEN 'high'
      ELSE 'top' END AS band, count(*) AS n FROM lineitem GROUP BY 1""",
    "anti_unmatched": with_views("policies addresses", "SELECT * FROM policies WHERE customer_id NOT IN (SELECT customer_id FROM addresses)"),
    "semi_related": with_views("policies addresses", "SELECT * FROM policies WHERE customer_id IN (SELECT customer_id FROM addresses)"),
}
