"""Set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.functions.semantics import lt
from ledgerlift.operators import reshape as H
from ledgerlift.plans.views import view, with_views

c = F.col


def _split(s, d):
    df = view(s, d, "installments").select("cod_apolice", "num_parcela", "cod_tp_emissao", "dt_vencimento")
    return H.split_outputs(df, {
        "direto": c("cod_tp_emissao") == "D", "aceito": c("cod_tp_emissao") == "A",
        "vencido": lt(c("dt_vencimento"), F.lit("1998-06-30").cast("date"))}).drop("cod_tp_emissao", "dt_vencimento")


def _supplied(s, d):
    """Parts by supplier."""
    return view(s, d, "lineitem").select("l_suppkey", F.concat(F.lit("p"), F.col("l_partkey")).alias("part"))


QUERIES = {
    "concat_set": lambda s, d: H.concat_set(
        view(s, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), "c_acctbal"),
        view(s, d, "supplier").select(c("s_name").alias("name"), c("s_suppkey").alias("id"), "s_nationkey"),
        view(s, d, "nation").select(c("n_nationkey").cast("bigint").alias("id"), c("n_name").alias("name"))),
    "union_all": lambda s, d: H.union_all(
        view(s, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name")),
        view(s, d, "supplier").select("s_suppkey", "s_name"), view(s, d, "supplier").select("s_suppkey", "s_name")),
    "unpivot": lambda s, d: H.unpivot(view(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], {
        "l_quantity": "qty", "l_extendedprice": "price", "l_discount": "discount", "l_tax": "tax"}, "conta", "montante"),
    "split_outputs": _split,
    "set_diff": lambda s, d: H.set_diff(
        view(s, d, "customer").select(c("c_custkey").alias("k")), view(s, d, "supplier").select(c("s_suppkey").alias("k")), ["k"]),
    "coverage_gaps": lambda s, d: H.coverage_gaps(_supplied(s, d), "l_suppkey", "part"),
    "coverage_universe": lambda s, d: H.coverage_universe(_supplied(s, d), "part", "l_suppkey"),
}

ORACLE = {
    "concat_set": """SELECT c_custkey AS id, c_name AS name, c_acctbal, CAST(NULL AS INTEGER) AS s_nationkey FROM customer
      UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL, NULL FROM nation""",
    "union_all": """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier
      UNION ALL SELECT s_suppkey, s_name FROM supplier""",
    "unpivot": " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, '{n}' AS conta, {v} AS montante FROM lineitem" for n, v in (
        ("qty", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"))),
    "split_outputs": with_views("installments", """SELECT cod_apolice, num_parcela, CASE cod_tp_emissao WHEN 'D' THEN 'direto' ELSE 'aceito' END AS output
      FROM installments UNION ALL SELECT cod_apolice, num_parcela, 'vencido' FROM installments
      WHERE dt_vencimento IS NULL OR dt_vencimento < DATE '1998-06-30'"""),
    "set_diff": "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier",
    "coverage_gaps": """WITH v AS (SELECT DISTINCT l_suppkey, 'p' || l_partkey AS part FROM lineitem),
      k AS (SELECT count(DISTINCT part) AS n_known FROM v)
      SELECT l_suppkey, n_known - count(*) AS n_missing, n_known FROM v, k GROUP BY l_suppkey, n_known HAVING n_known > count(*)""",
    "coverage_universe": "SELECT 'p' || l_partkey AS part, count(DISTINCT l_suppkey) AS n_entities FROM lineitem GROUP BY 1",
}
