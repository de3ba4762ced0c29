"""Row steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.functions import scalars as S
from ledgerlift.functions.semantics import clamp, char_eq, ge, gt, is_blank, le, lt, missing_to_zero
from ledgerlift.operators import steps as T
from ledgerlift.plans.views import view, with_views

c = F.col


def ref():
    return F.lit("1998-06-30").cast("date")


def _inst(s, d):
    return view(s, d, "installments")


def _nullable(s, d):
    """Installment counts with missing values and values on both sides of the limits."""
    return _inst(s, d).select("cod_apolice", "num_parcela", "cpf_cnpj", F.nullif("num_parcela", F.lit(3)).alias("v"))


QUERIES = {
    "set_step": lambda s, d: T.data_step(_inst(s, d), [{"liquido": c("val_cobranca") - c("val_iof")}, {"dobro": c("liquido") * 2}],
                                         keep=["cod_apolice", "num_parcela", "liquido", "dobro"]),
    "keep_drop_rename": lambda s, d: T.data_step(view(s, d, "orders"), drop=["o_orderpriority"],
                                                 rename={"o_orderkey": "order_id", "o_custkey": "customer_id"}),
    "where_filter": lambda s, d: T.data_step(_inst(s, d), keep=["cod_apolice", "num_parcela", "cod_agencia"],
                                             where=c("cod_sistema_origem").isin("BUILDING", "MACHINERY") & lt(c("dt_vencimento"), ref())),
    "delete_rows": lambda s, d: T.data_step(_inst(s, d), keep=["cod_apolice", "cpf_cnpj"], delete=(c("cpf_cnpj") % 3 == 0)),
    "if_else_map": lambda s, d: view(s, d, "customer").select(
        "c_custkey", S.value_map(c("c_mktsegment"), {"BUILDING": "G", "MACHINERY": "R", "AUTOMOBILE": "S"}).alias("letter"),
        S.value_map(c("c_mktsegment"), {"BUILDING": "G"}, "?").alias("letter_or_default")),
    "clamp": lambda s, d: _nullable(s, d).select("cod_apolice", "num_parcela", clamp(c("v"), 2, 5).alias("clipped")),
    "missing_to_zero": lambda s, d: _nullable(s, d).select("cod_apolice", missing_to_zero(c("cpf_cnpj")).alias("cpf"), missing_to_zero(c("v")).alias("v")),
    "missing_order": lambda s, d: _nullable(s, d).select(
        "cod_apolice", "num_parcela", lt(c("v"), c("cpf_cnpj")).alias("lt"), le(c("v"), c("cpf_cnpj")).alias("le"),
        gt(c("v"), 4).alias("gt4"), ge(c("v"), 4).alias("ge4"), lt(c("v"), 0).alias("lt0")),
    "blank_strings": lambda s, d: view(s, d, "events").select(
        "event_id", is_blank(F.nullif("event_type", F.lit("click"))).alias("blank"),
        char_eq(F.concat("event_type", F.lit("  ")), c("event_type")).alias("same"),
        char_eq(F.nullif("event_type", F.lit("view")), F.lit(" ")).alias("eq_blank")),
    "constant_columns": lambda s, d: T.add_constants(view(s, d, "supplier").select("s_suppkey"), {"ledger": "0L", "empresa": 2, "usuario": None}),
    "inconsistent_flag": lambda s, d: _inst(s, d).select("cod_apolice", "num_parcela", T.inconsistency_flag(
        zero=["cod_agencia"], missing_or_zero=["cod_produto", "grupo_ramo", "cpf_cnpj"], dates=["dt_vencimento"],
        ordered=("dt_inicio", "dt_vencimento")).alias("inconsist")),
    "aging_bucket": lambda s, d: _inst(s, d).select(
        "cod_apolice", "num_parcela", T.aging_bucket(F.date_diff("dt_vencimento", ref()), c("cpf_cnpj").isNull()).alias("aging")),
    "condition_label": lambda s, d: _inst(s, d).select("cod_apolice", "num_parcela", T.decision_table([
        ((c("dt_fim") < ref()) & lt(c("dt_vencimento"), ref()), "CONDICAO_1"), (c("dt_fim") < ref(), "CONDICAO_2"),
        (lt(c("dt_vencimento"), ref()), "CONDICAO_3"), (ge(c("dt_vencimento"), ref()), "CONDICAO_4")], "CONDICAO_F").alias("condicao")),
    "scd_chain_expr": lambda s, d: T.data_step(_inst(s, d), [
        {"dias": F.date_diff("dt_fim", ref())}, {"resto": F.when(c("dias") < 0, 0).otherwise(c("dias") + 1)},
        {"faixa": F.floor(c("resto") / 30)}], keep=["cod_apolice", "num_parcela", "dias", "resto", "faixa"]),
}

NULLABLE = "n AS (SELECT cod_apolice, num_parcela, cpf_cnpj, nullif(num_parcela, 3) AS v FROM installments)"
BUCKETS = ("CASE WHEN cpf_cnpj IS NULL OR d IS NULL THEN 'Nenhuma das anteriores' WHEN d > 365 THEN 'av.acima de 365 dias' "
           "WHEN d > 180 THEN 'av.181 a 365 dias' WHEN d > 120 THEN 'av.121 a 180 dias' WHEN d > 60 THEN 'av.061 a 120 dias' "
           "WHEN d > 30 THEN 'av.031 a 060 dias' WHEN d >= 0 THEN 'AV.000 a 030 dias' WHEN d >= -30 THEN 'vc.001 a 030 dias venc' "
           "WHEN d >= -60 THEN 'vc.031 a 060 dias venc' WHEN d >= -120 THEN 'vc.061 a 120 dias venc' "
           "WHEN d >= -180 THEN 'vc.121 a 180 dias venc' WHEN d >= -365 THEN 'vc.181 a 365 dias venc' ELSE 'vc.acima de 365 dias venc' END")


def _i(sql):
    return with_views("installments", sql)


ORACLE = {
    "set_step": _i("SELECT cod_apolice, num_parcela, val_cobranca - val_iof AS liquido, (val_cobranca - val_iof) * 2 AS dobro FROM installments"),
    "keep_drop_rename": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice, o_orderdate FROM orders",
    "where_filter": _i("""SELECT cod_apolice, num_parcela, cod_agencia FROM installments WHERE cod_sistema_origem IN ('BUILDING', 'MACHINERY')
      AND (dt_vencimento IS NULL OR dt_vencimento < DATE '1998-06-30')"""),
    "delete_rows": _i("SELECT cod_apolice, cpf_cnpj FROM installments WHERE cpf_cnpj IS NULL OR cpf_cnpj % 3 <> 0"),
    "if_else_map": """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'G' WHEN 'MACHINERY' THEN 'R' WHEN 'AUTOMOBILE' THEN 'S' END AS letter,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'G' ELSE '?' END AS letter_or_default FROM customer""",
    "clamp": _i(f"WITH {NULLABLE} SELECT cod_apolice, num_parcela, greatest(2, least(5, coalesce(v, 2))) AS clipped FROM n"),
    "missing_to_zero": _i(f"WITH {NULLABLE} SELECT cod_apolice, coalesce(cpf_cnpj, 0) AS cpf, coalesce(v, 0) AS v FROM n"),
    "missing_order": _i(f"""WITH {NULLABLE}, m AS (SELECT *, coalesce(v, -1000) AS a, coalesce(cpf_cnpj, -1000) AS b FROM n)
      SELECT cod_apolice, num_parcela, a < b AS lt, a <= b AS le, a > 4 AS gt4, a >= 4 AS ge4, a < 0 AS lt0 FROM m"""),
    "blank_strings": """SELECT event_id, event_type = 'click' AS blank, true AS same, event_type = 'view' AS eq_blank FROM events""",
    "constant_columns": "SELECT s_suppkey, '0L' AS ledger, 2 AS empresa, CAST(NULL AS VARCHAR) AS usuario FROM supplier",
    "inconsistent_flag": _i("""SELECT cod_apolice, num_parcela, CASE WHEN cod_agencia = 0 OR cod_produto = 0 OR grupo_ramo = 0 OR cpf_cnpj IS NULL
      OR cpf_cnpj = 0 OR dt_vencimento IS NULL OR dt_vencimento <= DATE '1900-12-30' OR dt_inicio >= dt_vencimento THEN 'S' ELSE 'N' END AS inconsist
      FROM installments"""),
    "aging_bucket": _i(f"""WITH a AS (SELECT cod_apolice, num_parcela, cpf_cnpj, dt_vencimento - DATE '1998-06-30' AS d FROM installments)
      SELECT cod_apolice, num_parcela, {BUCKETS} AS aging FROM a"""),
    "condition_label": _i("""SELECT cod_apolice, num_parcela, CASE WHEN dt_fim < DATE '1998-06-30' THEN
      CASE WHEN dt_vencimento IS NULL OR dt_vencimento < DATE '1998-06-30' THEN 'CONDICAO_1' ELSE 'CONDICAO_2' END
      ELSE CASE WHEN dt_vencimento IS NULL OR dt_vencimento < DATE '1998-06-30' THEN 'CONDICAO_3' ELSE 'CONDICAO_4' END END AS condicao
      FROM installments"""),
    "scd_chain_expr": _i("""WITH a AS (SELECT cod_apolice, num_parcela, dt_fim - DATE '1998-06-30' AS dias FROM installments),
      b AS (SELECT *, CASE WHEN dias < 0 THEN 0 ELSE dias + 1 END AS resto FROM a)
      SELECT *, CAST(floor(resto / 30.0e0) AS BIGINT) AS faixa FROM b"""),
}
