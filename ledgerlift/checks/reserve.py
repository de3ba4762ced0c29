"""The receivables pipeline, stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.checks.common import msum, total
from ledgerlift.functions.semantics import money_sum
from ledgerlift.operators.ordering import attach_group_extreme
from ledgerlift.plans import reserve as R
from ledgerlift.session import stored
from ledgerlift.plans.views import view, with_views

ST = R.Settings(letters={"BUILDING": "B", "MACHINERY": "M", "AUTOMOBILE": "A", "HOUSEHOLD": "H"},
                undivided_system="BUILDING")


def _base(spark, d):
    return R.base(view(spark, d, "installments"), view(spark, d, "reinsurance_pct"), ST)


def _drag(spark, d):
    worst = R.worst_per_insured(_grain(spark, d))
    return R.drag(attach_group_extreme(_base(spark, d), worst, ["cpf_cnpj"]))


def _grain(spark, d):
    return R.policy_grain(R.flags(view(spark, d, "installments"), ST))


def _status(spark, d, issue=None):
    return R.with_status(view(spark, d, "installments"), view(spark, d, "reinsurance_pct"), ST, issue)


def _factor(spark, d, issue=None):
    return R.factor(_status(spark, d, issue), view(spark, d, "calc_group"), view(spark, d, "factors"))


def _direct(spark, d, life=False):
    rows = R.postable(_factor(spark, d, "D"))
    return R.accounts_direct(rows, ST, life)


def _accepted(spark, d):
    return R.accounts_accepted(R.postable(_factor(spark, d, "A")), ST)


def _totals(df, keys, measures):
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[money_sum(F.col(m)).alias(f"sum_{m}") for m in measures]
    )


BASE_KEYS = ["cod_tp_emissao", "venc_vinc", "decorrer_e_decorrido", "inconsist", "aging_dias_nome", "condicoes"]
BASE_SUMS = ["dias", "dias_vigente", "dias_decorrer", "base_ppng", "dcd_base", "fator_decorrer", "calc_ppng_dec",
             "calc_dcd_dec", "estipulante_dec", "percentual_sas", "premio_resseguro", "ppng_resseguro", "rvr"]
STATUS_KEYS = ["status_vigencia", "status_parcela", "status_apolice", "status_cliente", "ref_agging",
               "agging_meses", "rvr_atu_negativa"]
STATUS_SUMS = ["agging_vcto_parcela", "agging_vcto_apolice", "agging_vcto_cliente", "fator_decorrer_atu",
               "calc_ppng_dec_atu", "calc_dcd_dec_atu", "ppng_resseguro_atu", "rvr_atu", "rvr_atu_fnl"]
DIRECT = ["C1131900000", "C1212190000", "C2125190000", "C2128900000", "C2122290000", "C2123190000",
          "C2123390000", "C2123590000", "C1132900002", "C3152710000"]
LIFE = [a for a in DIRECT if a != "C1212190000"]
ACCEPTED = ["C1132900001", "C2125290000", "C2123290001", "C2123390001", "C2123590001", "C1132900003", "C3152710001"]


def _original(spark, d):
    return _totals(R.original_parts(_base(spark, d)), ["aging_dias_nome"], ["calc_ppng_dec_ori", "calc_dcd_dec_ori"])


def _conciliation(spark, d):
    """Totals, worked out once, against a stored ledger in which one account was booked wrong and one not at all."""
    totals = stored(R.account_totals(_direct(spark, d)), "account-totals")
    lines = R.journal_of(totals, ST, "DIRETO").where("conta_contabil <> '2125190000'")
    wrong = F.when(F.col("conta_contabil") == "1131900000", F.col("montante") + 1).otherwise(F.col("montante"))
    return R.conciliation(totals, stored(lines.withColumn("montante", wrong), "ledger"))


QUERIES = {
    "aging_summary": lambda s, d: R.aging_summary(_factor(s, d), ST),
    "reserve_base": lambda s, d: _totals(_base(s, d), BASE_KEYS, BASE_SUMS),
    "reserve_original_parts": _original,
    "reserve_drag": lambda s, d: _totals(_drag(s, d), ["condicoes", "condicoes_v2", "aging_dias_nome", "aging_dias_nome_v2"], ["rvr"]),
    "worst_status_propagation": lambda s, d: _drag(s, d).select(
        "cod_apolice", "num_parcela", "cpf_cnpj", "dias", "dias_min", "condicoes_v2", "aging_dias_nome_v2"),
    "reserve_status": lambda s, d: _totals(_status(s, d), STATUS_KEYS, STATUS_SUMS),
    "group_having": lambda s, d: R.policy_delinquency(_grain(s, d), ST),
    "nested_agg": lambda s, d: R.customer_delinquency(_grain(s, d)),
    "group_extreme_attach": lambda s, d: _status(s, d).select(
        "cod_apolice", "num_parcela", "cod_produto", "dt_vencimento", "vigente", "min_vcto_apolice", "min_vcto_cliente"),
    "group_min_max": lambda s, d: R.clean_factors(view(s, d, "factors")),
    "reserve_factor": lambda s, d: _totals(_factor(s, d), ["grupo_calculo", "status_parcela", "agging_meses", "fator_atuarial"],
                                           ["rvr_atu_fnl", "rvr_atuarial"]),
    "reserve_accounts_direct": lambda s, d: _totals(_direct(s, d), ["segmento", "centro_de_custo"], DIRECT),
    "reserve_accounts_accepted": lambda s, d: _totals(_accepted(s, d), ["segmento", "centro_de_custo"], ACCEPTED),
    "reserve_accounts_life": lambda s, d: _totals(_direct(s, d, True), ["segmento", "centro_de_custo"], LIFE),
    "unpivot_accounts": lambda s, d: R.entries(R.account_totals(_direct(s, d))),
    "journal": lambda s, d: R.journal(_direct(s, d), ST, "DIRETO"),
    "journal_accepted": lambda s, d: R.journal(_accepted(s, d), ST, "ACEITO"),
    "journal_life": lambda s, d: R.journal(_direct(s, d, True), ST, "DIRETO", 20),
    "reserve_conciliation": lambda s, d: R.conciliation_totals(_direct(s, d)),
    "reserve_conciliation_accepted": lambda s, d: R.conciliation_totals(_accepted(s, d)),
    "conciliation": _conciliation,
    "analytic_base": lambda s, d: R.analytic_base(_factor(s, d)),
    "analytic_base_overdue": lambda s, d: R.analytic_base(_factor(s, d), overdue_only=True),
    "currency_base": lambda s, d: R.currency_base(_factor(s, d)),
}

# --- SQL of the same stages ------------------------------------------------------------

REF = "DATE '1998-06-30'"
NEXT = "DATE '1998-07-01'"


def _aging(d: str) -> str:
    return f"""CASE WHEN {d} IS NULL THEN 'Nenhuma das anteriores'
  WHEN {d} BETWEEN 0 AND 30 THEN 'AV.000 a 030 dias' WHEN {d} BETWEEN 31 AND 60 THEN 'av.031 a 060 dias'
  WHEN {d} BETWEEN 61 AND 120 THEN 'av.061 a 120 dias' WHEN {d} BETWEEN 121 AND 180 THEN 'av.121 a 180 dias'
  WHEN {d} BETWEEN 181 AND 365 THEN 'av.181 a 365 dias' WHEN {d} > 365 THEN 'av.acima de 365 dias'
  WHEN {d} BETWEEN -30 AND -1 THEN 'vc.001 a 030 dias venc' WHEN {d} BETWEEN -60 AND -31 THEN 'vc.031 a 060 dias venc'
  WHEN {d} BETWEEN -120 AND -61 THEN 'vc.061 a 120 dias venc' WHEN {d} BETWEEN -180 AND -121 THEN 'vc.121 a 180 dias venc'
  WHEN {d} BETWEEN -365 AND -181 THEN 'vc.181 a 365 dias venc' ELSE 'vc.acima de 365 dias venc' END"""


BASE_SQL = f"""
b0 AS (SELECT i.*, coalesce(r.percentual_sas, 0.0) AS percentual_sas,
    i.dt_vencimento - {REF} AS dias, i.dt_fim - i.dt_inicio + 1 AS dias_vigente,
    val_cobranca - val_cosseguro - val_iof AS base_ppng, val_comissao - val_comissao_cosseguro AS dcd_base,
    CASE WHEN i.dt_vencimento IS NULL OR i.dt_vencimento < {REF} THEN 'Vencido' ELSE 'A Vencer' END AS venc_vinc,
    CASE WHEN i.dt_fim < {REF} THEN 'Decorrido' ELSE 'Decorrer' END AS decorrer_e_decorrido,
    CASE WHEN cod_agencia = 0 OR i.cod_produto = 0 OR grupo_ramo = 0 OR i.cod_ramo = 0 OR dt_vencimento IS NULL
      OR dt_vencimento <= DATE '1900-12-30' OR cpf_cnpj IS NULL OR cpf_cnpj = 0 OR dt_inicio >= dt_fim
      THEN 'S' ELSE 'N' END AS inconsist,
    CASE WHEN i.dt_fim < {REF} THEN 0 ELSE i.dt_fim - {REF} + 1 END AS dias_decorrer
  FROM installments i LEFT JOIN reinsurance_pct r ON i.cod_ramo = r.cod_ramo AND i.cod_produto = r.cod_produto),
b1 AS (SELECT *, CASE WHEN dias_decorrer <= 0 OR dias_vigente <= 0 OR inconsist = 'S' THEN 0.0
      WHEN dias_decorrer > dias_vigente THEN 1.0
      ELSE CAST(dias_decorrer AS DOUBLE) / CAST(dias_vigente AS DOUBLE) END AS fator_decorrer FROM b0),
b2 AS (SELECT *, base_ppng * fator_decorrer AS calc_ppng_dec, dcd_base * fator_decorrer AS calc_dcd_dec,
    val_estipulante * fator_decorrer AS estipulante_dec,
    base_ppng * fator_decorrer * percentual_sas AS ppng_resseguro,
    (val_cobranca - val_cosseguro - val_iof) * percentual_sas AS premio_resseguro,
    CASE WHEN inconsist = 'S' THEN 'Nenhuma das anteriores' ELSE {_aging('dias')} END AS aging_dias_nome,
    CASE WHEN decorrer_e_decorrido = 'Decorrido' AND venc_vinc = 'Vencido' THEN 'CONDICAO_1'
      WHEN decorrer_e_decorrido = 'Decorrido' THEN 'CONDICAO_2'
      WHEN venc_vinc = 'Vencido' AND (dias IS NULL OR dias < 0) THEN 'CONDICAO_3'
      WHEN venc_vinc = 'A Vencer' THEN 'CONDICAO_4' ELSE 'CONDICAO_F' END AS condicoes FROM b1),
base AS (SELECT *, val_cobranca - val_iof - val_comissao - val_cosseguro - val_estipulante + val_comissao_cosseguro
    + calc_dcd_dec - calc_ppng_dec + estipulante_dec + ppng_resseguro - premio_resseguro AS rvr FROM b2)"""

DRAG_SQL = BASE_SQL + f""",
worst AS (SELECT cpf_cnpj, min(dias) AS dias_min FROM base
  WHERE condicoes IN ('CONDICAO_1', 'CONDICAO_3') AND inconsist = 'N' GROUP BY cpf_cnpj),
dragged AS (SELECT b.*, w.dias_min,
    CASE WHEN inconsist = 'S' THEN 'CONDICAO_F' WHEN condicoes IN ('CONDICAO_1', 'CONDICAO_3') THEN condicoes
      WHEN w.dias_min IS NOT NULL THEN 'CONDICAO_5' ELSE 'CONDICAO_0' END AS condicoes_v2,
    CASE WHEN inconsist = 'S' THEN 'Nenhuma das anteriores'
      WHEN condicoes IN ('CONDICAO_1', 'CONDICAO_3') OR w.dias_min IS NULL THEN {_aging('dias')}
      ELSE {_aging('w.dias_min')} END AS aging_dias_nome_v2
  FROM base b LEFT JOIN worst w ON b.cpf_cnpj = w.cpf_cnpj)"""

POLICY = ["ano_mes", "cod_seguradora", "cod_tp_emissao", "cod_sistema_origem", "cod_produto", "cod_apolice", "cpf_cnpj"]
CUSTOMER = ["ano_mes", "cod_seguradora", "cpf_cnpj"]


def _same(a: str, b: str, keys) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def _late(d: str) -> str:
    return (f"CASE WHEN year({d}) * 100 + month({d}) > 199807 THEN -2 "
            f"ELSE 1998 * 12 + 6 - year({d}) * 12 - month({d}) END")


def _clip(e: str) -> str:
    return f"CASE WHEN {e} IS NULL OR {e} < 0 THEN 0 WHEN {e} > 13 THEN 13 ELSE {e} END"


POLICY_SQL = f"""
policy AS (SELECT {', '.join(POLICY)}, min(dt_vencimento) AS min_vcto_apolice,
    CASE WHEN max(dt_fim) < {NEXT} THEN 'DECORRIDO' ELSE 'DECORRER' END AS vigente
  FROM dragged GROUP BY {', '.join(POLICY)} HAVING sum(val_cobranca) > 0),
customers AS (SELECT {', '.join(CUSTOMER)}, min(min_vcto_apolice) AS min_vcto_cliente FROM policy GROUP BY {', '.join(CUSTOMER)})"""

STATUS_SQL = DRAG_SQL + "," + POLICY_SQL + f""",
s0 AS (SELECT b.*, p.vigente, p.min_vcto_apolice, k.min_vcto_cliente,
    CAST(dt_inicio - DATE '1970-01-01' AS DOUBLE) AS d_ini, CAST(dt_fim - DATE '1970-01-01' AS DOUBLE) AS d_fim,
    qtde_parcelas = 0 OR dt_fim - dt_inicio < 31
      OR (b.cod_sistema_origem = 'BUILDING' AND b.cod_produto IN (5, 278, 770, 997, 998)) AS whole,
    CASE WHEN dt_vencimento IS NULL OR dt_vencimento < {NEXT} THEN 'INADIMPLENTE' ELSE 'ADIMPLENTE' END AS status_parcela,
    CASE WHEN p.min_vcto_apolice IS NULL OR p.min_vcto_apolice < {NEXT} THEN 'INADIMPLENTE' ELSE 'ADIMPLENTE' END AS st_ap,
    CASE WHEN k.min_vcto_cliente IS NULL OR k.min_vcto_cliente < {NEXT} THEN 'INADIMPLENTE' ELSE 'ADIMPLENTE' END AS st_cl,
    {_late('dt_vencimento')} AS agging_vcto_parcela, {_late('p.min_vcto_apolice')} AS agging_vcto_apolice,
    {_late('k.min_vcto_cliente')} AS agging_vcto_cliente
  FROM dragged b LEFT JOIN policy p ON {_same('b', 'p', POLICY)} LEFT JOIN customers k ON {_same('b', 'k', CUSTOMER)}),
s1 AS (SELECT *, vigente AS status_vigencia,
    CASE WHEN status_parcela = 'INADIMPLENTE' THEN status_parcela ELSE st_ap END AS status_apolice,
    CASE WHEN whole THEN d_ini ELSE d_ini + (d_fim - d_ini) / CAST(qtde_parcelas AS DOUBLE) * (num_parcela - 1) END AS lo,
    CASE WHEN whole THEN d_fim ELSE d_ini + (d_fim - d_ini) / CAST(qtde_parcelas AS DOUBLE) * num_parcela END AS hi,
    CAST({REF} - DATE '1970-01-01' AS DOUBLE) AS d_ref FROM s0),
s2 AS (SELECT *, CASE WHEN status_apolice = 'INADIMPLENTE' THEN status_apolice ELSE st_cl END AS status_cliente,
    CASE WHEN status_apolice = 'INADIMPLENTE' AND status_parcela = 'ADIMPLENTE' THEN 'vcto apolice' ELSE 'vcto parcela' END AS ref_agging,
    CASE WHEN status_apolice = 'ADIMPLENTE' THEN -1 WHEN status_parcela = 'ADIMPLENTE' THEN {_clip('agging_vcto_apolice')}
      ELSE {_clip('agging_vcto_parcela')} END AS agging_meses,
    CASE WHEN hi - lo <= 0 OR hi <= d_ref THEN 0.0 WHEN lo >= d_ref THEN 1.0 ELSE (hi - d_ref) / (hi - lo) END AS fator_decorrer_atu
  FROM s1),
s3 AS (SELECT *, base_ppng * fator_decorrer_atu AS calc_ppng_dec_atu, dcd_base * fator_decorrer_atu AS calc_dcd_dec_atu,
    val_estipulante * fator_decorrer_atu AS estipulante_dec_atu,
    base_ppng * fator_decorrer_atu * percentual_sas AS ppng_resseguro_atu FROM s2),
s4 AS (SELECT *, val_cobranca - val_iof - val_comissao - val_cosseguro - val_estipulante + val_comissao_cosseguro
    + calc_dcd_dec_atu - calc_ppng_dec_atu + estipulante_dec_atu + ppng_resseguro_atu - premio_resseguro AS rvr_atu FROM s3),
status AS (SELECT *, CASE WHEN rvr_atu IS NULL OR rvr_atu < 0 THEN 'SIM' ELSE 'NAO' END AS rvr_atu_negativa,
    CASE WHEN inconsist = 'S' OR rvr_atu IS NULL OR rvr_atu < 0 THEN 0.0 ELSE rvr_atu END AS rvr_atu_fnl FROM s4)"""

FKEYS = ["cod_seguradora", "cod_tp_emissao", "status_vigencia", "status_cliente", "status_apolice", "status_parcela",
         "agging_meses", "ref_agging", "grupo_calculo"]
CLEAN_SQL = f"""
clean AS (SELECT {', '.join(FKEYS)}, CASE WHEN max(fator) IS NULL OR max(fator) < 0 THEN 0.0
    WHEN max(fator) > 1 THEN 1.0 ELSE max(fator) END AS fator_atuarial FROM factors GROUP BY {', '.join(FKEYS)})"""
FACTOR_SQL = STATUS_SQL + f""",
f0 AS (SELECT s.*, CASE WHEN cod_seguradora = 5665 THEN 'Pessoas'
    WHEN cod_seguradora = 6238 AND cod_produto = 216 THEN 'Localiza' ELSE g.grupo_calculo END AS grupo_calculo
  FROM status s LEFT JOIN calc_group g ON s.grupo_ramo = g.grupo_ramo AND s.cod_ramo = g.cod_ramo),""" + CLEAN_SQL + f""",
final AS (SELECT f.*, c.fator_atuarial, f.rvr_atu_fnl * c.fator_atuarial AS rvr_atuarial
  FROM f0 f LEFT JOIN clean c ON {_same('f', 'c', FKEYS)})"""


def _z(e: str, w: int) -> str:
    return f"CASE WHEN length(CAST({e} AS VARCHAR)) < {w} THEN lpad(CAST({e} AS VARCHAR), {w}, '0') ELSE CAST({e} AS VARCHAR) END"


LETTER = ("CASE cod_sistema_origem WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' WHEN 'AUTOMOBILE' THEN 'A' "
          "WHEN 'HOUSEHOLD' THEN 'H' ELSE '' END")
SEGMENT = f"concat({_z('grupo_ramo', 2)}, {_z('cod_ramo', 3)}, {_z('cod_produto', 4)}, {LETTER})"
SEGMENT_LIFE = f"concat({_z('grupo_ramo', 2)}, {_z('cod_ramo', 3)}, substr({_z('cod_produto', 5)}, 2, 4), {LETTER})"
COST = f"concat('C0002', {_z('cod_agencia', 4)})"
NET_RE = "(premio_resseguro - ppng_resseguro_atu)"
REC = "fator_atuarial * (val_cobranca - calc_ppng_dec_atu - val_iof)"
POST = "inconsist <> 'S' AND rvr_atu_negativa <> 'SIM' AND rvr_atu > 0"


def _accounts(name: str, where: str, exprs: dict, residual: tuple, seg: str) -> str:
    cols = ", ".join(f"{e} AS {a}" for a, e in exprs.items())
    return f""",
{name}0 AS (SELECT *, {cols}, {seg} AS segmento, {COST} AS centro_de_custo FROM final WHERE {where}),
{name} AS (SELECT *, {residual[1]} AS {residual[0]} FROM {name}0)"""


def _direct_exprs(w, life=False):
    out = {} if life else {
        "C1131900000": f"CASE WHEN aging_dias_nome = 'av.acima de 365 dias' THEN 0.0 ELSE {REC} END",
        "C1212190000": f"CASE WHEN aging_dias_nome = 'av.acima de 365 dias' THEN {REC} ELSE 0.0 END",
    }
    if life:
        out["C1131900000"] = REC
    return out | {
        "C2125190000": "fator_atuarial * (val_comissao - calc_dcd_dec_atu)",
        "C2128900000": "fator_atuarial * (val_estipulante - estipulante_dec_atu)",
        "C2122290000": "fator_atuarial * val_cosseguro",
        "C2123190000": f"fator_atuarial * (CAST({w[0]} AS DOUBLE) * {NET_RE})",
        "C2123390000": f"fator_atuarial * (CAST({w[1]} AS DOUBLE) * {NET_RE})",
        "C2123590000": f"fator_atuarial * (CAST({w[2]} AS DOUBLE) * {NET_RE})",
        "C1132900002": "fator_atuarial * val_comissao_cosseguro",
    }


def _residual(first, minus, plus):
    return " + ".join(first) + "".join(f" - {m}" for m in minus) + f" + {plus}"


MINUS = ["C2125190000", "C2128900000", "C2122290000", "C2123190000", "C2123390000", "C2123590000"]
RESIDUAL = ("C3152710000", _residual(["C1131900000", "C1212190000"], MINUS, "C1132900002"))
DIRECT_SQL = FACTOR_SQL + _accounts("acc", f"{POST} AND cod_tp_emissao = 'D'", _direct_exprs((0.41, 0.51, 0.08)), RESIDUAL, SEGMENT)
SUMMARY_SQL = FACTOR_SQL + _accounts("acc", "true", _direct_exprs((0.41, 0.51, 0.08)), RESIDUAL, SEGMENT)
LIFE_SQL = FACTOR_SQL + _accounts("acc", f"{POST} AND cod_tp_emissao = 'D'", _direct_exprs((0.35, 0.19, 0.45), True),
                                  ("C3152710000", _residual(["C1131900000"], MINUS, "C1132900002")), SEGMENT_LIFE)
ACCEPTED_SQL = FACTOR_SQL + _accounts("acc", f"{POST} AND cod_tp_emissao = 'A'", {
    "C1132900001": "fator_atuarial * (val_cobranca - calc_ppng_dec_atu - val_iof - val_cosseguro)",
    "C2125290000": "fator_atuarial * (val_comissao - calc_dcd_dec_atu)",
    "C2123290001": f"fator_atuarial * (CAST(0.90 AS DOUBLE) * {NET_RE})",
    "C2123390001": f"fator_atuarial * (CAST(0.07 AS DOUBLE) * {NET_RE})",
    "C2123590001": f"fator_atuarial * (CAST(0.03 AS DOUBLE) * {NET_RE})",
    "C1132900003": "fator_atuarial * val_comissao_cosseguro",
}, ("C3152710001", _residual(["C1132900001"], ["C2125290000", "C2123290001", "C2123390001", "C2123590001"], "C1132900003")), SEGMENT)


def _sum_sql(ctes, source, keys, sums):
    cols = ", ".join(msum(m, f"sum_{m}") for m in sums)
    return f"WITH {ctes} SELECT {', '.join(keys)}, count(*) AS n, {cols} FROM {source} GROUP BY {', '.join(keys)}"


def _entries(names):
    parts = [f"""SELECT segmento, centro_de_custo, '{a[1:]}' AS conta_contabil,
      {total(a)} AS total FROM acc GROUP BY segmento, centro_de_custo""" for a in names]
    return f""", long AS ({' UNION ALL '.join(parts)}),
lines AS (SELECT segmento, centro_de_custo, conta_contabil, CAST(round(abs(total), 2) AS DOUBLE) AS montante,
    CASE WHEN conta_contabil IN ('1131900000', '1212190000', '1132900002', '1132900001', '1132900003')
      THEN CASE WHEN total > 0 THEN 'C' ELSE 'D' END
      ELSE CASE WHEN total IS NULL OR total < 0 THEN 'C' ELSE 'D' END END AS chave_de_lancamento
  FROM long WHERE total IS NULL OR total <> 0)"""


def _journal(ctes, names, business, company):
    return f"""WITH {ctes}{_entries(names)}
SELECT {company} AS empresa, '30.06.1998' AS data_de_lancamento, 6 AS periodo, '30.06.1998' AS data_do_documento,
  'LM' AS tipo_de_documento, CAST(NULL AS VARCHAR) AS fornecedor, conta_contabil, 'BRL' AS moeda,
  CAST(NULL AS VARCHAR) AS filial, centro_de_custo, CAST(NULL AS VARCHAR) AS centro_de_lucro, segmento,
  CAST(NULL AS VARCHAR) AS tipo_de_movimento, CAST(NULL AS VARCHAR) AS sociedade_parceira, 'RVR 061998' AS referencia,
  CAST(NULL AS VARCHAR) AS texto_cabecalho, 'RVR {business} - MSG - 199806' AS texto_do_item, montante,
  chave_de_lancamento, CAST(NULL AS VARCHAR) AS usuario, 'S' AS tipo_de_conta, '0L' AS ledger FROM lines"""


def _conc(ctes, names):
    keys = ["ano_mes", "grupo_ramo", "cod_ramo", "cod_produto", "cod_sistema_origem", "segmento", "cod_agencia",
            "venc_vinc", "decorrer_e_decorrido", "aging_dias_nome", "condicoes_v2", "vigente", "status_parcela",
            "status_apolice", "status_cliente"]
    sums = ["val_cobranca", "val_iof", "val_comissao", "val_cosseguro", "val_estipulante", "val_comissao_cosseguro",
            "premio_resseguro", "calc_ppng_dec_atu", "calc_dcd_dec_atu", "rvr_atu_fnl", "rvr_atuarial", *names]
    return (f"WITH {ctes} SELECT {', '.join(keys)}, {', '.join(msum(m, f'sum_{m}') for m in sums)} "
            f"FROM acc GROUP BY {', '.join(keys)}")


AGING_SUMS = ["val_cobranca", "val_iof", "val_comissao", "val_estipulante", "val_cosseguro", "val_comissao_cosseguro",
              "premio_resseguro", "calc_ppng_dec_atu", "calc_dcd_dec_atu", "ppng_resseguro_atu", "estipulante_dec_atu",
              "rvr_atu_fnl", "rvr_atuarial", *[a for a in DIRECT if a != "C3152710000"]]
AGING_KEYS = "ano_mes, cod_tp_emissao, segmento, cod_sistema_origem, aging_dias_nome"
ANALYTIC = ", ".join(
    f"0.0 AS {c}" if c in ("val_custo_apolice", "val_adic_fracionamento") else c for c in R.ANALYTIC_COLUMNS
) + ", " + ", ".join(f"'' AS {b}" for b in R.ANALYTIC_BLANKS)

I1, I2, IF = "installments reinsurance_pct", "installments reinsurance_pct", "installments reinsurance_pct calc_group factors"

ORACLE = {
    "aging_summary": with_views(IF, f"""WITH {SUMMARY_SQL} SELECT {AGING_KEYS}, count(cod_apolice) AS qtde_apolice,
      {', '.join(msum(m, f'sum_{m}') for m in AGING_SUMS)} FROM acc GROUP BY {AGING_KEYS}"""),
    "reserve_base": with_views(I1, _sum_sql(BASE_SQL, "base", BASE_KEYS, BASE_SUMS)),
    "reserve_original_parts": with_views(I1, f"""WITH {BASE_SQL},
      o AS (SELECT *, base_ppng / CAST(dias_vigente AS DOUBLE) * CAST(dias_decorrer AS DOUBLE) AS cp,
        dcd_base / CAST(dias_vigente AS DOUBLE) * CAST(dias_decorrer AS DOUBLE) AS cd FROM base),
      p AS (SELECT aging_dias_nome, CASE WHEN dias_decorrer <= 0 OR dias_vigente <= 0 THEN 0.0
        WHEN cp > base_ppng THEN base_ppng ELSE cp END AS calc_ppng_dec_ori,
        CASE WHEN cd > dcd_base THEN dcd_base ELSE cd END AS calc_dcd_dec_ori FROM o)
      SELECT aging_dias_nome, count(*) AS n, {msum('calc_ppng_dec_ori', 'sum_calc_ppng_dec_ori')},
      {msum('calc_dcd_dec_ori', 'sum_calc_dcd_dec_ori')} FROM p GROUP BY aging_dias_nome"""),
    "reserve_drag": with_views(I1, _sum_sql(DRAG_SQL, "dragged", ["condicoes", "condicoes_v2", "aging_dias_nome", "aging_dias_nome_v2"], ["rvr"])),
    "worst_status_propagation": with_views(I1, f"""WITH {DRAG_SQL} SELECT cod_apolice, num_parcela, cpf_cnpj, dias, dias_min,
      condicoes_v2, aging_dias_nome_v2 FROM dragged"""),
    "reserve_status": with_views(I2, _sum_sql(STATUS_SQL, "status", STATUS_KEYS, STATUS_SUMS)),
    "group_having": with_views(I2, f"WITH {DRAG_SQL}, {POLICY_SQL} SELECT * FROM policy"),
    "nested_agg": with_views(I2, f"WITH {DRAG_SQL}, {POLICY_SQL} SELECT * FROM customers"),
    "group_extreme_attach": with_views(I2, f"""WITH {STATUS_SQL} SELECT cod_apolice, num_parcela, cod_produto, dt_vencimento,
      vigente, min_vcto_apolice, min_vcto_cliente FROM status"""),
    "group_min_max": with_views("factors", f"WITH {CLEAN_SQL} SELECT * FROM clean"),
    "reserve_factor": with_views(IF, _sum_sql(FACTOR_SQL, "final", ["grupo_calculo", "status_parcela", "agging_meses", "fator_atuarial"], ["rvr_atu_fnl", "rvr_atuarial"])),
    "reserve_accounts_direct": with_views(IF, _sum_sql(DIRECT_SQL, "acc", ["segmento", "centro_de_custo"], DIRECT)),
    "reserve_accounts_accepted": with_views(IF, _sum_sql(ACCEPTED_SQL, "acc", ["segmento", "centro_de_custo"], ACCEPTED)),
    "reserve_accounts_life": with_views(IF, _sum_sql(LIFE_SQL, "acc", ["segmento", "centro_de_custo"], LIFE)),
    "unpivot_accounts": with_views(IF, f"WITH {DIRECT_SQL}{_entries(DIRECT)} SELECT * FROM lines"),
    "journal": with_views(IF, _journal(DIRECT_SQL, DIRECT, "DIRETO", 2)),
    "journal_accepted": with_views(IF, _journal(ACCEPTED_SQL, ACCEPTED, "ACEITO", 2)),
    "journal_life": with_views(IF, _journal(LIFE_SQL, LIFE, "DIRETO", 20)),
    "reserve_conciliation": with_views(IF, _conc(DIRECT_SQL, DIRECT)),
    "reserve_conciliation_accepted": with_views(IF, _conc(ACCEPTED_SQL, ACCEPTED)),
    "conciliation": with_views(IF, f"""WITH {DIRECT_SQL},
      totals AS (SELECT segmento, centro_de_custo, {', '.join(f"{total(a)} AS {a}" for a in DIRECT)} FROM acc GROUP BY segmento, centro_de_custo),
      long AS (SELECT segmento, centro_de_custo, unnest([{', '.join(f"'{a[1:]}'" for a in DIRECT)}]) AS conta_contabil,
        unnest([{', '.join(DIRECT)}]) AS total FROM totals),
      booked AS (SELECT segmento, centro_de_custo, conta_contabil, CAST(round(abs(total), 2) AS DOUBLE)
          + CASE WHEN conta_contabil = '1131900000' THEN 1 ELSE 0 END AS montante
        FROM long WHERE conta_contabil <> '2125190000' AND (total IS NULL OR total <> 0)),
      sides AS (SELECT segmento, centro_de_custo, conta_contabil, abs(total) AS esperado, CAST(NULL AS DOUBLE) AS lancado FROM long
        UNION ALL SELECT segmento, centro_de_custo, conta_contabil, NULL, montante FROM booked)
      SELECT segmento, centro_de_custo, conta_contabil, CAST(round(max(esperado), 2) AS DOUBLE) AS esperado,
        round(max(lancado), 2) AS lancado,
        CASE WHEN abs(coalesce(max(esperado), 0) - coalesce(CAST(max(lancado) AS DECIMAL(18,6)), 0)) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status
      FROM sides GROUP BY segmento, centro_de_custo, conta_contabil"""),
    "analytic_base": with_views(IF, f"WITH {FACTOR_SQL} SELECT {ANALYTIC} FROM final"),
    "analytic_base_overdue": with_views(IF, f"WITH {FACTOR_SQL} SELECT {ANALYTIC} FROM final WHERE venc_vinc = 'Vencido'"),
    "currency_base": with_views(IF, f"""WITH {FACTOR_SQL} SELECT ano_mes, cod_tp_emissao, cod_moeda,
      {msum('rvr_atuarial', 'sum_rvr_atuarial')} FROM final GROUP BY ano_mes, cod_tp_emissao, cod_moeda"""),
}
