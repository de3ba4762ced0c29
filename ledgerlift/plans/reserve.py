"""The insurance receivables pipeline: from installments to journal entries.

Stages are DataFrame -> DataFrame. The installments are written once in buckets by policy number; a few
columns are read for the facts of policies and insured, then all of them, where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.functions import scalars as S
from ledgerlift.functions.semantics import clamp, eq, gt, lt, money_sum, money_total
from ledgerlift.operators.joins import lookup_join
from ledgerlift.operators.keys import attach, left_col, match, right_col
from ledgerlift.operators.ordering import attach_group_extreme
from ledgerlift.operators.reshape import unpivot
from ledgerlift.operators.steps import (
    AGING_AHEAD, add_constants, aging_bucket, data_step, decision_table, inconsistency_flag,
)
from ledgerlift.session import bucketed, buckets, compiled_methods, join_in_buckets, stored

# Amounts a source may lack; an absent one counts as zero.
OPTIONAL_AMOUNTS = [
    "val_custo_apolice", "val_adic_fracionamento", "val_adic_fracionamento_cosseguro",
    "val_comissao_cosseguro", "val_estipulante_cosseguro", "val_comissao_resseguro",
    "val_comissao_agenciamento", "val_remuneracao_representante",
]

# Letter of each source system in the segment code.
SYSTEM_LETTERS = {
    "TRONADOR_MFG": "G", "TRONWEB_MSG": "R", "TRONADOR_MSG": "S", "NEUTRON": "M",
    "VIDANOVA": "N", "vidanova": "N", "VidaNova": "N", "SIES": "O", "TRONADOR_AFF": "Y",
    "TRONWEB": "R", "TRONWEB_BV": "C", "TRONWEB_AFF": "F",
}
SYSTEM_LETTERS_LIFE = {
    "MVP": "T", "SIES": "V", "TRONADOR_MVIDA": "P", "TRONADOR_MVI": "P", "VIDANOVA": "J",
    "CORPORATIVO": "9", "TRONWEB_MVID": "X", "TRONWEB_MVIDA": "X",
}
# Products of the system whose installments are never divided.
UNDIVIDED_PRODUCTS = [5, 278, 770, 997, 998]
# Shares of the reinsured part per account.
REINSURANCE_DIRECT = {"C2123190000": 0.41, "C2123390000": 0.51, "C2123590000": 0.08}
REINSURANCE_ACCEPTED = {"C2123290001": 0.90, "C2123390001": 0.07, "C2123590001": 0.03}
REINSURANCE_LIFE = {"C2123190000": 0.35, "C2123390000": 0.19, "C2123590000": 0.45}
# Accounts whose positive amounts are credited.
RECEIVABLE_ACCOUNTS = ["1131900000", "1212190000", "1132900002", "1132900001", "1132900003"]
# Document fields of every journal line.
JOURNAL_CONSTANTS = {"tipo_de_conta": "S", "ledger": "0L", "empresa": 2, "tipo_de_documento": "LM", "moeda": "BRL"}
JOURNAL_COLUMNS = [
    "empresa", "data_de_lancamento", "periodo", "data_do_documento", "tipo_de_documento",
    "fornecedor", "conta_contabil", "moeda", "filial", "centro_de_custo", "centro_de_lucro",
    "segmento", "tipo_de_movimento", "sociedade_parceira", "referencia", "texto_cabecalho",
    "texto_do_item", "montante", "chave_de_lancamento", "usuario", "tipo_de_conta", "ledger",
]
JOURNAL_BLANKS = [
    "fornecedor", "filial", "centro_de_lucro", "tipo_de_movimento", "sociedade_parceira",
    "texto_cabecalho", "usuario",
]


@dataclass
class Settings:
    """Reference month and the document texts of one run."""

    ref_date: str = "1998-06-30"
    company: str = "MSG"
    cost_prefix: str = "C0002"
    letters: dict = field(default_factory=lambda: dict(SYSTEM_LETTERS))
    undivided_system: str = "VIDANOVA"

    @property
    def ref(self) -> Column:
        return F.lit(self.ref_date).cast("date")

    @property
    def month(self) -> int:
        return int(self.ref_date[:4]) * 100 + int(self.ref_date[5:7])


def reserve_amount(suffix: str = "") -> Column:
    """Reserve of an installment from its net charge and the parts still to be earned."""
    c = F.col
    net = (
        c("val_cobranca") - c("val_iof") - c("val_adic_fracionamento") - c("val_comissao")
        - c("val_cosseguro") - c("val_estipulante") - c("val_adic_fracionamento_cosseguro")
        + c("val_comissao_cosseguro") + c("val_estipulante_cosseguro") + c("val_comissao_resseguro")
        - c("val_comissao_agenciamento") - c("val_remuneracao_representante")
    )
    return (
        net + c("agenciamento_dec" + suffix) + c("calc_dcd_dec" + suffix) - c("calc_ppng_dec" + suffix)
        - c("dcd_resseguro" + suffix) + c("estipulante_dec" + suffix) + c("ppng_resseguro" + suffix)
        - c("premio_resseguro") + c("remuneracao_dec" + suffix)
    )


def earned_parts(factor: str, suffix: str = "") -> dict[str, Column]:
    """Amounts still to be earned under a pro-rata factor."""
    c, f = F.col, F.col(factor)
    return {
        "calc_ppng_dec" + suffix: c("base_ppng") * f,
        "calc_dcd_dec" + suffix: c("dcd_base") * f,
        "estipulante_dec" + suffix: (c("val_estipulante") - c("val_estipulante_cosseguro")) * f,
        "agenciamento_dec" + suffix: c("val_comissao_agenciamento") * f,
        "remuneracao_dec" + suffix: c("val_remuneracao_representante") * f,
        "ppng_resseguro" + suffix: c("base_ppng") * f * c("percentual_sas"),
        "dcd_resseguro" + suffix: c("val_comissao_resseguro") * f,
    }


def flags(installments: DataFrame, st: Settings) -> DataFrame:
    """Dates, quality flag, aging bucket and condition of every installment; needs no lookup."""
    c, ref = F.col, st.ref
    invalid = c("inconsist") == "S"
    expired, overdue = c("decorrer_e_decorrido") == "Decorrido", c("venc_vinc") == "Vencido"
    days = {
        "mes_ref": ref,
        "dias": S.days_between(c("dt_vencimento"), ref),
        "dias_vigente": S.days_between(c("dt_fim"), c("dt_inicio"), inclusive=True),
        "venc_vinc": F.when(lt(c("dt_vencimento"), ref), "Vencido").otherwise("A Vencer"),
        "decorrer_e_decorrido": F.when(lt(c("dt_fim"), ref), "Decorrido").otherwise("Decorrer"),
        "inconsist": inconsistency_flag(
            zero=["cod_agencia"],
            missing_or_zero=["cod_produto", "grupo_ramo", "cod_ramo", "cpf_cnpj"],
            dates=["dt_inicio", "dt_fim", "dt_vencimento"],
            ordered=("dt_inicio", "dt_fim"),
        ),
        "dias_decorrer": F.when(lt(c("dt_fim"), ref), 0).otherwise(
            S.days_between(c("dt_fim"), ref, inclusive=True)
        ),
    }
    labels = {
        "fator_decorrer": S.prorata_days(c("dias_decorrer"), c("dias_vigente"), invalid),
        "aging_dias_nome": aging_bucket(c("dias"), invalid),
        "condicoes": decision_table(
            [
                (expired & overdue, "CONDICAO_1"),
                (expired & ~overdue, "CONDICAO_2"),
                (~expired & overdue & lt(c("dias"), 0), "CONDICAO_3"),
                (~expired & ~overdue, "CONDICAO_4"),
            ],
            "CONDICAO_F",
        ),
    }
    return data_step(installments, [days, labels])


# Keys of a reinsured share.
REINSURANCE_KEYS = ["cod_ramo", "cod_produto"]


def rated(installments: DataFrame, reinsurance: DataFrame) -> DataFrame:
    """Installments with the reinsured share of their line and product."""
    return lookup_join(installments, reinsurance, REINSURANCE_KEYS)


def earned(flagged: DataFrame) -> DataFrame:
    """Earned parts and reserve of every rated and flagged installment."""
    c = F.col
    amounts = {
        "percentual_sas": F.coalesce("percentual_sas", F.lit(0.0)),
        "base_ppng": c("val_cobranca") - c("val_cosseguro") - c("val_iof") - c("val_adic_fracionamento")
        - c("val_adic_fracionamento_cosseguro") - c("val_custo_apolice"),
        "dcd_base": c("val_comissao") - c("val_comissao_cosseguro"),
    }
    parts = {
        **earned_parts("fator_decorrer"),
        "premio_resseguro": (c("val_cobranca") - c("val_cosseguro") - c("val_iof")) * c("percentual_sas"),
    }
    return data_step(flagged, [amounts, parts, {"rvr": reserve_amount()}])


def with_amounts(installments: DataFrame) -> DataFrame:
    """Amounts the source lacks, as zeros."""
    return installments.withColumns({a: F.lit(0.0) for a in OPTIONAL_AMOUNTS if a not in installments.columns})


def base(installments: DataFrame, reinsurance: DataFrame, st: Settings) -> DataFrame:
    """Flags, earned parts and reserve of every installment."""
    return earned(flags(with_amounts(rated(installments, reinsurance)), st))


def original_parts(df: DataFrame) -> DataFrame:
    """Earned parts by day ratio, capped at the whole amount; the earlier method kept beside the new.

    The zero guard of the commission part is overwritten by the step after it, so a zero
    term gives a missing commission part here while the charge part stays guarded.
    """
    c = F.col
    term, left = c("dias_vigente").cast("double"), c("dias_decorrer").cast("double")
    charge = F.try_divide(c("base_ppng"), term) * left
    commission = F.try_divide(c("dcd_base"), term) * left
    return df.withColumns({
        "calc_ppng_dec_ori": F.when((left <= 0) | (term <= 0), F.lit(0.0))
        .when(gt(charge, c("base_ppng")), c("base_ppng")).otherwise(charge),
        "calc_dcd_dec_ori": F.when(gt(commission, c("dcd_base")), c("dcd_base")).otherwise(commission),
    })


# Keys of a policy, an insured and a factor.
POLICY_KEYS = [
    "ano_mes", "cod_seguradora", "cod_tp_emissao", "cod_sistema_origem", "cod_produto",
    "cod_apolice", "cpf_cnpj",
]
CUSTOMER_KEYS = ["ano_mes", "cod_seguradora", "cpf_cnpj"]
# Column by which installments lie in buckets.
NUMBER = "_number"


def numbered(installments: DataFrame) -> DataFrame:
    """Add the policy number, never missing: rows without one are spread by their insured."""
    kind = installments.schema["cod_apolice"].dataType
    spread = F.pmod(F.xxhash64(*CUSTOMER_KEYS), F.lit(2**31 - 1)).cast(kind)
    return installments.withColumn(NUMBER, F.coalesce("cod_apolice", spread))


def _policy(df: DataFrame) -> list[str]:
    """Keys of a policy, led by the bucket column where the rows have it."""
    return [c for c in (NUMBER,) if c in df.columns] + POLICY_KEYS


def met(rows: DataFrame, of: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Beside every row the columns of `facts` for its `on` keys, while the rows stay in their buckets by NUMBER.

    Only the different keys of a number, read from `of`, move to the facts; what is found moves back to the buckets.
    """
    join_in_buckets(rows.sparkSession)
    found = attach(of.select(NUMBER, *on).distinct(), facts, on, how="inner")
    found = found.repartition(buckets(rows.sparkSession), NUMBER)
    here = (left_col(NUMBER) == right_col(NUMBER)) & match(on)
    return rows.alias("_l").join(found.alias("_r"), here, "left").select(
        *[left_col(c) for c in rows.columns], *[right_col(c) for c in facts.columns if c not in on]
    )


def is_trigger() -> Column:
    """Overdue installments that drag the others of their insured."""
    return F.col("condicoes").isin("CONDICAO_1", "CONDICAO_3") & (F.col("inconsist") == "N")


def policy_grain(flagged: DataFrame) -> DataFrame:
    """Per policy: latest end, earliest due date, charge, worst trigger; few columns are read."""
    return flagged.groupBy(*_policy(flagged)).agg(
        F.max("dt_fim").alias("last_end"),
        F.min("dt_vencimento").alias("first_due"),
        money_total(F.col("val_cobranca")).alias("charge"),
        F.min(F.when(is_trigger(), F.col("dias"))).alias("worst"),
    )


def policy_delinquency(grain: DataFrame, st: Settings) -> DataFrame:
    """Policies with a positive charge: earliest due date, in force or over."""
    over = lt(F.col("last_end"), S.next_period(st.ref))
    return grain.where(F.col("charge") > 0).select(
        *POLICY_KEYS, F.col("first_due").alias("min_vcto_apolice"),
        F.when(over, "DECORRIDO").otherwise("DECORRER").alias("vigente"),
    )


def customer_delinquency(grain: DataFrame) -> DataFrame:
    """Earliest due date of an insured's policies with a positive charge."""
    return (
        grain.where(F.col("charge") > 0)
        .groupBy(*CUSTOMER_KEYS).agg(F.min("first_due").alias("min_vcto_cliente"))
    )


def worst_per_insured(grain: DataFrame) -> DataFrame:
    return grain.where(F.col("worst").isNotNull()).groupBy("cpf_cnpj").agg(F.min("worst").alias("dias_min"))


def with_policy(rows: DataFrame, st: Settings) -> DataFrame:
    """Beside every installment what `policy_delinquency` says of its policy; missing without a positive charge.

    A window, so rows that lie in buckets by policy number stay there; a policy's rows may spill, not fail.
    """
    policy = Window.partitionBy(*_policy(rows))
    counted = money_total(F.col("val_cobranca"), policy) > 0
    over = lt(F.max("dt_fim").over(policy), S.next_period(st.ref))
    return rows.withColumns({
        "min_vcto_apolice": F.when(counted, F.min("dt_vencimento").over(policy)),
        "vigente": F.when(counted, F.when(over, "DECORRIDO").otherwise("DECORRER")),
    })


def insured(grain: DataFrame) -> DataFrame:
    """Per insured of a company: earliest due date of its policies with a positive charge, worst trigger of the insured anywhere."""
    own = stored(grain.groupBy(*CUSTOMER_KEYS).agg(
        F.min(F.when(F.col("charge") > 0, F.col("first_due"))).alias("min_vcto_cliente"), F.min("worst").alias("worst"),
    ), "insured")
    return attach_group_extreme(own.drop("worst"), worst_per_insured(own), ["cpf_cnpj"])


def drag(df: DataFrame) -> DataFrame:
    """An insured's oldest overdue installment (dias_min) re-labels all its other installments."""
    c, trigger = F.col, is_trigger()
    invalid = c("inconsist") == "S"
    own = trigger | c("dias_min").isNull()
    days = F.when(own, c("dias")).otherwise(c("dias_min"))
    return df.withColumns({
        "condicoes_v2": F.when(invalid, F.lit("CONDICAO_F")).when(trigger, c("condicoes"))
        .when(c("dias_min").isNotNull(), F.lit("CONDICAO_5")).otherwise(F.lit("CONDICAO_0")),
        "aging_dias_nome_v2": aging_bucket(days, invalid),
    })


def status(df: DataFrame, st: Settings) -> DataFrame:
    """Delinquency of installment, policy and insured, months late, updated reserve."""
    c, ref, following = F.col, st.ref, S.next_period(st.ref)

    def late(due: str) -> Column:
        return F.when(lt(c(due), following), "INADIMPLENTE").otherwise("ADIMPLENTE")

    undivided = (c("cod_sistema_origem") == st.undivided_system) & c("cod_produto").isin(UNDIVIDED_PRODUCTS)
    lo, hi = S.installment_window(
        c("dt_inicio"), c("dt_fim"), c("qtde_parcelas"), c("num_parcela"), F.coalesce(undivided, F.lit(False))
    )
    by_policy = (c("status_apolice") == "INADIMPLENTE") & (c("status_parcela") == "ADIMPLENTE")
    own = {
        "status_vigencia": c("vigente"),
        "status_parcela": late("dt_vencimento"),
        "agging_vcto_parcela": S.months_late(c("dt_vencimento"), ref),
        "agging_vcto_apolice": S.months_late(c("min_vcto_apolice"), ref),
        "agging_vcto_cliente": S.months_late(c("min_vcto_cliente"), ref),
        "_lo": lo,
        "_hi": hi,
    }
    by_contract = {
        "status_apolice": F.when(c("status_parcela") == "INADIMPLENTE", c("status_parcela"))
        .otherwise(late("min_vcto_apolice")),
        "fator_decorrer_atu": S.prorata_window(c("_lo"), c("_hi"), S.day_number(ref).cast("double")),
    }
    by_insured = {
        "status_cliente": F.when(c("status_apolice") == "INADIMPLENTE", c("status_apolice"))
        .otherwise(late("min_vcto_cliente")),
        "ref_agging": F.when(by_policy, "vcto apolice").otherwise("vcto parcela"),
        "agging_meses": F.when(c("status_apolice") == "ADIMPLENTE", F.lit(-1))
        .when(by_policy, clamp(c("agging_vcto_apolice"), 0, 13))
        .otherwise(clamp(c("agging_vcto_parcela"), 0, 13)),
        **earned_parts("fator_decorrer_atu", "_atu"),
    }
    negative = lt(c("rvr_atu"), 0.0)
    usable = {
        "rvr_atu_negativa": F.when(negative, "SIM").otherwise("NAO"),
        "rvr_atu_fnl": F.when((c("inconsist") == "S") | negative, F.lit(0.0)).otherwise(c("rvr_atu")),
    }
    steps = [own, by_contract, by_insured, {"rvr_atu": reserve_amount("_atu")}, usable]
    return data_step(df, steps, drop=["_lo", "_hi"])


FACTOR_KEYS = [
    "cod_seguradora", "cod_tp_emissao", "status_vigencia", "status_cliente", "status_apolice",
    "status_parcela", "agging_meses", "ref_agging", "grupo_calculo",
]


def clean_factors(factors: DataFrame, value: str = "fator") -> DataFrame:
    """Largest factor per key, clipped to [0, 1]; a missing factor becomes 0."""
    top = factors.groupBy(*FACTOR_KEYS).agg(F.max(value).alias("fator_atuarial"))
    return top.withColumn("fator_atuarial", clamp(F.col("fator_atuarial"), 0.0, 1.0))


def factor(df: DataFrame, groups: DataFrame, factors: DataFrame) -> DataFrame:
    """Calculation group with its two overrides, nine-key factor, actuarial reserve.

    A key without a factor leaves factor and reserve missing. Both tables are written first: Spark then knows how few
    rows they hold before it deals out the installments by their keys.
    """
    c = F.col
    out = lookup_join(df, stored(groups, "groups"), ["grupo_ramo", "cod_ramo"])
    out = out.withColumn(
        "grupo_calculo",
        F.when((c("cod_seguradora") == 6238) & (c("cod_produto") == 216), "Localiza")
        .when(c("cod_seguradora") == 5665, "Pessoas").otherwise(c("grupo_calculo")),
    )
    out = lookup_join(out, stored(clean_factors(factors), "factors"), FACTOR_KEYS, ["fator_atuarial"])
    return out.withColumn("rvr_atuarial", c("rvr_atu_fnl") * c("fator_atuarial"))


def with_status(installments: DataFrame, reinsurance: DataFrame, st: Settings, issue: str | None = None) -> DataFrame:
    """Installments with reserve, drag and delinquency; of one issue type, if given, among the insured of all.

    The installments are written once, as they came, in buckets by policy number, and their wide rows are never shuffled again:
    policies are worked out in their buckets; insured and reinsured shares come to them. Flags and amounts, cheap to
    work out twice, are neither written nor shuffled.
    """
    compiled_methods(installments.sparkSession)
    rows = bucketed(numbered(installments), "installments", NUMBER)
    people = insured(policy_grain(flags(rows, st)))
    if issue is not None:
        rows = rows.where(F.col("cod_tp_emissao") == issue)
    known = met(with_policy(rows, st), rows, people, CUSTOMER_KEYS)
    known = met(known, rows, reinsurance, REINSURANCE_KEYS).drop(NUMBER)
    return status(drag(earned(flags(with_amounts(known), st))), st)


def pipeline(installments: DataFrame, reinsurance: DataFrame, groups: DataFrame, factors: DataFrame,
             st: Settings) -> DataFrame:
    """All installments with reserve, status and factor."""
    return factor(with_status(installments, reinsurance, st), groups, factors)


def postable(df: DataFrame) -> DataFrame:
    """Consistent rows with a positive reserve. Select issue types before.

    Pushed below the reserve formula, the filter would carry all of it, worked out in place of every name, and each
    row would be computed twice; a row id, which no filter passes, keeps it above.
    """
    usable = (F.col("inconsist") != "S") & (F.col("rvr_atu_negativa") != "SIM") & (F.col("rvr_atu") > 0)
    return df.withColumn("_row", F.monotonically_increasing_id()).where(usable & (F.col("_row") >= 0)).drop("_row")


def segment(st: Settings, product_tail: bool = False) -> Column:
    """Group, line, product digits and system letter; the life variant cuts a five-digit product."""
    product = S.put_z(F.col("cod_produto"), 4)
    if product_tail:
        product = S.substr(S.put_z(F.col("cod_produto"), 5), 2, 4)
    letter = S.value_map(F.col("cod_sistema_origem"), st.letters)
    return S.cats(S.put_z(F.col("grupo_ramo"), 2), S.put_z(F.col("cod_ramo"), 3), product, letter)


def _net_reinsurance() -> Column:
    return (
        F.col("premio_resseguro") - F.col("ppng_resseguro_atu") + F.col("dcd_resseguro_atu")
        - F.col("val_comissao_resseguro")
    )


def accounts_direct(df: DataFrame, st: Settings, life: bool = False) -> DataFrame:
    """Account amounts of direct business with the residual account, segment and cost centre.

    Charges more than a year ahead go to the long-term receivable, except in the life
    variant, which has no such account.
    """
    c, f = F.col, F.col("fator_atuarial")
    receivable = f * (c("val_cobranca") - c("calc_ppng_dec_atu") - c("val_iof") - c("val_adic_fracionamento"))
    far = c("aging_dias_nome") == AGING_AHEAD[-1]
    shares = REINSURANCE_LIFE if life else REINSURANCE_DIRECT
    accounts = {"C1131900000": receivable if life else F.when(far, F.lit(0.0)).otherwise(receivable)}
    if not life:
        accounts["C1212190000"] = F.when(far, receivable).otherwise(F.lit(0.0))
    accounts |= {
        "C2125190000": f * (c("val_comissao") - c("calc_dcd_dec_atu")),
        "C2128900000": f * (
            c("val_comissao_agenciamento") + c("val_remuneracao_representante") + c("val_estipulante")
            - c("agenciamento_dec_atu") - c("remuneracao_dec_atu") - c("estipulante_dec_atu")
        ),
        "C2122290000": f * (
            c("val_cosseguro") - c("val_adic_fracionamento_cosseguro") - c("val_estipulante_cosseguro")
        ),
        **{a: f * part for a, part in S.weighted_split(_net_reinsurance(), shares).items()},
        "C1132900002": f * c("val_comissao_cosseguro"),
    }
    receivables = ["C1131900000"] if life else ["C1131900000", "C1212190000"]
    payables = ["C2125190000", "C2128900000", "C2122290000", *shares]
    return _finish_accounts(df, accounts, receivables, payables, "C1132900002", "C3152710000", st, life)


def accounts_accepted(df: DataFrame, st: Settings) -> DataFrame:
    """Account amounts of accepted business."""
    c, f = F.col, F.col("fator_atuarial")
    accounts = {
        "C1132900001": f * (
            c("val_cobranca") - c("calc_ppng_dec_atu") - c("val_iof") - c("val_adic_fracionamento")
            - c("val_cosseguro") - c("val_adic_fracionamento_cosseguro") + c("val_estipulante_cosseguro")
        ),
        "C2125290000": f * (c("val_comissao") - c("calc_dcd_dec_atu")),
        **{a: f * part for a, part in S.weighted_split(_net_reinsurance(), REINSURANCE_ACCEPTED).items()},
        "C1132900003": f * c("val_comissao_cosseguro"),
    }
    payables = ["C2125290000", *REINSURANCE_ACCEPTED]
    return _finish_accounts(df, accounts, ["C1132900001"], payables, "C1132900003", "C3152710001", st, False)


def _finish_accounts(df, accounts, receivables, payables, commission, residual, st, life) -> DataFrame:
    total = F.col(receivables[0])
    for a in receivables[1:]:
        total = total + F.col(a)
    for a in payables:
        total = total - F.col(a)
    codes = {
        "segmento": segment(st, product_tail=life),
        "centro_de_custo": S.cats(F.lit(st.cost_prefix), S.put_z(F.col("cod_agencia"), 4)),
    }
    return data_step(df, [{**accounts, **codes}, {residual: total + F.col(commission)}])


def account_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "C" and c[1:].isdigit()]


def account_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("segmento", "centro_de_custo").agg(
        *[money_total(F.col(a)).alias(a) for a in account_names(df)]
    )


def entries(totals: DataFrame) -> DataFrame:
    """Totals to one row per account with side and positive amount; zero rows are left out.

    A missing amount counts as below zero, so it stays.
    """
    names = account_names(totals)
    long = unpivot(totals, ["segmento", "centro_de_custo"], {a: a[1:] for a in names}, "conta_contabil", "_total")
    amount = F.col("_total")
    receivable = F.col("conta_contabil").isin(RECEIVABLE_ACCOUNTS)
    return long.where(~eq(amount, 0)).select(
        "segmento", "centro_de_custo", "conta_contabil",
        F.round(F.abs(amount), 2).cast("double").alias("montante"),
        S.entry_side(amount, receivable).alias("chave_de_lancamento"),
    )


def journal(accounts: DataFrame, st: Settings, business: str, company_code: int = 2) -> DataFrame:
    """Journal lines in the column order of the ledger import."""
    return journal_of(account_totals(accounts), st, business, company_code)


def journal_of(totals: DataFrame, st: Settings, business: str, company_code: int = 2) -> DataFrame:
    """Journal lines from the account totals."""
    day = f"{st.ref_date[8:]}.{st.ref_date[5:7]}.{st.ref_date[:4]}"
    constants = {
        **JOURNAL_CONSTANTS,
        "empresa": company_code,
        "periodo": int(st.ref_date[5:7]),
        "data_de_lancamento": day,
        "data_do_documento": day,
        "referencia": f"RVR {st.ref_date[5:7]}{st.ref_date[:4]}",
        "texto_do_item": f"RVR {business} - {st.company} - {st.month}",
        **{b: None for b in JOURNAL_BLANKS},
    }
    return add_constants(entries(totals), constants).select(*JOURNAL_COLUMNS)


def conciliation_totals(accounts: DataFrame) -> DataFrame:
    """Grouped totals of the posted detail, as the reconciliation sheet lists them."""
    keys = [
        "ano_mes", "grupo_ramo", "cod_ramo", "cod_produto", "cod_sistema_origem", "segmento",
        "cod_agencia", "venc_vinc", "decorrer_e_decorrido", "aging_dias_nome", "condicoes_v2",
        "vigente", "status_parcela", "status_apolice", "status_cliente",
    ]
    measures = [
        "val_cobranca", "val_iof", "val_comissao", "val_cosseguro", "val_estipulante",
        "val_comissao_cosseguro", "premio_resseguro", "calc_ppng_dec_atu", "calc_dcd_dec_atu",
        "rvr_atu_fnl", "rvr_atuarial", *account_names(accounts),
    ]
    return accounts.groupBy(*keys).agg(*[money_sum(F.col(m)).alias(f"sum_{m}") for m in measures])


def conciliation(totals: DataFrame, posted: DataFrame) -> DataFrame:
    """Account totals of the detail against the lines in the ledger, per segment and cost centre."""
    names = account_names(totals)
    detail = unpivot(
        totals, ["segmento", "centro_de_custo"],
        {a: a[1:] for a in names}, "conta_contabil", "_total",
    ).withColumn("esperado", F.abs("_total")).drop("_total")
    booked = posted.groupBy("segmento", "centro_de_custo", "conta_contabil").agg(
        F.sum(F.col("montante").cast("decimal(28,6)")).alias("lancado")
    )
    joined = detail.join(booked, ["segmento", "centro_de_custo", "conta_contabil"], "full")
    gap = F.coalesce("esperado", F.lit(0)) - F.coalesce("lancado", F.lit(0))
    return joined.select(
        "segmento", "centro_de_custo", "conta_contabil",
        F.round("esperado", 2).cast("double").alias("esperado"),
        F.round("lancado", 2).cast("double").alias("lancado"),
        F.when(F.abs(gap) <= 0.01, "PASS").otherwise("FAIL").alias("status"),
    )


def aging_summary(df: DataFrame, st: Settings) -> DataFrame:
    """Counts and totals by month, issue type, segment, system and aging bucket."""
    df = accounts_direct(df, st)
    keys = ["ano_mes", "cod_tp_emissao", "segmento", "cod_sistema_origem", "aging_dias_nome"]
    measures = [
        "val_cobranca", "val_iof", "val_comissao", "val_estipulante", "val_cosseguro",
        "val_comissao_cosseguro", "premio_resseguro", "calc_ppng_dec_atu", "calc_dcd_dec_atu",
        "ppng_resseguro_atu", "estipulante_dec_atu", "rvr_atu_fnl", "rvr_atuarial",
        *[a for a in account_names(df) if a != "C3152710000"],
    ]
    return df.groupBy(*keys).agg(
        F.count("cod_apolice").alias("qtde_apolice"),
        *[money_sum(F.col(m)).alias(f"sum_{m}") for m in measures],
    )


def currency_base(df: DataFrame) -> DataFrame:
    return df.groupBy("ano_mes", "cod_tp_emissao", "cod_moeda").agg(
        money_sum(F.col("rvr_atuarial")).alias("sum_rvr_atuarial")
    )


# Columns of the analytic base.
ANALYTIC_COLUMNS = [
    "ano_mes", "cod_seguradora", "cod_apolice", "cod_produto", "cod_agencia", "cod_tp_emissao",
    "cod_moeda", "dt_inicio", "dt_fim", "qtde_parcelas", "dt_vencimento", "num_parcela",
    "grupo_ramo", "cod_ramo", "val_cobranca", "val_iof", "val_custo_apolice",
    "val_adic_fracionamento", "val_comissao", "val_estipulante", "val_cosseguro",
    "val_comissao_cosseguro", "cod_sistema_origem", "cpf_cnpj", "aging_dias_nome", "condicoes",
    "condicoes_v2", "decorrer_e_decorrido", "dias", "dias_decorrer", "dias_vigente",
    "venc_vinc", "aging_dias_nome_v2", "fator_atuarial",
]
# Columns the analytic base carries blank.
ANALYTIC_BLANKS = [
    "fator_atuarial_txt", "C1131900000", "C2125190000", "C2128900000", "C2122290000",
    "C2123190000", "C2123390000", "C2123590000", "C1132900002",
]


def analytic_base(df: DataFrame, overdue_only: bool = False) -> DataFrame:
    """Wide projection with blank account columns; optionally the overdue rows alone."""
    out = df.where(F.col("venc_vinc") == "Vencido") if overdue_only else df
    return add_constants(out.select(*ANALYTIC_COLUMNS), {b: "" for b in ANALYTIC_BLANKS})
