"""The receivables pipeline keeps policies where they lie and gives the same facts of policies and insured as a plain version."""

import datetime as dt

import pytest

from ledgerlift.functions import scalars as S
from ledgerlift.plans import reserve as R

ST = R.Settings(letters={"X": "B"}, undivided_system="X")
DAY = dt.date(1998, 6, 30)
SCHEMA = """ano_mes int, cod_seguradora int, cod_apolice long, num_parcela int, qtde_parcelas int, cod_tp_emissao string,
  cod_sistema_origem string, cod_produto long, grupo_ramo int, cod_ramo int, cod_agencia long, cod_moeda int, cpf_cnpj long,
  dt_inicio date, dt_fim date, dt_vencimento date, val_cobranca double, val_iof double, val_comissao double,
  val_estipulante double, val_cosseguro double, val_comissao_cosseguro double"""


def installments(spark):
    """Policies without a number, without an insured, without a charge, with a row that comes twice; one insured in two companies."""
    rows = []
    for i in range(400):
        policy, person = (None if i % 11 == 0 else i % 37), (None if i % 13 == 0 else i % 7)
        due = None if i % 17 == 0 else DAY + dt.timedelta(days=(i * 31) % 500 - 250)
        end = DAY + dt.timedelta(days=(i * 7) % 90 - 45)
        charge = -5.0 if (policy or 0) % 5 == 0 else 100.0 + i
        rows.append((199806, 6238 if i % 2 else 5665, policy, i % 7 + 1, 7, "D", "X", 1 + i % 2, 1, 3, 9, 790, person,
                     end - dt.timedelta(days=365), end, due, charge, 1.0, 2.0, 3.0, 4.0, 5.0))
    rows.append(rows[20])
    return spark.createDataFrame(rows, SCHEMA)


def shares(spark):
    return spark.createDataFrame([(3, 1, 0.2)], "cod_ramo int, cod_produto long, percentual_sas double")


def test_facts_of_policies_and_insured(spark):
    rows = installments(spark)
    least = lambda values: min((v for v in values if v is not None), default=None)
    flagged = R.flags(rows, ST).withColumn("_t", R.is_trigger()).collect()
    policies, people, worst = {}, {}, {}
    for r in flagged:
        policies.setdefault(tuple(r[k] for k in R.POLICY_KEYS), []).append(r)
        worst.setdefault(r.cpf_cnpj, []).append(r.dias if r._t else None)
    facts = {}
    for key, of in policies.items():
        if round(sum(r.val_cobranca for r in of), 6) > 0:
            over = max(r.dt_fim for r in of) < dt.date(1998, 7, 1)
            facts[key] = (least(r.dt_vencimento for r in of), "DECORRIDO" if over else "DECORRER")
            people.setdefault((key[0], key[1], key[6]), []).append(facts[key][0])
    want = sorted(
        str((key, *facts.get(key, (None, None)), least(people.get((key[0], key[1], key[6]), [])), least(worst[key[6]])))
        for key, of in policies.items() for _ in of)
    got = R.with_status(rows, shares(spark), ST).collect()
    assert want == sorted(str((tuple(r[k] for k in R.POLICY_KEYS), r.min_vcto_apolice, r.vigente, r.min_vcto_cliente, r.dias_min)) for r in got)


def test_policies_are_worked_out_in_their_buckets(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.with_status(installments(spark), shares(spark), ST)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Bucketed: true" in plan
    # the wide rows move to their insured and to their reinsured share, to no policy
    assert not any("cod_apolice" in line.split("plan_id")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_posted_rows_are_filtered_above_the_formula(spark, monkeypatch):
    monkeypatch.setattr(R, "stored", lambda df, label: pytest.fail("the wide rows are written"), raising=False)
    rows = R.earned(R.flags(R.with_amounts(R.rated(installments(spark), shares(spark))), ST)).withColumns(
        {"rvr_atu": S.F.col("rvr") * 1.5, "rvr_atu_negativa": S.F.lit("NAO")})
    want = [r for r in rows.collect() if r.inconsist != "S" and r.rvr_atu is not None and r.rvr_atu > 0]
    assert 0 < len(want) < 401 and sorted(map(str, R.postable(rows).collect())) == sorted(map(str, want))


def test_wide_rows_are_dealt_out_by_no_lookup(spark):
    """Only narrow keys and facts are shuffled; the small tables of groups and factors are known to be small."""
    groups = spark.range(5000).selectExpr("cast(id as int) % 3 as grupo_ramo", "cast(id as int) % 5 as cod_ramo", "'G1' as grupo_calculo").distinct()
    keys = {k: "6238" if k == "cod_seguradora" else "-1" if k == "agging_meses" else "'D'" for k in R.FACTOR_KEYS}
    factors = spark.range(500000).selectExpr(*[f"{v} as {k}" for k, v in keys.items()], "id / 1e6 as fator")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = R.pipeline(installments(spark), shares(spark), groups, factors, ST)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not any("Exchange hash" in a and "val_cobranca" in b for a, b in zip(plan, plan[1:]))


def test_shares_that_come_twice_or_without_a_product(spark):
    rows = installments(spark)
    twice = spark.createDataFrame([(3, 1, 0.2), (3, 1, 0.3), (3, None, 0.4)], "cod_ramo int, cod_produto long, percentual_sas double")
    some = ["cod_apolice", "num_parcela", "cpf_cnpj", "percentual_sas", "rvr"]
    want = R.base(rows, twice, ST).select(*some).collect()
    assert len(want) > 401 and sorted(map(str, R.with_status(rows, twice, ST).select(*some).collect())) == sorted(map(str, want))


def test_one_issue_type_keeps_the_insured_of_all(spark):
    rows = installments(spark).withColumn("cod_tp_emissao", S.F.expr("if(num_parcela % 2 = 0, 'A', 'D')"))
    every = R.with_status(rows, shares(spark), ST).where("cod_tp_emissao = 'A'").collect()
    assert sorted(map(str, R.with_status(rows, shares(spark), ST, "A").collect())) == sorted(map(str, every))
