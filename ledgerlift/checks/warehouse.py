"""Customer, policy, claims and reporting workloads."""

from __future__ import annotations

from ledgerlift.checks.common import rounded
from ledgerlift.operators import procs as P
from ledgerlift.operators.ordering import sort_by
from ledgerlift.plans import warehouse as W
from ledgerlift.plans.views import view, with_views


def _dim(s, d):
    return W.dim_customer(view(s, d, "customers_raw"), view(s, d, "addresses"))


def _claims(s, d):
    return W.fact_claims(view(s, d, "claims"), view(s, d, "policies"))


def _fact(s, d):
    return W.fact_policies(view(s, d, "policies"), _dim(s, d), view(s, d, "products"))


DIM = """dim AS (SELECT c.*, a.city, a.state FROM (SELECT * FROM customers_raw
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY load_seq) = 1) c
  LEFT JOIN addresses a ON c.customer_id = a.customer_id)"""
CLAIMS = """fc AS (SELECT c.*, p.customer_id, p.product_code, p.premium_amount, c.claim_amount / p.premium_amount AS ratio
  FROM claims c JOIN policies p ON c.policy_id = p.policy_id)"""
V = "customers_raw addresses policies products"

QUERIES = {
    "dim_customer": _dim,
    "dim_customer_freq": lambda s, d: P.freq(_dim(s, d), ["segment", "status"], percents=False),
    "dim_customer_means": lambda s, d: rounded(P.means(_dim(s, d), ["income", "risk_score"]), 4, "mean", "std"),
    "fact_policies": lambda s, d: sort_by(_fact(s, d), ["customer_id", "product_code"]),
    "fact_claims": _claims,
    "fact_claims_means": lambda s, d: rounded(P.means(_claims(s, d), ["claim_amount", "ratio"], class_cols=["claim_type"]), 4, "mean", "std", "min", "max"),
    "fact_claims_freq": lambda s, d: P.freq(_claims(s, d), ["claim_type", "status"], percents=False),
    "monthly_kpi_report": lambda s, d: rounded(P.monthly_kpi(_fact(s, d), "start_date", "customer_id", "premium_amount"), 4, "avg_premium"),
    "segment_scoring_profile": lambda s, d: rounded(
        W.segment_profile(_dim(s, d), "segment", ["income", "risk_score"]), 4, "mean", "std", "median", "p25", "p75"),
}


def _stats(v, digits=None):
    lo, hi = (f"min({v})", f"max({v})") if digits is None else (f"round(min({v}), {digits})", f"round(max({v}), {digits})")
    return (f"CAST(count({v}) AS DOUBLE) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, "
            f"CAST({lo} AS DOUBLE) AS min, CAST({hi} AS DOUBLE) AS max")


FACT = DIM + """, fact AS (SELECT p.*, k.customer_name, k.segment, r.product_name, r.category, true AS in_a,
    r.product_code IS NOT NULL AS in_b, p.premium_amount AS total_premium
  FROM policies p JOIN dim k ON p.customer_id = k.customer_id LEFT JOIN products r ON p.product_code = r.product_code)"""

ORACLE = {
    "dim_customer": with_views(V, f"WITH {DIM} SELECT * FROM dim"),
    "dim_customer_freq": with_views(V, f"WITH {DIM} SELECT segment, status, count(*) AS frequency FROM dim GROUP BY 1, 2"),
    "dim_customer_means": with_views(V, f"WITH {DIM} " + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {_stats(v)} FROM dim" for v in ("income", "risk_score"))),
    "fact_policies": with_views(V, f"WITH {FACT} SELECT * FROM fact"),
    "fact_claims": with_views("claims policies", f"WITH {CLAIMS} SELECT * FROM fc"),
    "fact_claims_means": with_views("claims policies", f"WITH {CLAIMS} " + " UNION ALL ".join(
        f"SELECT claim_type, '{v}' AS variable, {_stats(v, 4)} FROM fc GROUP BY claim_type" for v in ("claim_amount", "ratio"))),
    "fact_claims_freq": with_views("claims policies", f"WITH {CLAIMS} SELECT claim_type, status, count(*) AS frequency FROM fc GROUP BY 1, 2"),
    "monthly_kpi_report": with_views(V, f"""WITH {FACT} SELECT year(start_date) AS yr, month(start_date) AS mo,
      count(DISTINCT customer_id) AS unique_customers, count(*) AS total_policies,
      CAST(sum(CAST(premium_amount AS DECIMAL(18,6))) AS DOUBLE) AS total_premium, round(avg(premium_amount), 4) AS avg_premium
      FROM fact GROUP BY 1, 2"""),
    "segment_scoring_profile": with_views(V, f"WITH {DIM} " + " UNION ALL ".join(
        f"""SELECT segment, '{v}' AS variable, {_stats(v)}, round(quantile_cont({v}, 0.5), 4) AS median,
        round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.75), 4) AS p75 FROM dim GROUP BY segment"""
        for v in ("income", "risk_score"))),
}
