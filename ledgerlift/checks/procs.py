"""Summary procedures and ordered-group operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.checks.common import msum, rounded
from ledgerlift.functions.informats import put_dollar
from ledgerlift.functions.semantics import money_sum
from ledgerlift.operators import ordering as O
from ledgerlift.operators import procs as P
from ledgerlift.plans import warehouse as W
from ledgerlift.plans.views import view, with_views


def _cust(s, d):
    return view(s, d, "customers_raw")


def _stats(df, *extra):
    return rounded(df, 4, "mean", "std", *extra)


def _value_list(s, d):
    return P.value_list(view(s, d, "events"), "event_type")


def _tabulate_across(s, d):
    return P.tabulate(view(s, d, "policies"), ["product_code"],
                      {"n": F.count(F.lit(1)), "premium": money_sum(F.col("premium_amount"))},
                      "status", ["F", "O", "P"])


def _report(s, d):
    kpi = P.monthly_kpi(view(s, d, "policies"), "start_date", "customer_id", "premium_amount")
    out = P.report(kpi, ["yr"], ["unique_customers", "total_policies", "total_premium"], ["avg_premium"])
    return out.withColumns({
        "avg_premium": F.round("avg_premium", 4),
        "total_shown": put_dollar(F.col("total_premium").cast("decimal(20,2)")),
    })


QUERIES = {
    "freq_oneway": lambda s, d: rounded(P.freq(_cust(s, d), ["status"]), 6, "percent"),
    "freq_oneway_no_missing": lambda s, d: rounded(P.freq(_cust(s, d), ["status"], missing=False), 6, "percent"),
    "freq_crosstab": lambda s, d: rounded(P.freq(_cust(s, d), ["segment", "status"]), 6, "percent", "row_percent", "col_percent"),
    "freq_cumulative": lambda s, d: rounded(P.freq(view(s, d, "lineitem"), ["l_partkey"], cumulative=True), 6, "percent", "cum_percent"),
    "pct_of_total": lambda s, d: rounded(P.freq(view(s, d, "events"), ["user_id", "event_type"]), 6, "percent", "row_percent", "col_percent"),
    "means": lambda s, d: _stats(P.means(_cust(s, d), ["income", "risk_score"], ["n", "n_rows", "nmiss", "mean", "std", "min", "max"])),
    "means_class": lambda s, d: _stats(P.means(_cust(s, d), ["income", "risk_score"], class_cols=["segment", "status"], all_ways=True)),
    "means_class_nway": lambda s, d: _stats(P.means(view(s, d, "events"), ["value"], class_cols=["user_id"])),
    "univariate": lambda s, d: _stats(P.univariate(_cust(s, d), ["income", "risk_score"]), "median", "p25", "p75"),
    "univariate_by": lambda s, d: _stats(P.univariate(view(s, d, "lineitem"), ["l_extendedprice"], ["l_suppkey"]), "median", "p25", "p75"),
    "approx_quantiles": lambda s, d: P.approx_quantiles(view(s, d, "lineitem"), ["l_extendedprice", "l_quantity"]),
    "describe": lambda s, d: P.describe(view(s, d, "orders"), ["o_totalprice", "o_orderstatus"]).select(
        "summary", F.round(F.col("o_totalprice").try_cast("double"), 4).alias("o_totalprice"), "o_orderstatus"),
    "group_sums": lambda s, d: P.group_sums(view(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], {
        "sum_qty": money_sum(F.col("l_quantity")), "sum_price": money_sum(F.col("l_extendedprice")),
        "sum_net": money_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4),
        "sum_tax": money_sum(F.col("l_extendedprice") * F.col("l_tax"), 4), "n": F.count("l_orderkey")}),
    "kpi_monthly": lambda s, d: rounded(P.monthly_kpi(view(s, d, "policies"), "start_date", "customer_id", "premium_amount"), 4, "avg_premium"),
    "tabulate": lambda s, d: P.tabulate(view(s, d, "policies"), ["product_code", "status"],
                                        {"n": F.count(F.lit(1)), "premium_sum": money_sum(F.col("premium_amount")),
                                         "premium_max": F.max("premium_amount")}),
    "tabulate_across": _tabulate_across,
    "report_group": _report,
    "distinct_rows": lambda s, d: view(s, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag").distinct(),
    "count_nonmissing": lambda s, d: _cust(s, d).groupBy("segment").agg(
        F.count("status").alias("n_status"), (F.count(F.lit(1)) - F.count("status")).alias("null_count")),
    "value_list": _value_list,
    "distribution": lambda s, d: P.distribution(view(s, d, "documents"), "lang"),
    "nodupkey": lambda s, d: O.nodupkey(_cust(s, d), ["customer_id"], ["load_seq"]),
    "first_last": lambda s, d: O.first_last(_cust(s, d), ["customer_id"], ["load_seq"]),
    "row_numbers": lambda s, d: O.row_numbers(view(s, d, "events"), ["event_type"], ["ts", "event_id"]),
    "sort_by": lambda s, d: O.sort_by(_cust(s, d), ["status", "customer_id", "load_seq"]),
    "top_k": lambda s, d: O.top_k(view(s, d, "orders"), "o_totalprice", 20, ["o_orderkey"]).select("o_orderkey", "o_totalprice"),
    "rank_inventory": lambda s, d: O.rank_inventory(view(s, d, "datasets_meta"), "row_count", ["dataset_name"]),
    "per_segment": lambda s, d: rounded(W.per_segment(_cust(s, d), "segment", {
        "n": F.count("income"), "mean_income": F.avg("income"), "max_risk": F.max("risk_score")}), 4, "mean_income"),
}


def _meds(v, extra=""):
    return f"""round(quantile_cont({v}, 0.5), 4) AS median, round(quantile_cont({v}, 0.25), 4) AS p25,
      round(quantile_cont({v}, 0.75), 4) AS p75"""


def _basic(v, full=False):
    more = f", CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(*) - count({v}) AS DOUBLE) AS nmiss" if full else ""
    return (f"CAST(count({v}) AS DOUBLE) AS n{more}, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, "
            f"CAST(min({v}) AS DOUBLE) AS min, CAST(max({v}) AS DOUBLE) AS max")


def _freq(source, cols, cross=False, where=""):
    k = ", ".join(cols)
    more = "" if not cross else f""",
      round(frequency * 100.0e0 / sum(frequency) OVER (PARTITION BY {cols[0]}), 6) AS row_percent,
      round(frequency * 100.0e0 / sum(frequency) OVER (PARTITION BY {cols[1]}), 6) AS col_percent"""
    return f"""SELECT {k}, frequency, round(frequency * 100.0e0 / sum(frequency) OVER (), 6) AS percent{more}
      FROM (SELECT {k}, count(*) AS frequency FROM {source} {where} GROUP BY {k})"""


ORACLE = {
    "describe": " UNION ALL ".join(
        f"SELECT '{n}' AS summary, round(CAST({f}(o_totalprice) AS DOUBLE), 4) AS o_totalprice, {g} AS o_orderstatus FROM orders"
        for n, f, g in (("count", "count", "CAST(count(o_orderstatus) AS VARCHAR)"), ("mean", "avg", "NULL"), ("stddev", "stddev_samp", "NULL"),
                        ("min", "min", "min(o_orderstatus)"), ("max", "max", "max(o_orderstatus)"))),
    "freq_oneway": with_views("customers_raw", _freq("customers_raw", ["status"])),
    "freq_oneway_no_missing": with_views("customers_raw", _freq("customers_raw", ["status"], where="WHERE status IS NOT NULL")),
    "freq_crosstab": with_views("customers_raw", _freq("customers_raw", ["segment", "status"], True)),
    "freq_cumulative": """SELECT l_partkey, frequency, round(frequency * 100.0e0 / sum(frequency) OVER (), 6) AS percent,
      CAST(sum(frequency) OVER w AS BIGINT) AS cum_frequency,
      round(sum(frequency) OVER w * 100.0e0 / sum(frequency) OVER (), 6) AS cum_percent
      FROM (SELECT l_partkey, count(*) AS frequency FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY l_partkey)""",
    "pct_of_total": _freq("events", ["user_id", "event_type"], True),
    "means": with_views("customers_raw", " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {_basic(v, True)} FROM customers_raw" for v in ("income", "risk_score"))),
    "means_class": with_views("customers_raw", " UNION ALL ".join(
        f"""SELECT CAST(3 - (grouping(segment) * 2 + grouping(status)) AS BIGINT) AS type, segment, status, '{v}' AS variable,
        {_basic(v)} FROM customers_raw GROUP BY CUBE (segment, status)""" for v in ("income", "risk_score"))),
    "means_class_nway": f"SELECT user_id, 'value' AS variable, {_basic('value')} FROM events GROUP BY user_id",
    "univariate": with_views("customers_raw", " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {_basic(v)}, {_meds(v)} FROM customers_raw" for v in ("income", "risk_score"))),
    "univariate_by": f"""SELECT l_suppkey, 'l_extendedprice' AS variable, {_basic('l_extendedprice')}, {_meds('l_extendedprice')}
      FROM lineitem GROUP BY l_suppkey""",
    "group_sums": f"""SELECT l_returnflag, l_linestatus, l_suppkey, {msum('l_quantity', 'sum_qty')},
      {msum('l_extendedprice', 'sum_price')}, {msum('(l_extendedprice * (1 - l_discount))', 'sum_net', 4)},
      {msum('(l_extendedprice * l_tax)', 'sum_tax', 4)}, count(l_orderkey) AS n FROM lineitem GROUP BY 1, 2, 3""",
    "kpi_monthly": with_views("policies", """SELECT year(start_date) AS yr, month(start_date) AS mo,
      count(DISTINCT customer_id) AS unique_customers, count(*) AS total_policies,
      CAST(sum(CAST(premium_amount AS DECIMAL(18,6))) AS DOUBLE) AS total_premium, round(avg(premium_amount), 4) AS avg_premium
      FROM policies GROUP BY 1, 2"""),
    "tabulate": with_views("policies", f"""SELECT product_code, status, count(*) AS n, {msum('premium_amount', 'premium_sum')},
      max(premium_amount) AS premium_max FROM policies GROUP BY 1, 2"""),
    "tabulate_across": with_views("policies", "SELECT product_code, " + ", ".join(
        f"nullif(count(*) FILTER (status = '{v}'), 0) AS \"{v}_n\", "
        + msum(f"(CASE WHEN status = '{v}' THEN premium_amount END)", f'"{v}_premium"') for v in "FOP")
        + " FROM policies GROUP BY 1"),
    "report_group": with_views("policies", """WITH kpi AS (SELECT year(start_date) AS yr, month(start_date) AS mo,
        count(DISTINCT customer_id) AS u, count(*) AS t, sum(CAST(premium_amount AS DECIMAL(18,6))) AS p,
        avg(premium_amount) AS a FROM policies GROUP BY 1, 2)
      SELECT yr, CAST(sum(u) AS DOUBLE) AS unique_customers, CAST(sum(t) AS DOUBLE) AS total_policies,
        CAST(sum(p) AS DOUBLE) AS total_premium, round(avg(a), 4) AS avg_premium,
        '$' || format('{:,.2f}', CAST(sum(p) AS DOUBLE)) AS total_shown FROM kpi GROUP BY yr"""),
    "distinct_rows": "SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem",
    "count_nonmissing": with_views("customers_raw", """SELECT segment, count(status) AS n_status,
      count(*) - count(status) AS null_count FROM customers_raw GROUP BY segment"""),
    "value_list": "SELECT row_number() OVER (ORDER BY event_type) AS place, event_type AS value FROM (SELECT DISTINCT event_type FROM events)",
    "distribution": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "nodupkey": with_views("customers_raw", """SELECT * FROM customers_raw
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY load_seq) = 1"""),
    "first_last": with_views("customers_raw", """SELECT *,
      CASE WHEN row_number() OVER (PARTITION BY customer_id ORDER BY load_seq) = 1 THEN 1 ELSE 0 END AS first_flag,
      CASE WHEN row_number() OVER (PARTITION BY customer_id ORDER BY load_seq DESC) = 1 THEN 1 ELSE 0 END AS last_flag
      FROM customers_raw"""),
    "row_numbers": "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_no FROM events",
    "sort_by": with_views("customers_raw", "SELECT * FROM customers_raw ORDER BY status NULLS FIRST, customer_id, load_seq"),
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "rank_inventory": with_views("datasets_meta", """SELECT *, row_number() OVER (ORDER BY row_count DESC, dataset_name) AS place
      FROM datasets_meta"""),
    "per_segment": with_views("customers_raw", """SELECT segment, count(income) AS n, round(avg(income), 4) AS mean_income,
      max(risk_score) AS max_risk FROM customers_raw GROUP BY segment"""),
}
