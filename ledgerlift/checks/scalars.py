"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.functions import informats as I
from ledgerlift.functions import scalars as S
from ledgerlift.plans.views import view, with_views

c = F.col


def ref():
    return F.lit("1998-06-30").cast("date")


def _orders(s, d):
    return view(s, d, "orders").withColumn("day", c("o_orderdate").cast("date"))


def _inst(s, d):
    return view(s, d, "installments")


def _window(s, d):
    lo, hi = S.installment_window(c("dt_inicio"), c("dt_fim"), c("qtde_parcelas"), c("num_parcela"), F.lit(False))
    at = S.day_number(ref()).cast("double")
    return _inst(s, d).select("cod_apolice", "num_parcela", lo.alias("lo"), hi.alias("hi"), S.prorata_window(lo, hi, at).alias("fator"))


def _split(s, d):
    parts = S.weighted_split(c("l_extendedprice"), {"a": 0.41, "b": 0.51, "c": 0.08})
    return view(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in parts.items()])


def _sign(s, d):
    amount = F.when(c("c_custkey") % 11 == 0, None).otherwise(c("c_acctbal") - 5000)
    return view(s, d, "customer").select(
        "c_custkey", F.abs(amount).alias("montante"), S.entry_side(amount, c("c_mktsegment") == "BUILDING").alias("chave"))


# Text made from amounts and dates, with unreadable fields among them.
AMOUNT = ("CASE WHEN o_orderkey % 13 = 0 THEN 'x9' WHEN o_orderkey % 17 = 0 THEN '' ELSE "
          "concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR(20)), 3, '0'), ',', "
          "lpad(CAST(o_orderkey % 100 AS VARCHAR(20)), 2, '0')) END")
VALUE = "CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL ELSE CAST(concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '.', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')) AS DOUBLE) END"


def _informat_num(s, d):
    df = view(s, d, "orders").select("o_orderkey", "o_totalprice", F.expr(AMOUNT).alias("t"))
    comma = F.translate("t", ".,", ",.")
    return df.select(
        "o_orderkey", I.informat_num(c("t"), "COMMAX13.").alias("commax"), I.informat_num(comma, "COMMA13.").alias("comma"),
        I.informat_num(F.concat(F.lit("$"), comma), "DOLLAR14.").alias("dollar"),
        I.informat_num(c("o_orderkey").cast("string"), "BEST12.").alias("best"),
        I.informat_num(c("o_orderkey").cast("string"), "COMMAX13.2").alias("implied"))


def _informat_date(s, d):
    day = c("day")
    broken = F.when(c("o_orderkey") % 13 == 0, F.lit("31/02/1999"))
    return _orders(s, d).select(
        "o_orderkey",
        I.informat_date(F.coalesce(broken, F.date_format(day, "dd/MM/yyyy")), "DDMMYY10.").alias("dmy"),
        I.informat_date(F.date_format(day, "ddMMyyyy"), "DDMMYY8.").alias("dmy_plain"),
        I.informat_date(F.date_format(day, "MM-dd-yyyy"), "MMDDYY10.").alias("mdy"),
        I.informat_date(F.date_format(day, "yyyy.MM.dd"), "YYMMDD10.").alias("ymd"),
        I.informat_date(F.upper(F.date_format(day, "ddMMMyyyy")), "DATE9.").alias("date9"),
        I.informat_date(F.concat(F.upper(F.date_format(day, "ddMMMyyyy")), F.lit(":10:20:30")), "DATETIME20.").cast("timestamp_ntz").alias("stamp"))


def _paths(s, d):
    path = F.concat(F.lit(r"\\host\dir\&anomes._"), "p_size", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
                    "p_partkey", F.lit(".v1.csv"))
    return view(s, d, "part").select("p_partkey", S.path_stem(path).alias("stem"))


QUERIES = {
    "fn_ifn_ifc": lambda s, d: _inst(s, d).select(
        "cod_apolice", "num_parcela", S.ifn(c("dt_vencimento") < ref(), 1, 0).alias("n"), S.ifc(c("dt_vencimento") < ref(), "late", "open").alias("t")),
    "fn_mdy": lambda s, d: view(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.mdy(
        F.lit(2), (c("l_orderkey") % 31 + 1).cast("int"), (F.lit(1990) + c("l_linenumber")).cast("int")).alias("day")),
    "fn_year_month": lambda s, d: _orders(s, d).select("o_orderkey", F.year("day").alias("y"), F.month("day").alias("m"), S.period(c("day")).alias("ym")),
    "fn_next_period": lambda s, d: _orders(s, d).select("o_orderkey", S.next_period(c("day")).alias("next")),
    "fn_date_diff": lambda s, d: _orders(s, d).select("o_orderkey", S.days_between(c("day"), ref()).alias("d"), S.days_between(c("day"), ref(), True).alias("d1")),
    "fn_months_late": lambda s, d: _inst(s, d).select("cod_apolice", "num_parcela", S.months_late(c("dt_vencimento"), ref()).alias("late")),
    "fn_prorata_factor": lambda s, d: _inst(s, d).select("cod_apolice", "num_parcela", S.prorata_days(
        F.date_diff("dt_fim", ref()), F.date_diff("dt_fim", "dt_inicio"), c("cpf_cnpj").isNull()).alias("fator")),
    "fn_installment_period": _window,
    "fn_put_z": lambda s, d: view(s, d, "part").select("p_partkey", S.put_z(c("p_partkey"), 3).alias("z3"),
                                                       S.put_z(c("p_size") - 25, 4).alias("z4"), S.put_z(F.nullif("p_size", F.lit(7)), 2).alias("z2")),
    "fn_cats": lambda s, d: view(s, d, "part").select("p_partkey", S.cats(F.concat(F.lit("  "), "p_name", F.lit(" ")), c("p_size"), F.nullif("p_type", F.lit("PROMO"))).alias("t")),
    "fn_substr": lambda s, d: view(s, d, "part").select("p_partkey", S.substr(c("p_name"), 2, 4).alias("t")),
    "fn_sign_split": _sign,
    "fn_weighted_split": _split,
    "fn_informat_num": _informat_num,
    "fn_informat_date": _informat_date,
    "fn_format_out": lambda s, d: _orders(s, d).select(
        "o_orderkey", I.put_commax(c("o_totalprice").cast("decimal(18,2)")).alias("commax"), I.put_comma(c("o_totalprice").cast("decimal(18,2)")).alias("comma"),
        I.put_dollar((c("o_totalprice") - 200000).cast("decimal(18,2)")).alias("dollar"), I.put_ddmmyy(c("day")).alias("dmy")),
    "fn_scan_word": lambda s, d: view(s, d, "documents").select(
        "doc_id", S.scan_word(c("text"), 1).alias("first"), S.scan_word(c("text"), 2).alias("second"), S.scan_word(c("text"), -1).alias("last"),
        S.scan_word(c("text"), 100000).alias("beyond")),
    "fn_path_stem": _paths,
    "fn_format_bytes": lambda s, d: view(s, d, "orders").select("o_orderkey", S.format_bytes(
        (c("o_totalprice") * F.pow(F.lit(10.0), c("o_orderkey") % 9)).cast("bigint")).alias("size"), S.format_bytes(c("o_orderkey") * 128).alias("size2")),
    "fn_safe_filename": lambda s, d: view(s, d, "pages").select("page_id", S.safe_filename(c("url")).alias("name")),
    "fn_hash16": lambda s, d: view(s, d, "documents").select("doc_id", S.hash16(c("text")).alias("h")),
    "fn_normalize_name": lambda s, d: view(s, d, "part").select("p_partkey", S.normalize_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("t")),
}


def i(sql):
    return with_views("installments", sql)


def z(e, w):
    return (f"CASE WHEN {e} IS NULL THEN '.' WHEN {e} < 0 THEN '-' || CASE WHEN length(CAST(-({e}) AS VARCHAR)) < {w} - 1 THEN lpad(CAST(-({e}) AS VARCHAR), {w} - 1, '0') "
            f"ELSE CAST(-({e}) AS VARCHAR) END WHEN length(CAST({e} AS VARCHAR)) < {w} THEN lpad(CAST({e} AS VARCHAR), {w}, '0') ELSE CAST({e} AS VARCHAR) END")


def size(e):
    arms = " ".join(f"WHEN abs({e}) < {1024 ** (k + 1)} THEN printf('%.1f {u}', {e} / {float(1024 ** k)}e0)" for k, u in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")))
    return f"CASE WHEN abs({e}) < 1024 THEN CAST({e} AS VARCHAR) || ' B' {arms} ELSE printf('%.1f PB', {e} / {float(1024 ** 5)}e0) END"


LO = "CASE WHEN qtde_parcelas = 0 OR f - a < 31 THEN a ELSE a + (f - a) / CAST(qtde_parcelas AS DOUBLE) * (num_parcela - 1) END"
HI = "CASE WHEN qtde_parcelas = 0 OR f - a < 31 THEN f ELSE a + (f - a) / CAST(qtde_parcelas AS DOUBLE) * num_parcela END"
WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"

ORACLE = {
    "fn_ifn_ifc": i("""SELECT cod_apolice, num_parcela, CASE WHEN dt_vencimento < DATE '1998-06-30' THEN 1 ELSE 0 END AS n,
      CASE WHEN dt_vencimento < DATE '1998-06-30' THEN 'late' ELSE 'open' END AS t FROM installments"""),
    "fn_mdy": """SELECT l_orderkey, l_linenumber, TRY_CAST(concat(1990 + l_linenumber, '-02-', l_orderkey % 31 + 1) AS DATE) AS day FROM lineitem""",
    "fn_year_month": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, year(o_orderdate) * 100 + month(o_orderdate) AS ym FROM orders",
    "fn_next_period": "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next FROM orders",
    "fn_date_diff": "SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1998-06-30' AS d, CAST(o_orderdate AS DATE) - DATE '1998-06-30' + 1 AS d1 FROM orders",
    "fn_months_late": i("""SELECT cod_apolice, num_parcela, CASE WHEN dt_vencimento >= DATE '1998-08-01' THEN -2
      ELSE date_diff('month', date_trunc('month', dt_vencimento), DATE '1998-06-01') END AS late FROM installments"""),
    "fn_prorata_factor": i("""SELECT cod_apolice, num_parcela, CASE WHEN dt_fim <= DATE '1998-06-30' OR dt_fim <= dt_inicio OR cpf_cnpj IS NULL THEN 0.0
      WHEN dt_inicio < DATE '1998-06-30' THEN CAST(dt_fim - DATE '1998-06-30' AS DOUBLE) / CAST(dt_fim - dt_inicio AS DOUBLE)
      WHEN dt_inicio = DATE '1998-06-30' THEN 1.0 ELSE 1.0 END AS fator FROM installments"""),
    "fn_installment_period": i(f"""WITH x AS (SELECT *, CAST(dt_inicio - DATE '1970-01-01' AS DOUBLE) AS a, CAST(dt_fim - DATE '1970-01-01' AS DOUBLE) AS f,
        CAST(DATE '1998-06-30' - DATE '1970-01-01' AS DOUBLE) AS r FROM installments),
      y AS (SELECT cod_apolice, num_parcela, {LO} AS lo, {HI} AS hi, r FROM x)
      SELECT cod_apolice, num_parcela, lo, hi, CASE WHEN hi - lo <= 0 OR hi <= r THEN 0.0 WHEN lo >= r THEN 1.0 ELSE (hi - r) / (hi - lo) END AS fator FROM y"""),
    "fn_put_z": f"SELECT p_partkey, {z('p_partkey', 3)} AS z3, {z('(p_size - 25)', 4)} AS z4, {z('nullif(p_size, 7)', 2)} AS z2 FROM part",
    "fn_cats": "SELECT p_partkey, concat(p_name, p_size, CASE WHEN p_type <> 'PROMO' THEN p_type END) AS t FROM part",
    "fn_substr": "SELECT p_partkey, substr(p_name, 2, 4) AS t FROM part",
    "fn_sign_split": """WITH x AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal - 5000 END AS a FROM customer)
      SELECT c_custkey, abs(a) AS montante, CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN a > 0 THEN 'C' ELSE 'D' END
        ELSE CASE WHEN a IS NULL OR a < 0 THEN 'C' ELSE 'D' END END AS chave FROM x""",
    "fn_weighted_split": """SELECT l_orderkey, l_linenumber, l_extendedprice * CAST(0.41 AS DOUBLE) AS a, l_extendedprice * CAST(0.51 AS DOUBLE) AS b,
      l_extendedprice * CAST(0.08 AS DOUBLE) AS c FROM lineitem""",
    "fn_informat_num": f"""SELECT o_orderkey, {VALUE} AS commax, {VALUE} AS comma, {VALUE} AS dollar, CAST(o_orderkey AS DOUBLE) AS best,
      CAST(o_orderkey AS DOUBLE) / 100 AS implied FROM orders""",
    "fn_informat_date": """SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS dmy, CAST(o_orderdate AS DATE) AS dmy_plain,
      CAST(o_orderdate AS DATE) AS mdy, CAST(o_orderdate AS DATE) AS ymd, CAST(o_orderdate AS DATE) AS date9,
      date_trunc('day', o_orderdate) + INTERVAL '10:20:30' HOUR TO SECOND AS stamp FROM orders""".replace("INTERVAL '10:20:30' HOUR TO SECOND", "INTERVAL 37230 SECOND"),
    "fn_format_out": """SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS commax, format('{:,.2f}', o_totalprice) AS comma,
      CASE WHEN o_totalprice < 200000 THEN '-$' ELSE '$' END || format('{:,.2f}', CAST(abs(CAST(o_totalprice AS DECIMAL(18,2)) - 200000) AS DOUBLE)) AS dollar,
      strftime(o_orderdate, '%d/%m/%Y') AS dmy FROM orders""",
    "fn_scan_word": f"""SELECT doc_id, {WORDS}[1] AS first, {WORDS}[2] AS second, {WORDS}[-1] AS last, {WORDS}[100000] AS beyond FROM documents""",
    "fn_path_stem": "SELECT p_partkey, lower(concat(p_size, '_', replace(p_name, ' ', '_'), '_', p_partkey, '.v1')) AS stem FROM part",
    "fn_format_bytes": f"""SELECT o_orderkey, {size('CAST(trunc(o_totalprice * pow(10.0e0, o_orderkey % 9)) AS BIGINT)')} AS size, {size('(o_orderkey * 128)')} AS size2 FROM orders""",
    "fn_safe_filename": "SELECT page_id, trim(regexp_replace(url, '[^\\p{L}\\p{N}_\\-.]', '_', 'g'), '_') AS name FROM pages",
    "fn_hash16": "SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents",
    "fn_normalize_name": "SELECT p_partkey, lower(p_name) AS t FROM part",
}
