import datetime as dt

from pyspark.sql import functions as F

from ledgerlift.functions import informats as I
from ledgerlift.functions import scalars as S
from ledgerlift.functions.semantics import char_eq, clamp, ge, gt, is_blank, le, lt, money_sum
from ledgerlift.operators.steps import aging_bucket


def values(df):
    return [tuple(r) for r in df.collect()]


def test_missing_is_below_every_number(spark):
    df = spark.createDataFrame([(None, 1), (None, None), (1, None), (-5, 0), (2, 2)], "a int, b int")
    c = F.col
    got = values(df.select(lt(c("a"), c("b")), le(c("a"), c("b")), gt(c("a"), c("b")), ge(c("a"), c("b"))))
    assert got == [
        (True, True, False, False), (False, True, False, True), (False, False, True, True),
        (True, True, False, False), (False, True, False, True),
    ]


def test_blank_and_trailing_blanks(spark):
    df = spark.createDataFrame([("ab ", "ab"), (None, "  "), ("a", "b")], "a string, b string")
    assert values(df.select(char_eq(F.col("a"), F.col("b")), is_blank(F.col("a")))) == [
        (True, False), (True, True), (False, False)]


def test_clamp_puts_missing_at_the_floor(spark):
    df = spark.createDataFrame([(None,), (-3,), (4,), (99,)], "a int")
    assert [r[0] for r in df.select(clamp(F.col("a"), 0, 13)).collect()] == [0, 0, 4, 13]


def test_money_sum_is_exact_for_both_signs(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(-1234567890.37,), (None,)], "a double")
    assert df.agg(money_sum(F.col("a"))).first()[0] == -1234567889.37


def test_aging_limits(spark):
    days = [0, 30, 31, 60, 61, 120, 121, 180, 181, 365, 366, -1, -30, -31, -365, -366, None]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    got = [r[0] for r in df.select(aging_bucket(F.col("d"), F.lit(False))).collect()]
    assert got[0] == got[1] == "AV.000 a 030 dias"
    assert got[2] == got[3] == "av.031 a 060 dias"
    assert got[10] == "av.acima de 365 dias"
    assert got[11] == got[12] == "vc.001 a 030 dias venc"
    assert got[14] == "vc.181 a 365 dias venc" and got[15] == "vc.acima de 365 dias venc"
    assert got[16] == "Nenhuma das anteriores"


def test_informats(spark):
    df = spark.createDataFrame([("1.234,56", "31/12/2024"), ("(7,5)", "31/02/2024"), ("abc", ""), (" 8 ", "1/1/24x")], "n string, d string")
    got = values(df.select(I.informat_num(F.col("n"), "COMMAX13."), I.informat_date(F.col("d"), "DDMMYY10.")))
    assert got == [(1234.56, dt.date(2024, 12, 31)), (-7.5, None), (None, None), (8.0, None)]


def test_scalars(spark):
    df = spark.createDataFrame([(r"\\h\d\&m._01_Sales_Data_02.csv", 5, dt.date(2026, 12, 31))], "p string, n int, d date")
    row = df.select(
        S.path_stem(F.col("p")), S.put_z(F.col("n"), 4), S.put_z(-F.col("n"), 4), S.put_z(F.lit(12345), 4),
        S.next_period(F.col("d")), S.scan_word(F.lit("a  b c"), 2), S.scan_word(F.lit("a  b c"), -1), S.cats(F.lit(" x "), F.lit(None), F.col("n")),
        S.mdy(F.lit(2), F.lit(30), F.lit(2024)), S.format_bytes(F.lit(1280)),
    ).first()
    assert tuple(row) == ("01_sales_data", "0005", "-005", "12345", dt.date(2027, 1, 1), "b", "c", "x5", None, "1.2 KB")


def test_installment_window_keeps_fractions(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), dt.date(2026, 12, 31), 4, 2, 0), (dt.date(2026, 1, 1), dt.date(2026, 1, 20), 4, 2, 0)],
                               "s date, e date, n int, k int, x int")
    lo, hi = S.installment_window(F.col("s"), F.col("e"), F.col("n"), F.col("k"), F.lit(False))
    base = (dt.date(2026, 1, 1) - dt.date(1970, 1, 1)).days
    assert values(df.select(lo, hi)) == [(base + 91.0, base + 182.0), (base, base + 19.0)]
