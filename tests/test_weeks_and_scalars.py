import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockweave.functions import scalars as sc
from stockweave.functions import weeks as wk


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first()["x"]


def test_week_label_matches_calendar_for_every_day(spark):
    start = dt.date(1994, 12, 20)
    days = [(start + dt.timedelta(days=i),) for i in range(0, 366 * 12)]
    df = spark.createDataFrame(days, "d date").select("d", wk.week_label("d").alias("w"))
    for r in df.collect():
        y, w, _ = r["d"].isocalendar()
        assert r["w"] == y * 100 + w


def test_monday_shift_and_differences(spark):
    weeks = [199852, 199853, 199901, 202052, 202053, 202101, 202501]
    df = spark.createDataFrame([(w,) for w in weeks], "year_week int").select(
        "year_week", wk.monday_of("year_week").alias("m"), wk.shift_week("year_week", 1).alias("n"),
        wk.weeks_ago("year_week", 52).alias("p"), wk.week_index("year_week", 199501).alias("i"),
        wk.iso_weeks_between("year_week", F.lit(202501)).alias("iso"),
        wk.flat52_weeks_between("year_week", F.lit(202501)).alias("flat"),
    )
    for r in df.collect():
        w = r["year_week"]
        assert r["m"] == wk.week_monday(w)
        assert r["n"] == wk.week_add(w, 1) and r["p"] == wk.week_add(w, -52)
        assert r["i"] == wk.week_span(199501, w) and r["iso"] == wk.week_span(w, 202501)
        assert r["flat"] == 2025 * 52 + 1 - (w // 100) * 52 - w % 100


def test_dec_30_belongs_to_next_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")
    assert df.select(wk.week_label("d")).first()[0] == 202501


@pytest.mark.parametrize("raw,want", [("202314.0", 202314), ("202314", 202314)])
def test_normalise_week(spark, raw, want):
    assert one(spark, wk.normalise_week("v"), v=raw) == want


def test_labels(spark):
    assert one(spark, wk.format_week("v"), v=202505) == "W05·2025"
    assert one(spark, wk.human("v"), v=12_345_678.0) == "12.3M"
    assert one(spark, wk.human("v"), v=45_400.0) == "45K"
    assert one(spark, wk.human("v"), v=-678.0) == "-678"


@pytest.mark.parametrize("raw,want", [("1,234", 1234.0), (" 25.0 ", 25.0), ("", 0.0), (None, 0.0), ("abc", 0.0)])
def test_number_text_permissive(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(sc.number_text("v", strict=False)).first()[0] == want


def test_number_text_strict_fails_on_junk(spark):
    df = spark.createDataFrame([("abc",)], "v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(sc.number_text("v")).collect()


@pytest.mark.parametrize(
    "desc,want",
    [
        ("MOBILE,SM-A057M,COLOMBIA,LIGHT BLUE,64GB", ("MOBILE", "SM-A057M", "LIGHT BLUE", "")),
        ("QLED TV,QN55Q60DAK,55,COLOMBIA,QWK30/Q55", ("QLED TV", "QN55Q60DAK", "", "")),
        ("MOBILE,SM-A057M/DS,BLACK,LTC", ("MOBILE", "SM-A057M/DS", "BLACK", "LTC")),
        ("A, B1 , light blue , red , R410A", ("A", "B1", "light blue", "R410A")),
        ("RED,BLUE", ("RED", "BLUE", "", "")),
        ("USA", ("USA", "", "", "USA")),
        ("X,Y,NAVY BLUE,co", ("X", "Y", "", "co")),
        ("  ", ("", "", "", "")),
        (None, ("", "", "", "")),
    ],
)
def test_material_parts(spark, desc, want):
    df = spark.createDataFrame([(desc,)], "d string")
    assert tuple(df.select(*sc.material_parts("d").values()).first()) == want


def test_level_order(spark):
    assert one(spark, sc.level_order("v", ["A", "B"]), v="B") == 1
    assert one(spark, sc.level_order("v", ["A", "B"]), v="Z") is None
