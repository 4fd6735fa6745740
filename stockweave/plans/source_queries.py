"""Sources, sinks, reshaping, scalar functions."""

from pyspark.sql import functions as F

from stockweave.functions import scalars as sc
from stockweave.functions import weeks as wk
from stockweave.operators import reshape as rs
from stockweave.plans.registry import KEY2, KEY3, define, query
from stockweave.schema import CATEGORY, CHANNEL, MATERIAL, QTY, RISK_LEVELS, SELL_IN, SERIES, SKU, WEEK
from stockweave.session import scratch_path
from stockweave.sources import tables as tb
from stockweave.sources import versions as vs
from stockweave.sources import wide_csv as wc


YEARS = range(tb.FIRST_WEEK // 100, tb.LAST_WEEK // 100 + 1)


def _grouped_text(c):
    """Hundredfold quantity with comma groups and a trailing blank."""
    return F.concat(F.format_number(c * 100, 1), F.lit(" "))


def _write_wide(spark, d):
    df = tb.long_table(spark, d, "coarse")
    text = {YEARS[-1]: _grouped_text}
    return {y: wc.write_wide(wc.to_wide(df, y, text.get(y)), scratch_path(spark, f"wide{y}")) for y in YEARS}


def wide_frames(spark, d):
    return wc.read_years(spark, _write_wide(spark, d))


define(
    "wide_long",
    """SELECT k.ch, k.mat, k.cat, w.yw, coalesce(l.q, 0.0) * CASE WHEN w.yw > 200100 THEN 100 ELSE 1 END AS q
       FROM (SELECT DISTINCT ch, mat, cat, yw // 100 AS y FROM long_coarse) k
       JOIN weeks w ON w.yw // 100 = k.y
       LEFT JOIN long_coarse l ON l.ch = k.ch AND l.mat = k.mat AND l.cat = k.cat AND l.yw = w.yw""",
)


@query(
    "S1_read_wide_csv",
    f"""SELECT {KEY3}, CAST(yw AS VARCHAR) AS week_column,
          CASE WHEN yw > 200100 THEN trim(format('{{:,.1f}}', q * 100)) ELSE CAST(q AS VARCHAR) END AS text FROM long_coarse""",
)
def s1(spark, d):
    paths = _write_wide(spark, d)
    frames = wc.read_years(spark, {1994: paths[2000] + "-absent", **paths})
    df = rs.union_years([f.unpivot(SERIES, rs.week_columns(f), "week_column", "text") for f in frames.values()])
    return df.filter(F.col("text").isNotNull()).select(*SERIES, "week_column", F.trim("text").alias("text"))


@query(
    "S2_write_bronze",
    """SELECT CAST(y AS INTEGER) AS source_year, count(*) AS n_rows
       FROM (SELECT DISTINCT ch, mat, cat, yw // 100 AS y FROM long_coarse) GROUP BY y""",
)
def s2(spark, d):
    path = wc.write_bronze(wide_frames(spark, d), scratch_path(spark, "bronze"))
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.groupBy("source_year").agg(F.count("*").alias("n_rows"))


@query(
    "S3_read_columns",
    "SELECT l_returnflag, count(*) AS n_rows, sum(l_quantity) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-03' GROUP BY 1",
)
def s3(spark, d):
    df = tb.table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_shipdate")
    df = df.filter(F.col("l_shipdate") >= F.lit("2000-01-03").cast("timestamp_ntz"))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias(QTY))


@query(
    "S4_write_silver",
    "SELECT CAST(yw // 100 AS INTEGER) AS year, count(*) AS n_rows, sum(q) AS quantity FROM long_fine GROUP BY 1",
)
def s4(spark, d):
    path = wc.write_table(rs.silver(tb.observations(spark, d)), scratch_path(spark, "silver"))
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n_rows"), F.sum(QTY).alias(QTY))


@query(
    "S4_replace_table",
    "SELECT CAST(yw // 100 AS INTEGER) AS year, count(*) AS n_rows, sum(q) * 2 AS quantity FROM long_coarse GROUP BY 1",
)
def s4_replace(spark, d):
    path = scratch_path(spark, "silver")
    vs.replace(spark, rs.with_calendar(tb.long_table(spark, d, "coarse")), path)
    vs.replace(spark, vs.read(spark, path).withColumn(QTY, F.col(QTY) * 2), path)
    return vs.read(spark, path).groupBy("year").agg(F.count("*").alias("n_rows"), F.sum(QTY).alias(QTY))


@query("S5_normalise_week", "SELECT yw AS year_week, count(*) AS n_rows FROM obs_fine GROUP BY yw")
def s5(spark, d):
    week = F.col(WEEK)
    text = F.when(F.col("l_linenumber") % 2 == 0, week.cast("double").cast("string")).otherwise(week.cast("string"))
    text = F.when(F.col("l_linenumber") == 3, F.format_string("%d.0", week)).otherwise(text)
    df = tb.observations(spark, d).withColumn("raw", text)
    return df.groupBy(wk.normalise_week("raw").alias(WEEK)).agg(F.count("*").alias("n_rows"))


@query("S6_sell_in_extract", f"SELECT {KEY2}, yw AS year_week, CAST(q AS FLOAT) AS quantity FROM long_fine WHERE cat = 'Sell-in'")
def s6(spark, d):
    source = wc.write_table(tb.long_table(spark, d), scratch_path(spark, "weekly"), None)
    target = scratch_path(spark, "sell-in")
    for _ in range(2):  # the second call finds the extract up to date
        wc.refresh_extract(spark, source, target, lambda df: rs.sell_in_extract(df, SELL_IN))
    return spark.read.parquet(target)


@query("S7_file_hash")
def s7(spark, d):
    return wc.file_hashes(spark, f"{d}/lineitem.parquet").select("length", "sha256")


@query(
    "S7_shape_hash",
    """SELECT 5 AS n_columns, count(*) AS n_rows,
       sha256('[''Channel'', ''Material Description'', ''Category'', ''year_week'', ''quantity'']' || CAST(count(*) AS VARCHAR)) AS sha256
       FROM long_fine""",
)
def s7_shape(spark, d):
    return wc.shape_hash(tb.long_table(spark, d))


@query(
    "S8_lineage",
    """SELECT 'raw_to_bronze' AS event, CAST(yw // 100 AS INTEGER) AS year, 'raw' AS source, 'bronze' AS destination,
       count(DISTINCT (ch, mat, cat)) AS rows_written FROM long_coarse GROUP BY yw // 100""",
)
def s8(spark, d):
    return wc.lineage(wide_frames(spark, d), "raw_to_bronze", "raw", "bronze")


@query("S9_json_report", "SELECT CAST(yw // 100 AS BIGINT) AS year, count(*) AS n_rows FROM long_fine GROUP BY 1")
def s9(spark, d):
    df = rs.with_calendar(tb.long_table(spark, d)).groupBy("year").agg(F.count("*").alias("n_rows"))
    return spark.read.schema("year bigint, n_rows bigint").json(wc.write_report(df, scratch_path(spark, "report")))


@query("P1_melt", f"SELECT {KEY3}, yw AS year_week, q AS quantity FROM wide_long")
def p1(spark, d):
    return wc.melt_years(wide_frames(spark, d)).select(*SERIES, WEEK, QTY)


@query(
    "P2_number_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber IN (5, 6, 7) THEN 0.0::DOUBLE ELSE l_extendedprice END AS number
       FROM lineitem""",
)
def p2(spark, d):
    line = F.col("l_linenumber")
    text = (
        F.when(line == 7, "").when(line == 5, "abc").when(line != 6, F.concat(F.lit(" "), F.format_number("l_extendedprice", 2)))
    )
    df = tb.table(spark, d, "lineitem").withColumn("t", text)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", sc.number_text("t", strict=False).alias("number"))


@query(
    "P3_split_week",
    f"SELECT DISTINCT CAST(yw AS VARCHAR) AS label, CAST(yw // 100 AS INTEGER) AS year, CAST(yw % 100 AS INTEGER) AS week_num FROM long_fine",
)
def p3(spark, d):
    label = F.col(WEEK).cast("string")
    df = tb.long_table(spark, d).select(label.alias("label")).distinct()
    return df.select(
        "label", F.substring("label", 1, 4).cast("int").alias("year"), F.substring("label", 5, 2).cast("int").alias("week_num")
    )


@query(
    "P4_clip_then_sum",
    f"SELECT {KEY3}, yw AS year_week, sum(greatest(coalesce(q, 0.0), 0.0)) AS quantity FROM signed_fine GROUP BY ch, mat, cat, yw",
)
def p4(spark, d):
    return rs.sum_duplicates(rs.clip_negative(tb.signed_observations(spark, d).drop("l_linenumber")))


@query("P5_union_years", "SELECT CAST(yw // 100 AS INTEGER) AS year, count(*) AS n_rows, sum(q) AS quantity FROM wide_long GROUP BY 1")
def p5(spark, d):
    df = wc.melt_years(wide_frames(spark, d))
    return df.groupBy("year").agg(F.count("*").alias("n_rows"), F.sum(QTY).alias(QTY))


@query(
    "P6_category_filter",
    "SELECT cat AS \"Category\", count(*) AS n_rows FROM long_fine WHERE cat IN ('Sell-in', 'Channel Inv.') GROUP BY cat",
)
def p6(spark, d):
    df = rs.valid_categories(tb.long_table(spark, d), ["Sell-in", "Channel Inv."])
    return df.groupBy(CATEGORY).agg(F.count("*").alias("n_rows"))


_COLORS = ", ".join(f"'{c}'" for c in sc.COLORS)
_CODES = ", ".join(f"'{c}'" for c in sc.COUNTRY_CODES)


@query(
    "P7_material_parts",
    f"""SELECT p_partkey, material AS "Material Description", t[1] AS product_category, t[2] AS product_model,
          coalesce(CASE WHEN upper(t[3]) IN ({_COLORS}) THEN t[3] END, CASE WHEN upper(t[4]) IN ({_COLORS}) THEN t[4] END, '') AS product_color,
          CASE WHEN upper(t[4]) IN ({_CODES}) OR regexp_matches(t[4], '^\\p{{L}}{{2,3}}$') THEN t[4] ELSE '' END AS product_country
        FROM (SELECT *, string_split(material, ',') AS t FROM (
          SELECT p_partkey, p_type || ',' || p_brand || ',' || upper(string_split(p_name, ' ')[1]) || ',' ||
            ['CO', 'LTC', 'USA', 'XYZW'][p_size % 4 + 1] AS material FROM part))""",
)
def p7(spark, d):
    return rs.with_material_parts(tb.materials(spark, d))


@query("P8_sorted_rows", f"SELECT {KEY3}, yw AS year_week, q AS quantity FROM long_coarse ORDER BY ch, mat, cat, yw")
def p8(spark, d):
    return rs.sorted_rows(tb.long_table(spark, d, "coarse"))


@query(
    "P9_year_and_week",
    f"SELECT {KEY3}, yw AS year_week, q AS quantity, CAST(yw // 100 AS INTEGER) AS year, CAST(yw % 100 AS INTEGER) AS week_num FROM long_coarse",
)
def p9(spark, d):
    return rs.with_calendar(tb.long_table(spark, d, "coarse"))


define("used_weeks", "SELECT w.* FROM weeks w WHERE yw IN (SELECT yw FROM long_fine)")


@query(
    "P10_week_dates",
    """SELECT u.yw AS year_week, CAST(u.d AS DATE) AS monday, CAST(s.i AS INTEGER) AS step,
         CAST(isoyear(CAST(u.d AS DATE) + CAST(s.i * 7 AS INTEGER)) * 100 + weekofyear(CAST(u.d AS DATE) + CAST(s.i * 7 AS INTEGER)) AS INTEGER) AS future_week
       FROM used_weeks u CROSS JOIN range(1, 5) s(i)""",
)
def p10(spark, d):
    df = tb.long_table(spark, d).select(WEEK).distinct()
    return df.select(WEEK, wk.monday_of(WEEK).alias("monday"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step")).select(
        "*", wk.shift_week(WEEK, F.col("step")).alias("future_week")
    )


def _ago(n):
    day = f"CAST(u.d AS DATE) - CAST({n} * 7 AS INTEGER)"
    return f"CAST(isoyear({day}) * 100 + weekofyear({day}) AS INTEGER)"


@query("P11_weeks_ago", f"SELECT u.yw AS year_week, {_ago(3)} AS ago_3, {_ago(52)} AS ago_52, {_ago(55)} AS ago_55 FROM used_weeks u")
def p11(spark, d):
    df = tb.long_table(spark, d).select(WEEK).distinct()
    return df.select(WEEK, *[wk.weeks_ago(WEEK, n).alias(f"ago_{n}") for n in (3, 52, 55)])


@query(
    "P12_week_differences",
    """SELECT yw AS year_week, CAST((2001 * 52 + 33) - (yw // 100 * 52 + yw % 100) AS INTEGER) AS flat52,
         CAST((DATE '2001-08-13' - CAST(d AS DATE)) // 7 AS INTEGER) AS iso FROM used_weeks""",
)
def p12(spark, d):
    df = tb.long_table(spark, d).select(WEEK).distinct()
    ref = F.lit(tb.REFERENCE_WEEK)
    return df.select(
        WEEK, wk.flat52_weeks_between(WEEK, ref).alias("flat52"), wk.iso_weeks_between(WEEK, ref).alias("iso")
    )


@query(
    "P13_labels",
    """SELECT yw AS year_week, 'W' || lpad(CAST(yw % 100 AS VARCHAR), 2, '0') || '·' || CAST(yw // 100 AS VARCHAR) AS label,
         CASE WHEN s >= 1e6 THEN printf('%.1fM', s / 1e6) WHEN s >= 1e3 THEN printf('%.0fK', s / 1e3) ELSE printf('%.0f', s) END AS human
       FROM (SELECT yw, sum(q) AS s FROM long_fine GROUP BY yw)""",
)
def p13(spark, d):
    df = tb.long_table(spark, d).groupBy(WEEK).agg(F.sum(QTY).alias("s"))
    return df.select(WEEK, wk.format_week(WEEK).alias("label"), wk.human("s").alias("human"))


@query(
    "P14_level_order",
    """SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS position,
       count(*) AS n_rows FROM orders GROUP BY ALL""",
)
def p14(spark, d):
    pos = sc.level_order("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    df = tb.table(spark, d, "orders").select("o_orderpriority", pos.alias("position"))
    return df.groupBy("o_orderpriority", "position").agg(F.count("*").alias("n_rows"))


@query(
    "P15_clip_text",
    """SELECT p_partkey, substring(p_type || ',' || p_brand || ',' || p_name, 1, 12) AS short FROM part""",
)
def p15(spark, d):
    text = F.concat_ws(",", "p_type", "p_brand", "p_name")
    return tb.table(spark, d, "part").select("p_partkey", sc.clip_text(text, 12).alias("short"))


@query("A1_sum_duplicates", f"SELECT {KEY3}, yw AS year_week, q AS quantity FROM long_fine")
def a1(spark, d):
    return tb.long_table(spark, d)


@query(
    "A1_duplicate_report",
    """SELECT count(*) AS rows_before, count(DISTINCT (ch, mat, cat, yw)) AS rows_after, CAST(0 AS BIGINT) AS null_key_rows,
       count(*) - count(DISTINCT (ch, mat, cat, yw)) AS duplicates_removed FROM obs_fine""",
)
def a1_report(spark, d):
    return rs.duplicate_report(tb.observations(spark, d))


@query(
    "J6_densify",
    f"SELECT {KEY3}, yw AS year_week, q AS quantity FROM dense_coarse",
)
def j6(spark, d):
    return tb.dense_table(spark, d, "coarse")


@query(
    "P7_silver_table",
    f"""SELECT {KEY3}, yw AS year_week, q AS quantity, CAST(yw // 100 AS INTEGER) AS year, CAST(yw % 100 AS INTEGER) AS week_num,
        split_part(mat, ',', 1) AS product_category, split_part(mat, ',', 2) AS product_model, '' AS product_color, '' AS product_country
        FROM (SELECT ch, mat, cat, yw, sum(greatest(q, 0.0)) AS q FROM signed_fine GROUP BY ALL)""",
)
def silver(spark, d):
    return rs.silver(tb.signed_observations(spark, d).drop("l_linenumber"))
