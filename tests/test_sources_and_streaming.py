import json

import pytest
from pyspark.sql import functions as F

from stockweave.operators.reshape import melt_weeks
from stockweave.session import cut_lineage, scratch_path, shared_dir
from stockweave.sources import tables as tb
from stockweave.sources import versions as vs
from stockweave.sources import wide_csv as wc
from stockweave.streaming import arrivals


def write(path, text):
    path.write_text(text)
    return str(path)


HEAD = "Channel,Material Description,Category,202401,202402\n"


def test_csv_nulls_commas_and_duplicates(spark, tmp_path):
    p = write(tmp_path / "2024.csv", HEAD + 'a,"X,Y",Sell-in,"1,234 ",NULL\nNA,"X,Y",Sell-in,5.0,\na,"X,Y",Channel Inv.,-3,n/a\n')
    frames = wc.read_years(spark, {2023: str(tmp_path / "none.csv"), 2024: p})
    assert list(frames) == [2024]
    rows = sorted((r["Channel"] or "", r["year_week"], r["quantity"]) for r in wc.melt_years(frames).collect())
    assert rows == [("", 202401, 5.0), ("", 202402, 0.0), ("a", 202401, 0.0), ("a", 202401, 1234.0), ("a", 202402, 0.0), ("a", 202402, 0.0)]


def test_junk_number_fails_strictly_and_is_zero_otherwise(spark, tmp_path):
    p = write(tmp_path / "f.csv", HEAD + "a,X,Sell-in,oops,2\n")
    df = wc.read_wide(spark, p)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        melt_weeks(df).collect()
    assert sorted(r["quantity"] for r in melt_weeks(df, strict=False).collect()) == [0.0, 2.0]


def test_schema_report_names_what_is_missing(spark, tmp_path):
    from stockweave.operators import quality as ql

    p = write(tmp_path / "f.csv", "Channel,Category,202401\na,Sell-in,1\nb,Other,2\n")
    df = wc.read_wide(spark, p)
    r = ql.source_schema(df, 2024).first()
    assert (r["missing_columns"], r["unknown_category_rows"], r["is_valid"]) == ("Material Description", 1, 0)
    assert [x["Category"] for x in ql.unknown_categories(df).collect()] == ["Other"]
    drift = {x["check_name"]: x["drift"] for x in ql.schema_drift(df, 2024).collect()}
    assert drift == {"MISSING_COLUMNS": 1, "WRONG_WEEK_COUNT": 1, "CATEGORY_DRIFT": 1}


def test_wide_round_trip(spark, sf):
    long = tb.long_table(spark, sf, "coarse")
    path = wc.write_wide(wc.to_wide(long, 2000), scratch_path(spark, "rt"))
    back = wc.melt_years(wc.read_years(spark, {2000: path})).filter("quantity > 0")
    want = long.filter("year_week between 200001 and 200052")
    assert back.agg(F.count("*"), F.sum("quantity")).first() == want.agg(F.count("*"), F.sum("quantity")).first()


def test_replace_a_table_that_is_being_read(spark):
    path = scratch_path(spark, "t")
    vs.replace(spark, spark.range(10).withColumn("year", F.lit(2000)), path)
    for n in (8, 6, 4):
        vs.replace(spark, vs.read(spark, path).filter(f"id < {n}"), path)
        assert vs.read(spark, path).count() == n
    assert [n for n, _ in vs.manifests(spark, path)] == [3, 4]


def test_a_stop_before_the_switch_leaves_the_table(spark, monkeypatch):
    path = scratch_path(spark, "t")
    with pytest.raises(FileNotFoundError):
        vs.read(spark, path)
    vs.replace(spark, spark.range(10), path, None)
    with monkeypatch.context() as m:
        m.setattr(vs, "_switch", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            vs.replace(spark, vs.read(spark, path).filter("id < 4"), path, None)
    assert vs.read(spark, path).count() == 10
    vs.replace(spark, vs.read(spark, path).filter("id < 3"), path, None)
    assert vs.read(spark, path).count() == 3


def test_file_hashes_read_in_chunks(spark, tmp_path):
    import hashlib
    import os

    data = {f"f{i} ä.bin": os.urandom(n) for i, n in enumerate((1, 999, 1000, 1001, 50_000))}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {os.path.basename(r["path"]): (r["length"], r["sha256"]) for r in wc.file_hashes(spark, str(tmp_path), chunk=1000).collect()}
    assert got == {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in data.items()}
    plan = wc.file_hashes(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Union")[1].split("Filter NOT")[0].split("MapInPandas")[0]


def test_file_hashes_of_files_larger_than_a_record_in_any_store(spark, tmp_path):
    import hashlib
    import os

    data = {f"f{i} ä%20#.bin": os.urandom(n) for i, n in enumerate((1, 1000, 1001, 50_000))}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    settings = {"spark.sql.sources.binaryFile.maxLength": "1000", "fs.viewfs.mounttable.hashes.link./in": f"file://{tmp_path}"}
    want = sorted((name, len(c), hashlib.sha256(c).hexdigest()) for name, c in data.items())
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for path in (str(tmp_path), "viewfs://hashes/in", [str(tmp_path), "viewfs://hashes/in"]):
            rows = wc.file_hashes(spark, path).collect()
            got = [(os.path.basename(r["path"]), r["length"], r["sha256"]) for r in rows]
            assert sorted(got) == sorted(want * (2 if isinstance(path, list) else 1))
    finally:
        for k in settings:
            spark.conf.unset(k)


class FakeSession:
    """Just the settings that choose the shared folder."""

    def __init__(self, setting, master):
        self.sparkContext, self.master, self.made = self, master, None
        self.conf = {} if setting is None else {"spark.checkpoint.dir": setting}

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path


def test_shared_folder_comes_from_the_session():
    set_by_cluster = FakeSession("hdfs://shared/here", "yarn")
    assert shared_dir(set_by_cluster) == "hdfs://shared/here"
    assert scratch_path(set_by_cluster, "x").startswith("hdfs://shared/here/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(None, "yarn"))
    local = FakeSession(None, "local[2]")
    assert shared_dir(local) == shared_dir(local) == local.made


def test_lineage_is_cut_by_checkpoint(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and "RDD" in df._jdf.queryExecution().logical().toString()


def _made(path):
    import os

    os.makedirs(path)
    return path


def test_stream_loads_each_file_and_key_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "event_id long, ts timestamp, event_type string"

    def drop_file(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")

    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    drop_file([(1, t, "a"), (2, t, "b"), (1, t, "a")], "d1")
    s = spark.read.parquet(f"{src}/d1").schema
    arrivals.load_new(arrivals.arrivals(spark, src, s), out, state, ["event_id"])
    assert spark.read.parquet(out).count() == 2
    drop_file([(2, t, "b"), (3, t, "c")], "d2")
    arrivals.load_new(arrivals.arrivals(spark, src, s), out, state, ["event_id"])
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    drop_file([(4, t - dt.timedelta(days=2000), "late"), (None, t, "no id"), (3, t, "c")], "d3")
    arrivals.load_new(arrivals.arrivals(spark, src, s), out, state, ["event_id"])
    drop_file([(5, t - dt.timedelta(days=900), "late"), (None, t, "no id")], "d4")
    arrivals.load_new(arrivals.arrivals(spark, src, s), out, state, ["event_id"])
    assert sorted(r["event_id"] or 0 for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5]


def test_a_batch_reads_new_files_only_and_a_restart_doubles_nothing(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = spark.range(1).schema
    arrivals.load_new(arrivals.arrivals(spark, _made(src), schema), out, state, ["id"])
    assert spark.read.schema(schema).parquet(out).count() == 0
    for i in range(4):
        spark.range(i * 50, i * 50 + 100).coalesce(1).write.parquet(f"{src}/d{i}")
        arrivals.load_new(arrivals.arrivals(spark, src, schema), out, state, ["id"])
        sources = json.loads((max((tmp_path / "state" / "sources" / "0").glob("[0-9]*"), key=lambda p: int(p.name))).read_text().split("\n")[1])
        assert sources["path"].count("/d") >= 1 and f"/d{i}/" in sources["path"]  # the batch holds the new file, not the target
        assert spark.read.parquet(out).count() == 100 + 50 * i
    newest = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.with_name(f".{newest.name}.crc").unlink(missing_ok=True)
    newest.unlink()  # as if the last batch had been stopped before it was committed
    arrivals.load_new(arrivals.arrivals(spark, src, schema), out, state, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(250))


def test_scan_reads_only_needed_columns(spark, sf):
    plan = tb.long_table(spark, sf, "coarse")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_tax" not in plan


def test_extract_is_rebuilt_only_when_the_source_is_newer(spark, tmp_path):
    import time

    source, target = str(tmp_path / "source"), str(tmp_path / "extract")
    spark.range(3).write.parquet(source)
    refresh = lambda: wc.refresh_extract(spark, source, target, lambda df: df.filter("id > 0"))
    assert refresh() and not refresh() and spark.read.parquet(target).count() == 2
    time.sleep(1.1)
    spark.range(5).write.mode("append").parquet(source)
    assert refresh() and spark.read.parquet(target).count() == 6


def test_week_numbers_have_no_bounds(spark):
    import datetime as dt

    from stockweave.functions import weeks as wk

    df = spark.createDataFrame([(189952,), (190001,), (220052,), (220101,), (250010,)], "w int")
    for r in df.select("w", wk.week_number("w").alias("n")).collect():
        monday = dt.date.fromisocalendar(r["w"] // 100, r["w"] % 100, 1)
        assert r["n"] == (monday - dt.date(1900, 1, 1)).days // 7
