"""Yearly wide CSV files: reading, writing, fingerprints, lineage."""

from __future__ import annotations

import hashlib
import logging
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.functions.scalars import null_tokens
from stockweave.operators.reshape import melt_weeks, union_years
from stockweave.schema import QTY, SERIES, WEEK

log = logging.getLogger(__name__)


def read_wide(spark: SparkSession, path) -> DataFrame:
    """All columns as text; blank and NULL-like tokens become null."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_years(spark: SparkSession, paths: dict[int, str]) -> dict[int, DataFrame]:
    """One frame per year; a missing file is skipped with a warning."""
    out = {}
    for year, path in paths.items():
        try:
            out[year] = read_wide(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("no file for %s at %s, skipped", year, path)
    return out


def melt_years(frames: dict[int, DataFrame], strict: bool = True) -> DataFrame:
    return union_years([melt_weeks(df, strict=strict) for df in frames.values()])


def to_wide(df: DataFrame, year: int, text=None) -> DataFrame:
    """One row per series and one text column per ISO week of ``year``."""
    n = wk.week_span(year * 100 + 1, (year + 1) * 100 + 1)
    labels = [year * 100 + i for i in range(1, n + 1)]
    cell = F.sum(QTY)
    wide = df.filter(F.col(WEEK).between(labels[0], labels[-1])).groupBy(*SERIES).pivot(
        WEEK, labels
    ).agg(cell)
    text = text or (lambda c: c.cast("string"))
    return wide.select(*SERIES, *[text(F.col(f"`{w}`")).alias(str(w)) for w in labels])


def write_wide(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_bronze(frames: dict[int, DataFrame], path: str) -> str:
    """Wide rows as Parquet, one folder per source year (column sets differ)."""
    for year, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/source_year={year}")
    return path


def _hadoop_digest(spark: SparkSession, path: str) -> Column:
    """SHA-256 of the file named in column ``path``, streamed in the task's JVM.

    Hadoop opens it with the session's settings, so any store that Spark reads
    will do, and a buffer of the file is held at a time.
    """
    from pyspark.sql.classic.column import Column as Classic

    jvm = spark._jvm
    sql, java = jvm.org.apache.spark.sql, jvm.java.lang.Class.forName
    objects, columns = sql.catalyst.expressions.objects, sql.classic.ExpressionUtils
    none = jvm.scala.Option.empty()

    def kind(name):
        return sql.types.ObjectType(java(name))

    def seq(*items):
        return jvm.org.apache.spark.api.python.PythonUtils.toSeq([*items])

    def call(target, method, gives, *args):
        return objects.Invoke(target, method, kind(gives), seq(*args), seq(), True, True, True)

    def new(name, arg):
        return objects.NewInstance(java(name), seq(arg), seq(), True, kind(name), none)

    conf = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    conf = sql.catalyst.expressions.Literal(conf, kind("org.apache.spark.util.SerializableConfiguration"))
    file = new("org.apache.hadoop.fs.Path", call(columns.expression(F.col(path)._jc), "toString", "java.lang.String"))
    store = call(file, "getFileSystem", "org.apache.hadoop.fs.FileSystem", call(conf, "value", "org.apache.hadoop.conf.Configuration"))
    # closed at its end
    stream = new("org.apache.commons.io.input.AutoCloseInputStream", call(store, "open", "org.apache.hadoop.fs.FSDataInputStream", file))
    total = objects.StaticInvoke(
        java("org.apache.commons.codec.digest.DigestUtils"), sql.types.DataTypes.BinaryType, "sha256", seq(stream), seq(), True, True, True, none
    )
    return F.lower(F.hex(Classic(columns.column(total))))


def file_hashes(spark: SparkSession, path, chunk: int = 64 << 20) -> DataFrame:
    """SHA-256 of the bytes of every file below ``path``.

    Files of stores that Python tasks can open are read ``chunk`` bytes at a
    time, files of other stores as a stream of Hadoop's; both may have any size,
    and no file becomes one record. Spark lists no empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    opens = F.col("path").rlike("^(file|hdfs|s3|gs):")

    def digest(batches):
        from urllib.parse import quote

        from pyarrow import fs

        for batch in batches:
            sums = []
            for name in batch["path"]:
                store, inner = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", name), safe="/:"))
                total = hashlib.sha256()
                with store.open_input_stream(inner) as f:
                    while data := f.read(chunk):
                        total.update(data)
                sums.append(total.hexdigest())
            yield batch.assign(sha256=sums)

    streamed = files.filter(opens).mapInPandas(digest, "path string, length long, sha256 string")
    return streamed.unionByName(files.filter(~opens).withColumn("sha256", _hadoop_digest(spark, "path")))


def shape_hash(df: DataFrame) -> DataFrame:
    """SHA-256 of the column list followed by the row count."""
    n = F.count("*")
    return df.agg(
        F.lit(len(df.columns)).alias("n_columns"),
        n.alias("n_rows"),
        F.sha2(F.concat(F.lit(str(list(df.columns))), n.cast("string")), 256).alias("sha256"),
    )


def lineage(frames: dict[int, DataFrame], event: str, source: str, target: str) -> DataFrame:
    """One row per year: where its rows came from, went to, and how many."""
    rows = [
        df.agg(F.count("*").alias("rows_written")).select(
            F.lit(event).alias("event"),
            F.lit(year).alias("year"),
            F.lit(source).alias("source"),
            F.lit(target).alias("destination"),
            "rows_written",
        )
        for year, df in frames.items()
    ]
    return union_years(rows)


def write_report(df: DataFrame, path: str, rows: int = 100_000) -> str:
    """A result as JSON: one file up to ``rows`` rows, as many as there are tasks beyond."""
    small = df.limit(rows + 1).count() <= rows
    (df.coalesce(1) if small else df).write.mode("overwrite").json(path)
    return path


def newest_file(spark: SparkSession, path: str):
    """When the newest Parquet file below ``path`` was written; nothing without a file."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        return files.agg(F.max("modificationTime")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def refresh_extract(spark: SparkSession, source: str, target: str, make) -> bool:
    """Write ``make(source table)`` to ``target`` if the source is newer; tells whether it was."""
    done = newest_file(spark, target)
    if done is not None and done >= newest_file(spark, source):
        return False
    make(spark.read.parquet(source)).write.mode("overwrite").parquet(target)
    return True


def write_table(df: DataFrame, path: str, partition: str | None = "year") -> str:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)
    return path
