"""Tables replaced as a whole in one step: numbered versions and their manifests.

A version is a Parquet folder of its own. It counts once its manifest stands in
``_manifests``; that is one rename, and readers take the highest number. A
writer that stops before the rename leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's path class and the file context of ``path``, local or in a store."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    home = fs.Path(path)
    home = home.getFileSystem(conf).makeQualified(home)
    return fs.Path, fs.FileContext.getFileContext(home.toUri(), conf)


def manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the versions that count, oldest first."""
    make, context = _hadoop(spark, path)
    folder = make(f"{path}/_manifests")
    if not context.util().exists(folder):
        return []
    names = [s.getPath().getName() for s in context.util().listStatus(folder)]
    return sorted((int(n.split("-", 1)[0]), f"{path}/{n}") for n in names if n[:1].isdigit())


def _switch(spark: SparkSession, path: str, number: int, name: str) -> None:
    """The version counts from here on."""
    make, context = _hadoop(spark, path)
    waiting = make(f"{path}/_manifests/_{name}")
    create = spark._jvm.java.util.EnumSet.of(getattr(spark._jvm.org.apache.hadoop.fs, "CreateFlag").CREATE)
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 1)
    none[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$CreateOpts").createParent()
    context.create(waiting, create, none).close()
    plain = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(waiting, make(f"{path}/_manifests/{number:010d}-{name}"), plain)


def replace(spark: SparkSession, df: DataFrame, path: str, partition: str | None = "year", keep: int = 2) -> str:
    """Write ``df``, which may read the table itself, as its next version; all but ``keep`` versions go.

    Of two writers at once, both versions are whole and the higher number
    counts; ``keep`` of 2 or more spares readers of the version before.
    """
    there = manifests(spark, path)
    number, name = (there[-1][0] + 1 if there else 1), uuid.uuid4().hex
    writer = df.write
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/{number:010d}-{name}")
    _switch(spark, path, number, name)
    make, context = _hadoop(spark, path)
    for _, folder in manifests(spark, path)[:-keep]:
        context.delete(make(f"{path}/_manifests/{folder.rsplit('/', 1)[1]}"), False)
        context.delete(make(folder), True)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The version that counts now."""
    there = manifests(spark, path)
    if not there:
        raise FileNotFoundError(f"no version of a table in {path}")
    return spark.read.parquet(there[-1][1])
