"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node's neighbours to the least of them, for larger (or smaller) neighbours."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        got = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        got = (
            down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
    return got.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Least node reachable from each node of the links ``a``, ``b`` (whole numbers): ``node``, ``root``.

    Links, nodes and roots stay distributed; a round halves path lengths at
    least, and each round is written to the shared folder.
    """
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "links")
    mark = None
    while True:
        now = stored(_stars(_stars(now, True), False), "stars")
        new = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == tuple(new):
            break
        mark = tuple(new)
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return stored(roots.union(now.select("b", "b").distinct()), "roots")
