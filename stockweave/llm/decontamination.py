"""Benchmark decontamination by winnowing, in DataFrame operations only.

A fingerprint is the least hash of the short word grams in a window of words;
equal windows have equal fingerprints, so every shared window is found. Matching
fingerprints are extended word by word on both sides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import stored

GRAM = 5
SMALL_ROWS = 200_000  # rows of numbers and short word lists that may be broadcast
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["row_key_1", "row_key_2"]


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, with A-Z in lower case."""
    low = F.when(
        text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    ).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """96 bits that name a row; rows with equal id and text share them, and their result."""
    return [
        F.xxhash64(docs[id_col], docs[text_col]).alias(KEY[0]),
        F.hash(docs[text_col], docs[id_col]).alias(KEY[1]),
    ]


def with_grams(df: DataFrame, n: int) -> DataFrame:
    """Hash of the ``n`` words from each place; needs ``words``."""
    h = F.col("h")
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    places = F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0)))
    gram = F.transform(places, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]))
    return df.withColumn("grams", gram).drop("h")


def with_fingerprints(df: DataFrame, window: int, n: int) -> DataFrame:
    """Distinct least gram hashes over every window of ``window`` words; needs ``grams``."""
    g, m = F.col("grams"), window - n + 1
    if m == 1:
        return df.withColumn("prints", F.array_distinct(g))
    starts = F.slice(g, 1, F.greatest(F.size(g) - (m - 1), F.lit(0)))
    least = F.transform(starts, lambda _, i: F.array_min(F.slice(g, i + 1, m)))
    return df.withColumn("prints", F.array_distinct(least))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def equal_run(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    stop = F.array_position(same, False)
    return F.when(stop == 0, n).otherwise(stop.cast("int") - 1)


def around(w: str, at: Column, n: int, reach: int) -> list[Column]:
    """The gram at a place, and the words before (nearest first) and after it."""
    before = F.least(at, F.lit(reach))
    return [
        F.slice(F.col(w), at + 1, n).alias("gram"),
        F.reverse(F.slice(F.col(w), at - before + 1, before)).alias("left"),
        F.slice(F.col(w), at + n + 1, reach).alias("right"),
    ]


def shared_spans(docs: DataFrame, items: DataFrame, base: DataFrame, window: int, size: int) -> DataFrame:
    """Spans of documents that cover windows of ``size`` words of an item."""
    n = min(GRAM, size) if size == window else size
    reach = size - n
    of_size = items.filter(F.size("words") >= size if size == window else F.size("words") == size)
    anchors = (
        with_fingerprints(with_grams(of_size, n), size, n)
        .select("item", "words", "prints", F.posexplode("grams").alias("q", "fp"))
        .filter(F.array_contains("prints", F.col("fp")))
        .select("item", "fp", *around("words", F.col("q"), n, reach))
        .distinct()
    )
    anchors = stored(anchors, "item-anchors")
    item_rows = anchors.count()
    found = (
        base.select(*KEY, F.explode(f"prints_{size}").alias("fp"))
        .join(small(anchors.select("fp").distinct(), item_rows), "fp")
        .groupBy(*KEY)
        .agg(F.collect_set("fp").alias("fps"))
    )
    found = stored(found, "winnow-hits")
    hit_docs = with_grams(docs.join(small(found, found.count()), KEY), n)
    places = F.filter(
        F.transform("grams", lambda x, i: F.struct(i.alias("p"), x.alias("fp"))),
        lambda s: F.array_contains("fps", s["fp"]),
    )
    at = (
        hit_docs.select(*KEY, "words", F.explode(places).alias("at"))
        .select(*KEY, "at.p", "at.fp", *around("words", F.col("at.p"), n, reach))
        .alias("d")
    )
    pair = at.join(small(anchors, item_rows).alias("i"), (F.col("d.fp") == F.col("i.fp")) & (F.col("d.gram") == F.col("i.gram")))
    left, right = equal_run(F.col("d.left"), F.col("i.left")), equal_run(F.col("d.right"), F.col("i.right"))
    return (
        pair.select(*[f"d.{k}" for k in KEY], "d.p", "i.item", left.alias("l"), right.alias("r"))
        .filter(F.col("l") + n + F.col("r") >= size)
        .select(*KEY, "item", (F.col("p") - F.col("l")).alias("a"), (F.col("p") + (n - 1) + F.col("r")).alias("b"))
        .distinct()
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: int = 20,
) -> DataFrame:
    """Words of each document that lie in a window of ``window`` words of an item.

    An item with fewer words is one window. Returns per row of ``docs``:
    ``row_key_1`` and ``row_key_2`` (:func:`keyed`), the id, ``n_words``,
    ``n_hit``, ``n_items``, ``item_ids`` (strings, sorted) and ``contaminated``
    (hit words are at least one in ``share``).

    Null and empty texts have no words. Items without id, text or words are no
    items; rows of one item id count as one item. Repeated documents give
    repeated rows. Other columns are ignored, whatever their names. No items:
    no hits; no documents: no rows.
    """
    rows = docs.select(*keyed(docs, id_col, text_col), docs[id_col].alias("id"), words(docs[text_col]).alias("words"))
    tests = (
        items.filter(items[item_col].isNotNull())
        .select(items[item_col].cast("string").alias("item"), words(items[item_text_col]).alias("words"))
        .filter(F.size("words") > 0)
    )
    tests = stored(tests, "items")
    lengths = tests.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()  # at most 13
    lengths = sorted({window, *(r["n"] for r in lengths)})
    base = rows
    for size in lengths:
        n = min(GRAM, size) if size == window else size
        base = with_fingerprints(with_grams(base, n), size, n).withColumnRenamed("prints", f"prints_{size}").drop("grams")
    base = stored(base.withColumn("n_words", F.size("words").cast("long")).drop("words"), "winnow")
    spans = None
    for size in lengths:
        got = shared_spans(rows, tests, base, window, size)
        spans = got if spans is None else spans.unionByName(got)
    inside = F.transform(F.collect_set(F.struct("a", "b")), lambda s: F.sequence(s["a"], s["b"]))
    hits = spans.groupBy(*KEY).agg(
        F.size(F.array_distinct(F.flatten(inside))).cast("long").alias("hit"),
        F.sort_array(F.collect_set("item")).alias("found"),
    )
    hits = stored(hits, "contaminated")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return (
        base.select(*KEY, "id", "n_words")
        .join(small(hits, hits.count()), KEY, "left")
        .select(
            *KEY,
            F.col("id").alias(id_col),
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("found", F.array().cast("array<string>")).alias("item_ids"),
            ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = contamination(docs, items, **options).filter("contaminated").select(*KEY).distinct()
    bad = stored(bad, "rejected")
    k1, k2 = keyed(docs, id_col, text_col)
    small_bad = small(bad, bad.count())
    return docs.join(small_bad, (k1 == small_bad[KEY[0]]) & (k2 == small_bad[KEY[1]]), "left_anti")
