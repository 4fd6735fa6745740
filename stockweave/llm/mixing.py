"""Mixing sources to target weights, with DataFrame functions only.

The words of each source lie end to end, documents in the order of the MD5 of
their id, and are cut into blocks of a fixed number of words. The mix is a list
of slots, one block each, in output shards. A shard draws how many of its slots
each source gets (multinomial); the running count of a source's slots goes
through a pseudorandom permutation of the source's block numbers, one for each
round over the source, and slots meet blocks by number.

Random numbers are arithmetic on longs, so every engine and every rerun gets
the same ones.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockweave.llm.common import stored

WORD = "[^\\x20\\x09-\\x0D]+"
PRIME = 2147483647  # modulus of the random numbers
ROUNDS = 16  # of the permutation
BUCKET_ROWS = 1_000  # rows of a source that are numbered together, about
TASK_SLOTS = 100_000  # slots that a task makes, about


@dataclass
class Source:
    """A source's number in code point order, its words and blocks, and what the mix takes of it."""

    name: str | None
    size: int
    target: Fraction
    blocks: int
    quota: int


def targets(sizes: list[int], weights: list[Fraction], total: Fraction, most: Fraction) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    out = [Fraction(0)] * len(sizes)
    left, weight = total, sum(weights, Fraction(0))
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        out[i] = min(most * sizes[i], left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def plan(rows: list[tuple], weights: tuple, share, most: int, block: int) -> list[Source]:
    """Sources (name, size) with target and quota of blocks: as many as hold about the target's words."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    w = [Fraction(weights[i % len(weights)]) for i in range(len(rows))]
    want = targets([n for _, n in rows], w, Fraction(share) * sum(n for _, n in rows), Fraction(most))
    out = []
    for (name, n), t in zip(rows, want, strict=True):
        blocks = -(-n // block)
        quota = min(most * blocks, (2 * t * blocks + n) // (2 * n)) if n else 0
        out.append(Source(name, n, t, blocks, int(quota)))
    return out


def scrambled(x: str, key: str, div: str = "div") -> str:
    """SQL for a pseudorandom number below PRIME from the longs ``x`` >= 0 and ``key`` >= 0."""
    one = f"((({x}) % {PRIME} * 48271 + ({key}) % {PRIME}) % {PRIME})"
    two = f"(({one} * {one} + ({x}) % {PRIME} + ({x}) {div} {PRIME}) % {PRIME})"
    three = f"(({two} * 69621 + ({key}) % 1000003) % {PRIME})"
    return f"(({three} * {three} + {one}) % {PRIME})"


def drawn(x: str, seed: int, n: int | str, div: str = "div") -> str:
    """SQL for a number below ``n`` < 2^62 for slot ``x``."""
    return f"(({scrambled(x, str(seed), div)} * {PRIME} + {scrambled(x, str(seed + 1), div)}) % {n})"


def partner(r: int, seed: int) -> str:
    """SQL for what block number ``x`` of ``b`` may be swapped with in round ``r`` of the swap-or-not permutation."""
    mixed = f"((key * {48271 + 7919 * r} + {seed + r}) % {PRIME})"
    return f"(({mixed} * {mixed} + key) % {PRIME} % b + b - x) % b"


def swapped(r: int, div: str = "div") -> str:
    """SQL for the block number after round ``r``: ``x`` or its partner ``p``, by a coin both agree on."""
    mixed = f"((greatest(x, p) % {PRIME} * {69621 + 7919 * r} + key) % {PRIME})"
    return f"CASE WHEN ({mixed} * {mixed} + greatest(x, p)) % {PRIME} {div} 64 % 2 = 1 THEN p ELSE x END"


def at(values: list, i: Column) -> Column:
    """Entry ``i`` (from 0) of a list that is written into the plan."""
    return F.element_at(F.lit(values), (i + 1).cast("int"))


def place_of(df: DataFrame, value: str, ends: list[int], out: str) -> DataFrame:
    """Number of ``ends`` (rising) that are at most ``value``, by halving."""
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(0, len(ends).bit_length() - 1)
    while step and ends:
        past = F.col(out) + step
        inside = (past <= len(ends)) & (at(ends, F.least(past, F.lit(len(ends))) - 1) <= F.col(value))
        df = df.withColumn(out, F.when(inside, past).otherwise(F.col(out)))
        step >>= 1
    return df


def running(df: DataFrame, key: str, bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of ``key`` before this one; ``bucket`` follows the order and bounds what one task sorts."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = before(Window.partitionBy(key, bucket).orderBy(*order))
    rows = df.withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)))
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(
        F.col(key).alias("_key"),
        F.col(bucket).alias("_bucket"),
        F.coalesce(F.sum("_sum").over(before(Window.partitionBy(key).orderBy(bucket))), F.lit(0)).alias("_before"),
    )
    joined = rows.join(sums, (rows[key] == sums["_key"]) & (rows[bucket] == sums["_bucket"]))
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop("_key", "_bucket", "_before")


def numbered(items: DataFrame, sources: list[Source]) -> DataFrame:
    """``no`` of each item's source; sources join as a table of their known number."""
    spark = items.sparkSession
    rows = json.dumps([{"name": s.name, "no": i} for i, s in enumerate(sources)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<name: string, no: long>>")))
    return items.join(F.broadcast(table), items["source"].eqNullSafe(table["name"])).drop("name")


def slots(spark: SparkSession, sources: list[Source], shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, no, b, epoch, x): the k-th slot of a source is its block ``x`` of round ``epoch``, before permuting.

    Draws beyond a source's quota go, in order, to the sources that were drawn
    too seldom, so that totals are the quotas.
    """
    quota, blocks = [s.quota for s in sources], [s.blocks for s in sources]
    n, ends = sum(quota), [sum(quota[: i + 1]) for i in range(len(quota))]
    draws = spark.range(0, n).selectExpr(f"id div {shard_slots} AS shard", f"{drawn('id', seed, max(n, 1))} AS u")
    counts = place_of(draws, "u", ends, "no").groupBy("shard", "no").agg(F.count("*").alias("n"))
    got = {r["no"]: r["n"] for r in counts.groupBy("no").agg(F.sum("n").alias("n")).collect()}
    had = [got.get(i, 0) for i in range(len(quota))]
    over, under = [max(0, h - q) for h, q in zip(had, quota)], [max(0, q - h) for h, q in zip(had, quota)]
    before = lambda x: [sum(x[:i]) for i in range(len(x))]
    counts = counts.withColumn("bucket", F.expr("shard div 4096"))
    counts = running(counts, "no", "bucket", ["shard"], F.col("n"), "first")
    inside = Window.partitionBy("shard").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    counts = counts.repartition(max(1, n // TASK_SLOTS), "shard", "no")  # few small rows here, many slots next
    each = counts.select("shard", "no", "first", "offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    no, k = F.col("no"), F.col("first") + F.col("i")
    each = each.select("shard", (F.col("offset") + F.col("i")).alias("slot"), "no", k.alias("k"))
    k = F.col("k")
    fits = k < at(quota, no)
    each = each.withColumn("e", F.when(fits, F.lit(-1)).otherwise(at(before(over), no) + k - at(quota, no)))
    each = place_of(each, "e", [sum(under[: i + 1]) for i in range(len(under))], "other")
    other = F.least(F.col("other"), F.lit(max(0, len(quota) - 1)))
    moved = F.col("e") >= 0
    each = each.select(
        "shard",
        "slot",
        F.when(moved, other).otherwise(no).cast("long").alias("no"),
        F.when(moved, at(had, other) + F.col("e") - at(before(under), other)).otherwise(k).alias("k"),
    )
    each = each.withColumn("b", at(blocks, F.col("no")))
    return each.select("shard", "slot", "no", "b", F.expr("k div b").alias("epoch"), F.expr("k % b").alias("x"))


def permuted(df: DataFrame, seed: int) -> DataFrame:
    """``x`` of ``b`` through the swap-or-not permutation of its source and round: exactly one to one for any ``b``."""
    df = df.withColumn("key", F.expr(scrambled("no * 4096 + epoch", str(seed + 2))))
    kept = [c for c in df.columns if c != "x"]
    for r in range(ROUNDS):
        df = df.selectExpr(*kept, "x", f"{partner(r, seed)} AS p").selectExpr(*kept, f"{swapped(r)} AS x")
    return df.drop("key")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = (3, 1, 2),
    share: str = "1.5",
    most: int = 2,
    block_words: int = 128,
    shard_slots: int = 65_536,
    max_sources: int = 10_000,
    seed: int = 20_011,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their sources' targets, and the spans of words that make up the mix.

    Documents: ``no`` (of the source), ``source``, ``id``, ``size`` (words),
    ``start`` (words of the source before it), ``source_size``, ``target``.
    Spans: ``shard``, ``slot`` (of the shard), ``no``, ``id``, ``start`` (of the
    document, as above), ``from`` (first word in the document), ``length``.

    ``weights`` repeat over the sources in code point order, null last; together
    they get ``share`` of all words, and no source or document more than
    ``most`` times its own. Null and empty texts have no words and no spans. A
    null source is a source of its own. Repeated rows are documents of their
    own, with equal ids. A source with no words has target 0. Empty tables give
    empty tables. A text of any length is cut into blocks. Other columns are
    ignored. More than ``max_sources`` sources raise an error: their sizes are
    held by the driver and written into plans.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    items = docs.select(
        docs[source_col].cast("string").alias("source"),
        docs[id_col].alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    items = stored(items.groupBy("source", "id", "size").agg(F.count("*").alias("copies")), "mixing-items")
    words = F.col("size") * F.col("copies")
    sizes = items.groupBy("source").agg(F.sum(words).alias("n"), F.sum("copies").alias("rows")).limit(max_sources + 1).collect()
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold them")
    sources = plan([(r["source"], r["n"]) for r in sizes], weights, Fraction(share), most, block_words)

    digits, rows = 0, max([r["rows"] for r in sizes], default=0)
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    items = numbered(items, sources).withColumn("order", F.coalesce(F.md5(F.col("id").cast("string")), F.lit("")))
    items = items.withColumn("bucket", F.substring("order", 1, digits))
    items = running(items, "no", "bucket", ["order", "id", "size"], words, "start")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    rows_ = items.select("no", "source", "id", "size", "start", copy)
    source_no = F.col("no")
    documents = rows_.select(
        "no",
        "source",
        "id",
        "size",
        (F.col("start") + F.col("copy") * F.col("size")).alias("start"),
        at([s.size for s in sources], source_no).cast("long").alias("source_size") if sources else F.lit(0).cast("long").alias("source_size"),
        at([float(s.target) for s in sources], source_no).alias("target") if sources else F.lit(0.0).alias("target"),
    )
    documents = stored(documents, "mixing-documents")

    held = documents.filter("size > 0")
    last = F.expr(f"(start + size - 1) div {block_words}")
    held = held.select("no", "id", "start", "size", F.explode(F.sequence(F.expr(f"start div {block_words}"), last)).alias("x"))
    begin, end = F.col("x") * block_words, (F.col("x") + 1) * block_words
    held = held.select(
        "no",
        "x",
        "id",
        "start",
        (F.greatest("start", begin) - F.col("start")).alias("from"),
        (F.least(F.col("start") + F.col("size"), end) - F.greatest("start", begin)).alias("length"),
    )
    if not sources:
        return documents, held.select(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("slot"), *held.columns).drop("x")
    # Written first: the optimizer would carry what it infers for a join key down through all rounds.
    chosen = permuted(slots(spark, sources, shard_slots, seed), seed).select("shard", "slot", "no", "x")
    chosen = stored(chosen, "mixing-slots")
    spans = chosen.join(held, ["no", "x"])
    return documents, spans.select("shard", "slot", "no", "id", "start", "from", "length")


def taken(docs: DataFrame, **options) -> DataFrame:
    """Each document's id, ``size``, ``source_size``, ``target`` and ``taken`` (its words in the mix, repeats counted)."""
    documents, spans = mix(docs, **options)
    id_col = options.get("id_col", "doc_id")
    sums = spans.groupBy(F.col("no").alias("_no"), F.col("start").alias("_start")).agg(F.sum("length").alias("taken"))
    same = (documents["no"] == sums["_no"]) & (documents["start"] == sums["_start"]) & (documents["size"] > 0)
    got = documents.join(sums, same, "left")
    return got.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def statement(block: int = 128, shard_slots: int = 65_536, seed: int = 20_011, most: int = 2) -> str:
    """DuckDB's version of :func:`taken` for ``documents``, with weights 3, 1, 2 and a share of 3/2."""
    key = scrambled("no * 4096 + k // b", str(seed + 2), "//")
    inner = f"SELECT no, b, {key} AS key, k % b AS x FROM filled"
    for r in range(ROUNDS):
        inner = f"SELECT no, b, key, x, {partner(r, seed)} AS p FROM ({inner})"
        inner = f"SELECT no, b, key, {swapped(r, '//')} AS x FROM ({inner})"
    before = "OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][no % 3 + 1] AS w, (n + {block} - 1) // {block} AS b, sum(n) OVER () AS total FROM n),
o AS (
  SELECT *, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS w_left, 3 * total - 2 * {most} * coalesce(sum(n) OVER r, 0) AS left2
  FROM w WINDOW r AS (ORDER BY CAST(n AS DOUBLE) / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 2 * {most} * n * w_left <= w * left2 AS capped FROM o),
l AS (
  SELECT *, CASE WHEN capped THEN CAST({most} * n AS HUGEINT) ELSE CAST(w AS HUGEINT) * min(CASE WHEN NOT capped THEN 3 * total - 2 * {most} * held END) OVER () END AS num,
         CASE WHEN capped THEN 1 ELSE 2 * free END AS den
  FROM (SELECT *, coalesce(sum(CASE WHEN capped THEN n END) OVER (), 0) AS held, sum(CASE WHEN NOT capped THEN w END) OVER () AS free FROM c)),
q AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE least({most} * b, CAST((2 * num * b + CAST(den AS HUGEINT) * n) // (2 * CAST(den AS HUGEINT) * n) AS BIGINT)) END AS quota FROM l),
e AS (SELECT *, CAST(coalesce(sum(quota) {before.format(by="1", order="no")}, 0) AS BIGINT) AS low, CAST(sum(quota) OVER () AS BIGINT) AS slots FROM q),
u AS (
  SELECT id // {shard_slots} AS shard, {drawn("id", seed, "slots", "//")} AS u
  FROM (SELECT unnest(range(0, slots)) AS id, slots FROM (SELECT max(slots) AS slots FROM e))),
counts AS (SELECT shard, no, count(*) AS n FROM u JOIN e ON u >= low AND u < low + quota GROUP BY ALL),
had AS (
  SELECT no, b, quota, coalesce(h, 0) AS had FROM e LEFT JOIN (SELECT no, CAST(sum(n) AS BIGINT) AS h FROM counts GROUP BY no) USING (no)),
spare AS (
  SELECT *, CAST(coalesce(sum(greatest(had - quota, 0)) {before.format(by="1", order="no")}, 0) AS BIGINT) AS over_before,
         CAST(coalesce(sum(greatest(quota - had, 0)) {before.format(by="1", order="no")}, 0) AS BIGINT) AS under_before FROM had),
ks AS (
  SELECT shard, no, unnest(range(first, first + n)) AS k
  FROM (SELECT *, CAST(coalesce(sum(n) {before.format(by="no", order="shard")}, 0) AS BIGINT) AS first FROM counts)),
filled AS (
  SELECT shard, no, b, k FROM ks JOIN spare USING (no) WHERE k < quota
  UNION ALL
  SELECT shard, t.no, t.b, t.had + s.over_before + k - s.quota - t.under_before AS k
  FROM ks JOIN spare s ON ks.no = s.no AND k >= s.quota
  JOIN spare t ON t.quota > t.had AND s.over_before + k - s.quota >= t.under_before
       AND s.over_before + k - s.quota < t.under_before + t.quota - t.had),
times AS (SELECT no, x, count(*) AS n FROM ({inner}) GROUP BY ALL),
placed AS (
  SELECT row_number() OVER () AS r, no, doc_id, size, source_size, target, start FROM (
    SELECT no, doc_id, size, q.n AS source_size, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS target,
           CAST(coalesce(sum(size) {before.format(by="no", order="md5(CAST(doc_id AS VARCHAR)), doc_id, size")}, 0) AS BIGINT) AS start
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)),
pieces AS (
  SELECT r, no, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS x FROM placed WHERE size > 0),
got AS (
  SELECT r, sum(n * (least(start + size, (x + 1) * {block}) - greatest(start, x * {block}))) AS taken
  FROM pieces JOIN times USING (no, x) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN got USING (r)"""


__all__ = ["mix", "taken", "statement", "targets", "plan"]
