"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 128-bit key: hash of the text, then hash of the id. Exact
bytes below candidate keys are counted over all partitions; each splitter's
interval shrinks around its target until it is met within the tolerance. Rows
then move once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.common import fresh, parts_for, stored
from stockweave.llm.decontamination import small

PROBES = 32  # candidate keys per open splitter and round
SLICE_BYTES = 8 << 20  # rows of a shard are numbered in slices of about this size
TOP = 1 << 128


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """128-bit keys as 16 big-endian bytes, which sort as the numbers do."""
    pair = np.empty((len(high), 2), dtype=">u8")
    pair[:, 0] = high.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    pair[:, 1] = low.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return pair.view("S16").ravel()


def _bounds(numbers: list[int]) -> np.ndarray:
    return np.array([n.to_bytes(16, "big") for n in numbers], dtype="S16")


def bytes_below(rows: DataFrame, probes: list[int]) -> list[int]:
    """Exact total size over keys below each of the sorted probes."""
    at = _bounds(probes)

    def count(batches):
        total = np.zeros(len(at) + 1, dtype=np.int64)
        for b in batches:
            keys = _keys(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
            np.add.at(total, np.searchsorted(at, keys, side="right"), b.column(2).to_numpy(zero_copy_only=False))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["i", "n"])

    per_gap = rows.mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    gaps = np.zeros(len(at) + 1, dtype=np.int64)  # as many numbers as probes, whatever the input
    for r in per_gap.collect():
        gaps[r["i"]] = r["n"]
    return np.cumsum(gaps)[: len(at)].tolist()


def _probes(low: int, high: int) -> list[int]:
    """Keys inside an interval; between texts as long as more than one text hash is left."""
    step = max(1, (high - low) // (PROBES + 1))
    got = {low + k * step for k in range(1, PROBES + 1) if low + k * step < high}
    if (high >> 64) - (low >> 64) > 1:
        got = {p >> 64 << 64 for p in got}
    return sorted(p for p in got if low < p < high)


def find_splitters(rows: DataFrame, shards: int, total: int, tolerance: float) -> list[int]:
    """Keys that part the rows into ``shards`` ranges of near-equal bytes.

    A splitter is done when the bytes below it are within ``tolerance`` of a
    shard from its target, or when its interval cannot shrink further (rows
    with one and the same key). Splitters fall between different texts unless a
    text has too many copies for that.
    """
    goal = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    low, high = [0] * len(goal), [TOP - 1] * len(goal)
    best: list[tuple[float, int]] = [(float("inf"), 0)] * len(goal)
    open_ = set(range(len(goal)))
    while open_:
        wanted = sorted({p for k in open_ for p in _probes(low[k], high[k])})
        if not wanted:
            break
        below = bytes_below(rows, wanted)
        known = dict(zip(wanted, below, strict=True))
        for k in list(open_):
            mine = _probes(low[k], high[k])
            for p in mine:
                best[k] = min(best[k], (abs(known[p] - goal[k]), p))
            low[k] = max([low[k], *(p for p in mine if known[p] <= goal[k])])
            high[k] = min([high[k], *(p for p in mine if known[p] > goal[k])])
            if best[k][0] <= slack or not mine:
                open_.discard(k)
    return sorted(p for _, p in best)


def shard_by_bytes(
    docs: DataFrame,
    shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    tolerance: float = 0.005,
) -> DataFrame:
    """Deal all rows into ``shards`` ranges with sizes as equal as the tolerance.

    Size of a row: UTF-8 bytes of the text and ``overhead``. Adds ``size``,
    ``shard`` and ``slot`` (gapless from 0 in the shard) to the columns of
    ``docs``; columns that had these names are replaced. Equal texts are
    neighbours and share a shard, unless their group does not fit the tolerance
    and must be cut (by id hash).

    Null text counts as no bytes and sorts by the hash of null. Fully repeated
    rows have one key and stay together. Fewer rows than shards leave shards
    empty; empty input gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    h, g, part, start = fresh(docs, "h", "g", "part", "start")
    keyed = docs.select(
        *kept,
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + overhead).alias("size"),
        F.xxhash64(docs[text_col]).alias(h),
        F.xxhash64(docs[id_col], F.lit("slot")).alias(g),
    )
    rows = stored(keyed.select(h, g, "size"), "shard-keys")
    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    splitters = _bounds(find_splitters(rows, shards, total, tolerance) if total else [0] * (shards - 1))
    slices = parts_for(total // shards + 1, SLICE_BYTES)

    @F.pandas_udf("int")
    def shard_of(h: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, _keys(h.to_numpy(), g.to_numpy()), side="right"))

    placed = {"shard": shard_of(h, g), part: F.pmod(g, F.lit(slices)).cast("int")}
    counts = rows.withColumns(placed).groupBy("shard", part).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", part).orderBy(h, g)
    return (
        keyed.withColumns(placed)
        .repartition(shards * slices, "shard", part)
        .join(small(starts, shards * slices), ["shard", part])  # one row for many megabytes
        .withColumn("slot", F.col(start) + F.row_number().over(inside) - 1)
        .select(*kept, "size", "shard", "slot")
    )
