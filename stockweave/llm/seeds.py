"""Seeds of repeated windows: which stretches of text can repeat at all.

A window (so many words or bytes in a row) is keyed by the least hash of the
short grams inside it. Equal windows have equal keys, so a window whose key is
found only once cannot repeat. Keys are counted by hash buckets; what a group
of documents sends to a bucket is one number per distinct key, so frequent
passages and copies shrink before they move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import mix64, parts_for, stored, text_bytes

GROUP_BYTES = 8 << 20  # text of one group of documents
CHUNK_BYTES = 1 << 20  # text hashed at once inside a group
HOT = 1000  # a key found so often is spread over buckets by the window itself
NO_ID = np.iinfo(np.int64).max  # null ids: after all others
LOW32 = np.uint64(0xFFFFFFFF)


@dataclass
class Chunk:
    """Some documents hashed together. Units are words or bytes."""

    raw: np.ndarray  # their bytes
    doc: np.ndarray  # for each unit the number of its document in the chunk
    gram: np.ndarray  # hash of the gram that starts at each unit
    ids: np.ndarray  # ids of the documents
    first: np.ndarray  # each document's first unit
    rows: slice  # the documents in the group


def sliding(op, x: np.ndarray, m: int) -> np.ndarray:
    """``op`` over every ``m`` neighbours, by doubling spans."""
    span = 1
    while 2 * span <= m:
        x, span = op(x[:-span], x[span:]), 2 * span
    return op(x[: len(x) - (m - span)], x[m - span :]) if span < m else x


def window_keys(c: Chunk, window: int, gram: int) -> np.ndarray:
    """Key of the window at each unit, 0 where a window would leave its document."""
    if len(c.doc) < window:
        return np.zeros(0, np.uint64)
    low = sliding(np.minimum, c.gram, window - gram + 1)
    low[c.doc[: len(low)] != c.doc[window - 1 :]] = 0
    return low


def seed_counts(c: Chunk, window: int, gram: int) -> np.ndarray:
    """Hashes of the grams that key some window, one for each place."""
    low, m = window_keys(c, window, gram), window - gram + 1
    if not len(low):
        return low
    pad = np.zeros(m - 1, np.uint64)
    most = sliding(np.maximum, np.concatenate([pad, low, pad]), m)
    return c.gram[(most == c.gram) & (most > 0)]


def runs(low: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of one key, none longer than ``longest``."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    size = np.diff(np.r_[start, len(low)])
    start, size = start[low[start] > 0], size[low[start] > 0]
    if len(size) and size.max() > longest:
        n = -(-size // longest)
        k = spread(n)
        start, size = np.repeat(start, n) + k * longest, np.minimum(np.repeat(size, n) - k * longest, longest)
    return start, size


def spread(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n[0]-1, 0, 1, .. n[1]-1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def take_spans(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The elements of several spans, one after the other."""
    return x[np.repeat(start, size) + spread(size)]


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``of``."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Numbers kept as binary values, end to end."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def sizes(column, width: int) -> np.ndarray:
    return np.array([len(x) // width for x in column.to_pylist()], dtype=np.int64)


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
    )


def chunks(docs: pa.Table, make: Callable[[list[bytes]], tuple]) -> Iterator[Chunk]:
    """Documents of a group in chunks of bounded size (one document may be longer)."""
    ids = docs.column("id").fill_null(NO_ID).to_numpy()
    texts, held, begin = docs.column("text"), [], 0
    total = 0
    for i in range(len(ids)):
        held.append((texts[i].as_py() or "").encode())
        total += len(held[-1])
        if total >= CHUNK_BYTES or i == len(ids) - 1:
            raw, doc, gram, first = make(held)
            yield Chunk(raw, doc, gram, ids[begin : i + 1], first, slice(begin, i + 1))
            held, begin, total = [], i + 1, 0


@dataclass
class Plan:
    """Documents dealt into groups, with what the groups have to know."""

    docs: DataFrame  # part, id, text, t1, t2
    groups: int
    copies: DataFrame  # part, t1, t2, first: least id of each text that several rows have
    seeds: DataFrame  # part, bucket, low, hot: recurring keys, with the copies


def without_copies(docs: pa.Table, told: pa.Table) -> tuple[pa.Table, pa.Table, list[tuple[int, int]]]:
    """Split off the rows whose whole text has a smaller id elsewhere.

    Returns the other rows, what else was told, and (row, least id) of the copies.
    """
    copy = told.column("t1").is_valid().to_numpy()
    lead = told.filter(pa.array(copy))
    first = {
        (a, b): c
        for a, b, c in zip(*(lead.column(n).to_pylist() for n in ("t1", "t2", "first")), strict=True)
    }
    texts = zip(docs.column("t1").to_pylist(), docs.column("t2").to_pylist(), strict=True)
    ids = docs.column("id").fill_null(NO_ID).to_pylist()
    gone = [(i, first[t]) for i, t in enumerate(texts) if t in first and first[t] < ids[i]]
    keep = np.ones(docs.num_rows, bool)
    keep[[i for i, _ in gone]] = False
    return docs.filter(pa.array(keep)), told.filter(pa.array(~copy)), gone


def find_copies(dealt: DataFrame) -> DataFrame:
    """Least id of each text with several rows, for each group that has it; one row per group and text."""
    ids = F.coalesce("id", F.lit(NO_ID))
    per_part = stored(dealt.groupBy("t1", "t2", "part").agg(F.min(ids).alias("least"), F.count("*").alias("n")), "texts")
    known = per_part.groupBy("t1", "t2").agg(F.min("least").alias("first"), F.sum("n").alias("n")).filter("n > 1")
    return stored(per_part.select("part", "t1", "t2").join(known.drop("n"), ["t1", "t2"]), "copies")


SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("low", pa.binary()), ("n", pa.binary())])
BACK = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("low", pa.binary()), ("times", pa.binary())])


SENT_SQL = "bucket int, part int, low binary, n binary"


def deal(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """Documents in groups of bounded text (part, id, text, t1, t2, carried columns as c0, c1, ..),
    their copies, number of groups."""
    groups = parts_for(text_bytes(docs, text_col), GROUP_BYTES)
    dealt = docs.select(
        F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(groups)).cast("int").alias("part"),
        docs[id_col].cast("long").alias("id"),
        docs[text_col].alias("text"),
        F.xxhash64(docs[text_col]).alias("t1"),
        F.hash(docs[text_col]).alias("t2"),
        *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)],
    )
    return dealt.repartition(groups, "part"), find_copies(dealt.select("part", "id", "t1", "t2")), groups


def counts_of(keys: np.ndarray, part: int, groups: int) -> pa.Table:
    """One number per distinct key of a group, by bucket."""
    keys, n = np.unique(keys, return_counts=True)
    mixed = mix64(keys)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    low, n = (mixed & LOW32).astype(np.uint32)[order], n.astype(np.uint32)[order]
    at = np.searchsorted(bucket[order], np.arange(groups + 1))
    rows = [
        (b, part, low[at[b] : at[b + 1]].tobytes(), n[at[b] : at[b + 1]].tobytes()) for b in np.unique(bucket).tolist()
    ]
    return table_of(SENT, rows)


def recurring_keys(sent: DataFrame, groups: int) -> DataFrame:
    """For each group, those of its keys that occur more than once anywhere, and how often."""

    def count(t: pa.Table) -> pa.Table:
        low, n = joined(t.column("low"), np.uint32), joined(t.column("n"), np.uint32)
        own = np.repeat(np.arange(t.num_rows), sizes(t.column("low"), 4))
        keys, inverse = np.unique(low, return_inverse=True)
        total = np.bincount(inverse, weights=n)[inverse]
        bucket, rows = t.column("bucket")[0].as_py(), []
        keep = total >= 2
        low, own, times = low[keep], own[keep], np.minimum(total[keep], LOW32).astype(np.uint32)
        at = np.searchsorted(own, np.arange(t.num_rows + 1))
        for i, part in enumerate(t.column("part").to_pylist()):
            if at[i] < at[i + 1]:
                mine = slice(at[i], at[i + 1])
                rows.append((part, bucket, low[mine].tobytes(), times[mine].tobytes()))
        return table_of(BACK, rows)

    return (
        sent.repartition(groups, "bucket")
        .groupBy("bucket")
        .applyInArrow(count, "part int, bucket int, low binary, times binary")
    )


def recurring(
    docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, make, carry: tuple[str, ...] = ()
) -> Plan:
    """Deal documents into groups and find the window keys that occur more than once."""
    dealt, copies, groups = deal(docs, id_col, text_col, carry)

    def send(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return SENT.empty_table()
        part = t.column("part")[0].as_py()
        t, _, _ = without_copies(t, told)
        got = [seed_counts(c, window, gram) for c in chunks(t, make)]
        return counts_of(np.concatenate(got or [np.zeros(0, np.uint64)]), part, groups)

    sent = dealt.groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(send, SENT_SQL)
    back = recurring_keys(sent, groups)
    return Plan(dealt, groups, copies, back.unionByName(copies, allowMissingColumns=True))


def candidates(
    c: Chunk, window: int, gram: int, of: Callable, seeds: np.ndarray, times: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with a recurring key: start, length, key and whether it is a hot one.

    ``of``, ``seeds`` and ``times`` come from :func:`seed_keys`. Runs of hot keys
    are single windows.
    """
    low = window_keys(c, window, gram)
    start, size = runs(low, window // 2)
    key = low[start]
    number = of(key)
    keep = member(number, seeds)
    start, size, key = start[keep], size[keep], key[keep]
    is_hot = times[np.searchsorted(seeds, number[keep])] >= HOT if len(seeds) else np.zeros(0, bool)
    if is_hot.any():
        n = np.where(is_hot, size, 1)
        start = np.repeat(start, n) + np.where(np.repeat(is_hot, n), spread(n), 0)
        size = np.where(is_hot, 1, size).repeat(n)
        key, is_hot = key.repeat(n), is_hot.repeat(n)
    return start, size, key, is_hot


def seed_keys(t: pa.Table, groups: int) -> tuple[Callable, np.ndarray, np.ndarray]:
    """A group's recurring keys: how to number keys (bucket, low bits), their sorted numbers, how often."""
    low = joined(t.column("low"), np.uint32).astype(np.uint64)
    bucket = np.repeat(t.column("bucket").to_numpy().astype(np.uint64), sizes(t.column("low"), 4))
    number = bucket << np.uint64(32) | low
    order = np.argsort(number)
    times = joined(t.column("times"), np.uint32)

    def of(keys: np.ndarray) -> np.ndarray:
        mixed = mix64(keys)
        return (mixed >> np.uint64(32)) % np.uint64(groups) << np.uint64(32) | mixed & LOW32

    return of, number[order], times[order]
