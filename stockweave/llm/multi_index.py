"""Approximate nearest neighbours with an inverted multi-index.

Both halves of a vector are quantised on their own; a cell is a pair of
centroids. A query walks the pairs by rising summed distance with a heap until
its cells hold enough distinct vectors, and the entries are reranked by exact distance.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.common import mix64, parts_for, stored
from stockweave.llm.seeds import spread

SAMPLE = 20_000  # vectors the codebooks are fitted on, at most
MAX_CENTROIDS = 256  # in each half, so that the cell counts stay a small table
CHUNK = 2048  # entries of a cell that are reranked together


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of the rows by Lloyd's rounds from a random start; empty ones restart at the farthest rows."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        d = distances(x, centre)
        near = d.argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            centre[empty] = x[np.argsort(-d.min(axis=1))[: len(empty)]]
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)[None, :], 0)


def walk(left: np.ndarray, right: np.ndarray, count: np.ndarray, enough: int) -> np.ndarray:
    """Cells in order of ``left[i] + right[j]`` until their ``count`` reaches ``enough``."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    x, y, width = left[a].tolist(), right[b].tolist(), len(right)
    held = count.reshape(-1, width)[a][:, b].tolist()
    heap, got, found = [(x[0] + y[0], 0, 0)], 0, []
    while heap and got < enough:
        _, i, j = heap[0]
        if held[i][j]:
            found.append((i, j))
            got += held[i][j]
        if j + 1 < width:
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    at = np.array(found, np.int64).reshape(-1, 2)
    return a[at[:, 0]] * width + b[at[:, 1]]


def rows_of(column) -> np.ndarray:
    """A list column of equal lengths as a matrix in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    enough: int = 6000,
    share: float = 0.3,
    sample: int = SAMPLE,
) -> DataFrame:
    """The ``k`` nearest of ``vectors`` found for each of ``queries``, by Euclidean distance.

    Returns query_id, rank (from 1), the id and score (the exact distance in
    double precision), ties to the smaller id. A row is no neighbour of the
    query with its id. Codebooks are fitted on at most ``sample`` vectors, the
    rows with the least hash; every row is indexed. A query looks at cells with
    ``enough`` distinct vectors in all, or ``share`` of the distinct vectors if that is
    more, with all their copies; with no more than ``enough`` of them the search is exact.

    Rows with a null id, and vectors that are null, all zero, hold null or
    non-finite components or have another length than most take no part, as
    entries or queries. Of equal vectors, the ``k + 1`` least ids are kept: no
    answer can hold others. Repeated rows count once. Other columns are ignored;
    empty tables give no rows.
    """
    usable = (
        F.col("id").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.exists("v", lambda x: x != 0)
    )

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(usable).distinct()

    entries = clean(vectors)
    size = entries.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, id long, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    dim = size["n"]
    half = max(1, dim // 2)
    same = Window.partitionBy("v1", "v2").orderBy("id")
    entries = (
        entries.filter(F.size("v") == dim)
        .withColumns({"v1": F.xxhash64("v"), "v2": F.hash("v")})
        .withColumn("copy", F.row_number().over(same))
        .filter(F.col("copy") <= k + 1)
    )
    entries = stored(entries.select("id", "v", "copy"), "entries")
    distinct = entries.filter("copy = 1")
    n = distinct.count()
    centroids = min(MAX_CENTROIDS, max(1, n // 40))
    picked = distinct.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
    fit = np.stack(picked["v"].to_numpy()).astype(np.float64)
    books = [fit_codebook(x, min(centroids, len(fit))) for x in (fit[:, :half], fit[:, half:])]
    width = len(books[1])

    def cells(x: np.ndarray) -> np.ndarray:
        i, j = (distances(p, book).argmin(axis=1) for p, book in zip((x[:, :half], x[:, half:]), books, strict=True))
        return i * width + j

    def assign(batches):
        for b in batches:
            cell = pa.array(cells(rows_of(b.column(1))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, cell], ["id", "v", "copy", "cell"])

    index = stored(entries.mapInArrow(assign, "id long, v array<double>, copy int, cell int"), "index")
    count, held = np.zeros((2, len(books[0]) * width), np.int64)  # distinct vectors, which end the walk, and entries
    sizes = index.groupBy("cell").agg(F.count_if(F.col("copy") == 1).alias("n"), F.count("*").alias("held"))
    for r in sizes.collect():  # at most MAX_CENTROIDS squared
        count[r["cell"]], held[r["cell"]] = r["n"], r["held"]
    parts = np.maximum(-(-held // CHUNK), 1)  # a large cell is spread over several buckets
    look_at = int(max(enough, share * n))
    buckets = parts_for(n * dim * 8, 4 << 20)

    def bucket_of(cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix64(cell.astype(np.uint64) << np.uint64(32) | part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)

    def place(batches):
        for b in batches:
            cell = b.column(2).to_numpy().astype(np.int64)
            part = mix64(b.column(0).to_numpy().view(np.uint64)) % parts[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(cell, part)), *b.columns], ["bucket", "id", "v", "cell"])

    def visit(batches):
        for b in batches:
            x = rows_of(b.column(1))
            left, right = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
            row, to, which = [], [], []
            for r in range(len(x)):
                cell = walk(left[r], right[r], count, look_at)
                part = spread(parts[cell])
                cell = np.repeat(cell, parts[cell])
                bucket = bucket_of(cell, part)
                for k_ in np.unique(bucket).tolist():
                    row.append(r)
                    to.append(k_)
                    which.append(cell[bucket == k_].astype(np.int32).tobytes())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(which, pa.binary())],
                ["bucket", "query", "q", "cells"],
            )

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        cell = held.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        ids, x, cell = held.column("id").to_numpy()[order], rows_of(held.column("v"))[order], cell[order]
        q, own = rows_of(asked.column("q")), asked.column("query").to_numpy()
        rows: list[tuple] = []
        for r, want in enumerate(asked.column("cells").to_pylist()):
            want = np.unique(np.frombuffer(want, np.int32))
            lo, hi = np.searchsorted(cell, want), np.searchsorted(cell, want, side="right")
            at = np.repeat(lo, hi - lo) + spread(hi - lo)
            at = at[ids[at] != own[r]]
            d = np.sqrt(((x[at] - q[r]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], d))[:k]
            rows += zip([int(own[r])] * len(best), ids[at][best].tolist(), d[best].tolist(), strict=True)
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    tasks = max(buckets, vectors.sparkSession.sparkContext.defaultParallelism)
    visits = clean(queries).filter(F.size("v") == dim).repartition(tasks, "id").mapInArrow(
        visit, "bucket int, query long, q array<double>, cells binary"
    )
    placed = index.select("id", "v", "cell").mapInArrow(place, "bucket int, id long, v array<double>, cell int")
    near = (
        visits.repartition(buckets, "bucket").groupBy("bucket")
        .cogroup(placed.repartition(buckets, "bucket").groupBy("bucket"))
        .applyInArrow(rerank, "query_id long, id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        near.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
