"""Whitening of embeddings; components by QDWH spectral divide-and-conquer.

The covariance of the distinct grid vectors is summed in tasks and is the only
thing the driver holds (dimension squared). The polar factor of the covariance
minus a shift has eigenvalues -1 and 1, so it splits space into the invariant
subspaces below and above the shift; the parts are split again until each is
one component. The components are sent to the tasks, which project the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import stored

EPS = np.finfo(float).eps
LEAST = 1e-12  # eigenvalues below this share of the largest one count as zero
FAR = 2.0**52  # entries beyond count as this
OFFSET, STEP = 1_000_000, 64


def polar(a: np.ndarray) -> np.ndarray | None:
    """Orthogonal factor of a symmetric matrix by dynamically weighted Halley steps, or None if it is singular.

    Early steps, with large weights, use QR; later ones a Cholesky factor.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n))
    except np.linalg.LinAlgError:
        return None
    if not EPS / 4 < low:
        return None
    low, eye = min(low, 1.0), np.eye(n)
    for _ in range(30):
        d = np.cbrt(4 * max(0.0, 1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            half = np.linalg.cholesky(eye + wc * x.T @ x)
            right = np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
            new = wb / wc * x + (wa - wb / wc) * right
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-14 * n and 1 - low < 1e-14:
            break
    return x


def halves(a: np.ndarray, noise: float, rng) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift, or None if no shift parts them."""
    n, diag = len(a), np.diag(a)
    spread = np.ptp(diag)
    shifts = [np.median(diag), diag.mean()]
    shifts += [diag.min() + spread * s for s in (0.5, 0.381966, 0.618034, 0.25, 0.75, 0.1, 0.9)] if spread else []
    best, least = None, np.inf
    for shift in shifts:
        sign = polar(a - shift * np.eye(n))
        if sign is None:
            continue
        rank = round(float(np.trace(sign) + n) / 2)
        if not 0 < rank < n:
            continue
        upper = (sign + np.eye(n)) / 2
        basis = np.hstack([upper @ rng.standard_normal((n, rank)), (np.eye(n) - upper) @ rng.standard_normal((n, n - rank))])
        basis, _ = np.linalg.qr(basis)
        basis, _ = np.linalg.qr(np.hstack([upper @ basis[:, :rank], basis[:, rank:] - upper @ basis[:, rank:]]))
        above, below = basis[:, :rank], basis[:, rank:]
        left = np.linalg.norm(below.T @ a @ above)
        if left < least:
            best, least = (above, below), left
        if left <= noise:
            break
    return best if least <= 100 * noise else None


def components_of(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    What no shift can part has equal eigenvalues to working precision.
    """
    n = len(cov)
    size = np.linalg.norm(cov)
    noise, rng = 8 * EPS * size * np.sqrt(max(n, 1)), np.random.default_rng(11)
    values, vectors = [], []
    open_parts = [np.eye(n)] if n else []
    while open_parts:
        basis = open_parts.pop()
        a = basis.T @ cov @ basis
        a = (a + a.T) / 2
        off = a - np.diag(np.diag(a))
        parts = None if len(a) == 1 or np.linalg.norm(off) <= 4 * EPS * size else halves(a, noise, rng)
        if parts is None:
            values.extend(np.diag(a))
            vectors.extend(basis.T)
        else:
            open_parts += [basis @ p for p in parts]
    order = np.argsort(-np.array(values), kind="stable")
    out = np.array(vectors).reshape(-1, n).T[:, order]
    return np.array(values)[order], out / np.linalg.norm(out, axis=0) if n else out


def grid(vector: Column) -> Column:
    """Each entry c as the long floor(64 c) + 1000000."""
    c = lambda v: F.greatest(F.least(v.cast("double"), F.lit(FAR)), F.lit(-FAR))
    return F.transform(vector, lambda v: F.floor(c(v) * STEP).cast("long") + F.lit(OFFSET).cast("long"))


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as an integer matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(df: DataFrame, what, size: int) -> np.ndarray:
    """Sum over all rows of what ``what(x)`` gives for the matrix of a batch: ``size`` numbers.

    Each task adds up its own rows; what they send meets by slice of the numbers.
    """
    each = 512

    def part(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += what(matrix(b.column(0)))
        cuts = range(0, size, each)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(cuts)), pa.int32()),
                pa.array([total[c : c + each] for c in cuts], pa.list_(pa.float64())),
            ],
            ["cut", "v"],
        )

    def add(t: pa.Table) -> pa.Table:
        v = pa.array([matrix(t.column("v")).sum(axis=0)], pa.list_(pa.float64()))
        return pa.table({"cut": t.column("cut").slice(0, 1), "v": v})

    kind = "cut int, v array<double>"
    got = df.mapInArrow(part, kind).groupBy("cut").applyInArrow(add, kind)
    cuts = {r["cut"]: r["v"] for r in got.collect()}
    return np.concatenate([cuts[k] for k in sorted(cuts)]) if cuts else np.zeros(size)


def outer(y: np.ndarray) -> np.ndarray:
    return (y.T @ y).ravel()


def whiten(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16
) -> DataFrame:
    """Projection of every row on the leading components, scaled to unit variance.

    One row per input row and component: the id, ``component`` (from 1, by
    falling eigenvalue), ``n`` (distinct grid vectors, on which everything is
    fitted), ``deviation`` (sum over dimensions of (n x - S)^2, exact; null if
    it does not fit a long), ``whitened``, ``explained`` (eigenvalue over trace)
    and ``identity_error`` (largest entry of the whitened fit list's covariance
    minus the identity).

    Rows are left out if their vector is null, holds null or non-finite entries
    or has another length than most of the others (the longer one in a tie).
    Repeated rows and vectors each get their rows, but count once in the fit.
    Components without variance are left out: one distinct vector, or an empty
    table, gives no rows. Components of equal eigenvalues are any orthonormal
    choice. Entries beyond 2^52 count as that. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    v = F.col("v")
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v"))
    rows = rows.filter(v.isNotNull() & F.forall("v", lambda c: F.coalesce(finite(c), F.lit(False))) & (F.size("v") > 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    d = most["d"]
    rows = rows.filter(F.size("v") == d).select("id", grid(v).alias("x"))
    fit = stored(rows.select("x").distinct(), "whitening-fit")

    counted = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.max(F.abs("x")).alias("top")
    )
    per_dim = sorted(counted.collect())
    n, total = per_dim[0]["n"], [int(r["s"]) for r in per_dim]
    middle = np.array([s // n for s in total])
    rest = np.array([s % n / n for s in total])  # x - S/n is (x - middle) - rest, without rounding x
    far = max(int(r["top"]) + abs(int(m)) for r, m in zip(per_dim, middle, strict=True))

    cov = summed(fit, lambda x: outer((x - middle) - rest), d * d).reshape(d, d) / n
    values, vectors_ = components_of(cov)
    k = min(components, int((values > LEAST * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    scaled = vectors_[:, :k] / np.sqrt(values[:k])
    if not k:
        return spark.createDataFrame([], schema)

    def check(x):
        w = ((x - middle) - rest) @ scaled
        return np.concatenate([w.sum(axis=0), outer(w)])

    sums = summed(fit, check, k + k * k)
    mean = sums[:k] / n
    error = float(np.abs(sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    share = values[:k] / np.trace(cov)
    exact = d * (n * far) ** 2 < 2**62

    def deviations(x):
        if exact:
            return ((n * (x - middle) - np.array([s - n * int(m) for s, m in zip(total, middle, strict=True)])) ** 2).sum(axis=1)
        got = [sum((n * int(a) - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
        return [g if g < 2**63 else None for g in got]

    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = matrix(part.column(1))
                w, m = ((x - middle) - rest) @ scaled, part.num_rows
                dev = pa.array(deviations(x), pa.int64())
                again = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    dev.take(again),
                    pa.array(w.ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ]
                names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names)

    named = schema.replace(f"`{id_col}`", "id", 1)
    return rows.mapInArrow(project, named).withColumnRenamed("id", id_col)


__all__ = ["whiten", "components_of", "polar"]
