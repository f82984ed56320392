"""Embedding whitening by leading principal components.

Three narrow passes over the vectors, each with one bounded result per task: exact sums of every
dimension (count, sums as decimals), the covariance of the vectors centred before they are
multiplied, and the covariance of the result as a check. The covariance (dimension x dimension) is
decomposed on the driver (``eigen``); the components are broadcast and projected in a last pass that
leaves rows where they are. Nothing is grouped by a key of the data, so there is no hot group.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundscope.llm import eigen

WIDE = pa.decimal128(38, 0)


def integers(vector: Column, scale: int = 1024, offset: int = 100_000) -> Column:
    """floor(scale * c) + offset of each entry c, as long; null where the vector is null or holds a
    null or non-finite entry, or one whose product is not below 2^62 in size."""
    c = F.transform(vector, lambda v: v.cast("double") * scale)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= float(2**62)))
    return F.when(vector.isNotNull() & ~bad, F.transform(c, lambda v: F.floor(v).cast("long") + offset))


def _matrix(column: pa.Array, dim: int, offset: int) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), dim), offset, np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _sums(batches):
    """One row per position: rows that have it, their sum and nothing else."""
    n, total = np.zeros(0, np.int64), np.zeros(0, object)
    for b in batches:
        for a in range(0, b.num_rows, 4096):
            column = b.column(0).slice(a, 4096)
            size = np.diff(column.offsets.to_numpy())
            dim = max(int(size.max(initial=0)), len(n))
            x = _matrix(column, dim, 0)
            part = x.sum(0) if not x.size or np.abs(x.astype(float)).max() * len(x) < 2**62 else x.astype(object).sum(0)
            have = (np.arange(dim)[None, :] < size[:, None]).sum(0)
            n, total = np.pad(n, (0, dim - len(n))) + have, np.concatenate([total, np.zeros(dim - len(total), object)]) + part
    if len(n):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n),
                                          pa.array([Decimal(int(v)) for v in total], WIDE)], names=["pos", "n", "s"])


def _added(df: DataFrame, run, size: int) -> np.ndarray:
    """Sums by position of the (pos, v) rows that every task returns once."""
    out = np.zeros(size)
    t = df.mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).toArrow()
    out[t.column("pos").to_numpy()] = t.column("v").to_numpy()
    return out


def _values(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["pos", "v"])


def _square_sums(d: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Exact sums over the columns of (n * d - rest)^2, null beyond 38 digits."""
    reach = float(np.abs(d).max(initial=0)) * n + n
    if reach * reach * max(1, d.shape[1]) < 2**62:
        return pa.array(((d * n - rest) ** 2).sum(1)).cast(WIDE)
    if reach < 2**48 and d.shape[1] < 2**13:  # in two halves of 24 bits, put together as Python integers
        y = np.abs(d * n - rest)
        a, b = y >> 24, y & (2**24 - 1)
        parts = zip(*((p.sum(1)).tolist() for p in (a * a, a * b, b * b)))
        sums = [(x << 48) + (y << 25) + z for x, y, z in parts]
    else:
        sums = [sum(v * v for v in row) for row in (d.astype(object) * n - rest.astype(object)).tolist()]
    return pa.array([Decimal(s) if s < 10**38 else None for s in sums], WIDE)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8,
           scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """One row per vector and component: ``id_col`` (any type, nulls and repeats stay), ``component``
    (int, from 1), ``n`` (vectors in the fit), ``deviation`` (decimal(38,0): sum over dimensions of
    (n*x - S)^2, exact), ``whitened``, ``explained`` and ``identity_error`` (doubles).

    x are the integers of ``integers``, S their sums over all vectors that have one; vectors without
    take no part. Shorter vectors count as ended in zero entries. Components are the leading unit
    eigenvectors of the covariance of x, the entry of largest size positive, at most as many as
    dimensions. ``whitened`` is x - S/n projected on the component over the root of its eigenvalue;
    along a component without variance (eigenvalue below rounding of the largest: fewer vectors than
    dimensions, equal vectors) it is null and ``explained`` 0. ``identity_error`` is the largest entry of the
    whitened covariance minus the identity over the components with variance, null if there is none.
    A ``deviation`` beyond 38 digits is null. No usable vector, or only empty ones, gives no rows.
    Tasks hold one matrix of dimension^2 doubles, the driver a few. The input is read four times
    and must not change meanwhile.
    """
    spark = vectors.sparkSession
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, deviation decimal(38,0), whitened double"
    rows = vectors.select(F.col(id_col), integers(F.col(vector_col), scale, offset).alias("__x")).where("__x is not null")
    x_only = rows.select("__x")
    n = rows.count()
    sums = x_only.mapInArrow(_sums, "pos int, n long, s decimal(38,0)").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    dim = len(sums)
    if not n or not dim:
        return spark.createDataFrame([], f"{schema}, n long, explained double, identity_error double").select(
            id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")
    total = [0] * dim
    for r in sums:
        total[r.pos] = int(r.s) + (n - r.n) * offset
    whole = np.array([t // n for t in total], np.int64)  # S = whole * n + rest: x - S/n loses no digit
    rest = np.array([t % n for t in total], np.int64)
    part = rest / n

    def centred(column):
        for a in range(0, len(column), 4096):
            d = _matrix(column.slice(a, 4096), dim, offset) - whole
            yield a, d, d - part

    upper = np.triu_indices(dim)

    def covariance(batches):
        c = np.zeros((dim, dim))
        for b in batches:
            for _, _, y in centred(b.column(0)):
                c += y.T @ y
        yield _values(c[upper])

    v = np.zeros((dim, dim))
    v[upper] = _added(x_only, covariance, len(upper[0])) / n
    v = v + np.triu(v, 1).T
    values, axes = eigen.leading(v, min(components, dim))
    k = len(values)
    live = values > dim * eigen.EPS * max(values[0], 0)
    by = np.where(live[:, None], axes / np.sqrt(np.where(live, values, 1))[:, None], 0)
    shared = spark.sparkContext.broadcast(by)

    def check(batches):
        s, c = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for _, _, y in centred(b.column(0)):
                w = y @ shared.value.T
                s += w.sum(0)
                c += w.T @ w
        yield _values(np.concatenate([s, c.ravel()]))

    sums_of = _added(x_only, check, k + k * k) / n
    error = np.abs(sums_of[k:].reshape(k, k) - np.outer(sums_of[:k], sums_of[:k]) - np.eye(k))[np.ix_(live, live)]

    def project(batches):
        for b in batches:
            for a, d, y in centred(b.column(1)):
                w, m = y @ shared.value.T, len(y)
                at = pa.array(np.repeat(np.arange(m), k))
                flat = pa.array(w.ravel(), mask=np.tile(~live, m))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, m).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                                                  _square_sums(d, n, rest).take(at), flat], names=[id_col, "component", "deviation", "whitened"])

    trace = np.trace(v)
    shares = F.array(*[F.lit(float(x / trace) if ok else 0.0) for x, ok in zip(values, live)])
    return rows.mapInArrow(project, schema).select(
        id_col, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(float(error.max()) if error.size else None).cast("double").alias("identity_error"))
