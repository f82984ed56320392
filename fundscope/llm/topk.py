"""Exact top-k inner products as a Voronoi kNN join.

The k highest inner products are the k nearest neighbours after one more coordinate: with M the
largest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0), so |q - x|^2 = |q|^2 + M^2 - 2 q.x.
Both sides are grouped by the nearest of a few pivots. Summaries of the cells (rows, radius, the
k + 1 smallest pivot distances) bound, for every query cell, how far its k-th neighbour can be; by
the triangle inequality a row farther than that from all of the cell's queries can't be in a
result. Query cells are put together into groups of at most ``query_block`` queries (a cell with
more is split), each row goes only to the groups that need it, and every group is solved by tasks
of about ``data_block`` rows with whole matrix products. Best lists of the tasks are merged by a
window that ranks at most k rows per query and task.

Rows that share one vector are equal in every score, so only the k + 1 smallest ids of a vector
can be in a result (ties go to the smaller id, and one may be the query itself): a vector that a
third of all rows share is cut down before the shuffle.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundscope.llm.common import store

def quantise(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long, null where the vector is null or has a null or
    non-finite component, or one whose product is not below 2^62 in size."""
    x = F.transform(vector, lambda v: v.cast("double") * scale)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= float(2**62)))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v).cast("long")))


def exact_scores(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` that can be among the k best of ``q`` and their exact inner products as Python
    integers: products in doubles choose them, with the bound of their rounding as a margin."""
    near = x.astype(np.float64) @ q.astype(np.float64)
    if len(near) > k:
        off = 4 * (len(q) + 2) * np.finfo(float).eps * float(np.abs(x.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).sum())
        rows = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - 2 * off)
    else:
        rows = np.arange(len(near))
    return rows, x[rows].astype(object) @ q.astype(object)


def _matrix(column, dim: int) -> np.ndarray:
    """A column of lists as rows, short ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _distances(x: np.ndarray, pivots: np.ndarray, extra: np.ndarray | float) -> np.ndarray:
    """Distances to the pivots (their last coordinate is the added one)."""
    x = x.astype(np.float64)
    own = np.einsum("ij,ij->i", x, x) + extra**2
    cross = x @ pivots[:, :-1].T + (np.multiply.outer(extra, pivots[:, -1]) if isinstance(extra, np.ndarray) else 0.0)
    return np.sqrt(np.maximum(own[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * cross, 0))


def _extra(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)), 0))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
          scale: int = 1024, pivots: int = 64, query_block: int = 2048, data_block: int = 16384) -> DataFrame:
    """query_id, rank (int, from 1), ``id_col`` and score (decimal(38,0)) of the k best rows of every query.

    Scores are exact inner products of the quantised vectors, ties go to the smaller id; sums
    beyond a long rank by their true value. Ids are whole numbers; rows without an id or a
    valid vector (see ``quantise``) take no part. Rows with the query's id are its own and no candidates; rows
    that repeat id and vector count once. Vectors of unequal length compare as if the shorter ended
    in zeros. A table without queries or candidates gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), quantise(F.col(vector_col), scale).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    among = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    data = store(rows.select("id", "v", among.alias("n")).where(F.col("n") <= k + 1).dropDuplicates(["v", "id"]).drop("n"), "topk-rows")
    asked = store(rows.where("q").select("id", "v").dropDuplicates(["id", "v"]), "topk-queries")
    schema = f"query_id long, rank int, {id_col} long, score decimal(38,0)"

    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, top, far = data.agg(F.count("id"), F.max(F.size("v")), F.max(norm), F.max(F.array_max(F.transform("v", F.abs)))).first()
    n_asked, far_q, dim_q = asked.agg(F.count("id"), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    if not n or not n_asked:
        return spark.createDataFrame([], schema)
    dim = max(dim, dim_q)
    reach = dim * float(far or 0) * float(far_q or 0)  # below 2^53 products in doubles are exact, below 2^62 those in longs
    chosen = data.orderBy(F.xxhash64("v"), "id").limit(pivots).select("v").collect()
    p = np.zeros((len(chosen), dim))
    for i, r in enumerate(chosen):
        p[i, :len(r.v)] = r.v
    p = np.column_stack([p, _extra(p, top)])

    def cells(extra_top):
        def run(batches):
            for b in batches:
                x = _matrix(b.column(1), dim)
                d = _distances(x, p, 0.0 if extra_top is None else _extra(x, extra_top))
                cell = d.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d[np.arange(len(x)), cell])],
                                                 names=["id", "v", "cell", "d"])
        return run

    in_cells = "id long, v array<long>, cell int, d double"
    data = data.mapInArrow(cells(top), in_cells)
    asked = store(asked.mapInArrow(cells(None), in_cells), "topk-asked")
    # bounded summaries: one line per query cell, k + 1 distances and the radius per data cell
    asked_in = {r.cell: (r.n, r.r) for r in asked.groupBy("cell").agg(F.count("id").alias("n"), F.max("d").alias("r")).collect()}
    nearest = data.select("cell", "d", F.row_number().over(Window.partitionBy("cell").orderBy("d")).alias("i")).where(F.col("i") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in nearest.collect():
        near.setdefault(r.cell, []).append(r.d)

    between = np.sqrt(np.maximum(((p[:, None, :] - p[None, :, :]) ** 2).sum(-1), 0))
    slack = 1e-6 * (1 + math.sqrt(top) + between.max())
    low, high = np.full(between.shape, np.inf), np.full(between.shape, -np.inf)
    for i, (_, radius) in asked_in.items():
        ways = np.sort(np.concatenate([radius + between[i, j] + np.array(d) for j, d in near.items()]))
        theta = ways[k] if len(ways) > k else np.inf  # k + 1 rows lie within it, one may be the query's own
        low[i], high[i] = between[i] - radius - theta - slack, between[i] + radius + theta + slack

    # query cells to groups: neighbouring pivots together, a cell above the block size is split
    groups: list[list[int]] = []
    parts: dict[int, list[int]] = {}
    left, load, at = set(asked_in), 0, next(iter(asked_in))
    while left:
        at = min(left, key=lambda j: (between[at, j], j))
        left.remove(at)
        count = asked_in[at][0]
        if count > query_block:
            parts[at] = list(range(len(groups), len(groups) + math.ceil(count / query_block)))
            groups += [[at] for _ in parts[at]]
            load = query_block
        else:
            if not groups or load + count > query_block:
                groups.append([])
                load = 0
            groups[-1].append(at)
            load += count
            parts[at] = [len(groups) - 1]
    blocks = math.ceil(n / data_block)

    def send(batches):
        for b in batches:
            cell, d = b.column(2).to_numpy(), b.column(3).to_numpy()
            block = (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(blocks)
            for g, own in enumerate(groups):
                need = ((d[:, None] >= low[own][:, cell].T) & (d[:, None] <= high[own][:, cell].T)).any(1)
                if need.any():
                    at = pa.array(np.flatnonzero(need))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(block[need].astype(np.int32)),
                                                      b.column(0).take(at), b.column(1).take(at)], names=["g", "b", "id", "v"])

    def solve(_, mine, theirs):
        q, x = _matrix(mine.column("v"), dim), _matrix(theirs.column("v"), dim)
        if reach < 2**53:
            q, x = q.astype(np.float64), x.astype(np.float64)
        q_ids, ids = mine.column("id").to_numpy(), theirs.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out = [[], [], []]
        for a in range(0, len(q), 64):
            if reach < 2**62:
                scored = ((np.arange(len(x)), s) for s in (q[a:a + 64] @ x.T).astype(np.int64))
            else:  # one more than k: the query's own row may be among them
                scored = (exact_scores(v, x, k + int((ids == q_ids[i]).sum())) for i, v in enumerate(q[a:a + 64], a))
            for i, (rows, s) in enumerate(scored, a):
                other = np.flatnonzero(ids[rows] != q_ids[i])
                rows, s = rows[other], s[other]
                if len(s) > k:
                    bar = np.partition(s, len(s) - k)[len(s) - k]
                    keep = np.concatenate([np.flatnonzero(s > bar), np.flatnonzero(s == bar)])[:k]  # ids rise: ties to the smaller
                else:
                    keep = np.arange(len(s))
                out[0].append(np.full(len(keep), q_ids[i]))
                out[1].append(ids[rows[keep]])
                out[2].append(s[keep])
        scores = pa.array([Decimal(v) for v in (np.concatenate(out[2]).tolist() if out[2] else [])], pa.decimal128(38, 0))
        return pa.table([*(np.concatenate(c) if c else np.empty(0, np.int64) for c in out[:2]), scores], names=["query_id", "vec_id", "score"])

    per_cell = F.lit(None).cast("array<int>")
    for c, own in parts.items():
        per_cell = F.when(F.col("cell") == c, F.array(*map(F.lit, own))).otherwise(per_cell)
    sides = asked.select(F.element_at(per_cell, F.pmod(F.xxhash64("id", "v"), F.size(per_cell)).cast("int") + 1).alias("g"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "id", "v")
    best = (sides.groupBy("g", "b").cogroup(data.mapInArrow(send, "g int, b int, id long, v array<long>").groupBy("g", "b"))
            .applyInArrow(solve, "query_id long, vec_id long, score decimal(38,0)"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return best.select("query_id", rank.alias("rank"), F.col("vec_id").alias(id_col), "score").where(F.col("rank") <= k)
