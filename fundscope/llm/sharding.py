"""Sharding by weighted rendezvous hashing.

Every (row key, shard) pair has a score that depends on nothing else: the first 52 bits of
``md5(seed:shard:key)`` as a uniform number u in (0, 1), turned into ``-ln(u) / weight``. A row
goes to the shard with the smallest score, so shards get rows in proportion to their weights; a
new shard only takes rows into itself, and a removed one only gives up its own.

Scoring is a narrow projection: no shuffle, no state, any number of rows per key. Rows with the
same key meet in the same shard (that is the law); numbering them does not need one task per
shard, see :func:`number_slots`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 2 ** 52, the number of values of the 13 hex digits taken from the digest.
UNIT = 4503599627370496.0


def _key(cols: Sequence[str]) -> Column:
    """Key columns as text; null and empty text differ, a null key is a key like any other."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.concat_ws("\u0001", *parts)


def score(key: Column, shard: int, weight: float, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:{shard}:"), key))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(UNIT)
    return -F.log(u) / F.lit(float(weight))


def assign_shards(df: DataFrame, key_cols: Sequence[str], shards: int | Mapping[int, float],
                  seed: str = "rendezvous", shard_col: str = "shard") -> DataFrame:
    """Add ``shard_col`` (int, replaces a column of that name). ``shards``: a count (0 to n-1, equal
    weights) or id -> weight; a weight of 0 or less takes nothing.

    Null keys hash like a value of their own, equal keys always share a shard, ties of the score go
    to the smaller id, an empty table stays empty, all other columns are passed on untouched.
    """
    weights = dict(enumerate([1.0] * shards)) if isinstance(shards, int) else dict(shards)
    live = sorted((s, w) for s, w in weights.items() if w > 0)
    if not live:
        raise ValueError("no shard with a positive weight")
    key = _key(key_cols)
    best = F.least(*[F.struct(score(key, s, w, seed).alias("v"), F.lit(s).alias("s")) for s, w in live]) \
        if len(live) > 1 else F.struct(F.lit(0.0).alias("v"), F.lit(live[0][0]).alias("s"))
    return df.withColumn(shard_col, best["s"].cast("int"))


def number_slots(df: DataFrame, order_cols: Sequence[str], shard_col: str = "shard",
                 slot_col: str = "slot", digits: int = 2) -> DataFrame:
    """Add ``slot_col`` (long): 0, 1, 2, ... without gaps in each shard.

    A shard is cut into ``16 ** digits`` pieces by the leading hex digits of a row's md5, so a shard (or a table with one
    shard) is numbered by many tasks: counts per piece are pre-aggregated, their running sums give
    each piece its first slot, and a row number inside the piece does the rest. Order inside a
    piece is by ``order_cols``; rows equal in them are interchangeable. The table of first slots
    has at most shards x pieces rows, which bounds its broadcast.
    """
    names = set(df.columns)
    piece, start, cell = (_fresh(names, n) for n in ("piece", "start", "cell"))
    own = df.withColumn(piece, F.substring(F.md5(_key(order_cols)), 1, digits))
    counts = own.groupBy(shard_col, piece).agg(F.count(F.lit(1)).alias(start))
    before = Window.partitionBy(shard_col).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard_col).alias(cell), F.col(piece).alias(f"{piece}_"),
                          F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(shard_col, piece).orderBy(*order_cols)
    return (own.join(F.broadcast(first), (F.col(shard_col) == F.col(cell)) & (F.col(piece) == F.col(f"{piece}_")))
            .withColumn(slot_col, F.col(start) + F.row_number().over(inside) - 1)
            .drop(piece, f"{piece}_", start, cell))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder per shard; AQE splits a large shard over several files."""
    df.hint("rebalance", shard_col).write.partitionBy(shard_col).parquet(path)


def _fresh(names: set[str], base: str) -> str:
    out = f"__{base}"
    while out in names or f"{out}_" in names:
        out += "_"
    return out
