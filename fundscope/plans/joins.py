"""Join and numbering plans that stay safe at scale.

``lookup_join``  attaches a dimension to a fact table. Spark broadcasts the dimension if its size is
below the session's threshold, statically or when the shuffle shows it, and otherwise shuffles both
sides, where the adaptive skew join splits a hot key (one country holding a third of all projects).

``global_row_number``  numbers rows in a global order without moving them all into one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root


def lookup_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "left") -> DataFrame:
    """``facts JOIN dim ON facts[fact_key] = dim[dim_key]`` (left or inner).

    NULL keys never match (plain equality, not null-safe).
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join supports 'left' and 'inner'")
    return facts.join(dim, facts[fact_key] == dim[dim_key], how)


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)`` without a single-partition window.

    Rows are range-partitioned on the order keys and a hash of the row, sorted inside each
    partition, and written once to the shared folder with their partition and place in it. The
    counts per partition (one row each, a tiny broadcast) give each partition's offset. Both uses
    read the same files, so they agree whatever Spark reuses or recomputes. Rows that are equal in
    all columns stay together, in any order.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = cols + [F.col("__h")]
    mid = df.withColumn("__h", F.xxhash64(*[F.col(c) for c in df.columns]))
    mid = mid.repartitionByRange(partitions, *keys) if partitions else mid.repartitionByRange(*keys)
    path = f"{checkpoint_root(df.sparkSession)}/row-number-{uuid.uuid4().hex[:12]}"
    # monotonically_increasing_id: partition index in the upper bits, place in the partition below
    (mid.sortWithinPartitions(*keys).drop("__h").withColumn("__mid", F.monotonically_increasing_id())
     .withColumn("__pid", F.shiftright("__mid", 33)).write.parquet(path))
    stored = df.sparkSession.read.parquet(path)
    local = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = stored.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    return (stored.join(F.broadcast(offsets), "__pid").withColumn(name, F.col("__off") + local + F.lit(1))
            .drop("__pid", "__off", "__mid"))
