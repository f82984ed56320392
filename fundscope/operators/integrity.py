"""Key checks. Spark file tables do not enforce keys, so the declarations become queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: ``table_name``, ``row_count``."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _cols(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def check_primary_key(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Key values that break a primary key: duplicated, or with a NULL part; with ``row_count``."""
    keys = _cols(cols)
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"),
                                    F.max(any_null.cast("int")).alias("__null"))
    return counted.where((F.col("row_count") > 1) | (F.col("__null") == 1)).drop("__null")


def check_foreign_key(child: DataFrame, parent: DataFrame, cols: str | Sequence[str],
                      parent_cols: str | Sequence[str] | None = None, colocated: bool = False) -> DataFrame:
    """Child rows whose non-NULL key has no parent row (a NULL key is allowed).

    ``colocated``: both tables are stored in buckets of the key, so a merge join shuffles neither
    side at any size. Otherwise Spark broadcasts the keys below its size threshold and shuffles
    above it, where the adaptive skew join splits a hot key.
    """
    keys = _cols(cols)
    pkeys = _cols(parent_cols) if parent_cols else keys
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    p = parent.select(*[F.col(pk).alias(k) for pk, k in zip(pkeys, keys)])
    return child.where(present).join(p.hint("merge") if colocated else p, keys, "left_anti")


def cascade_delete(child: DataFrame, removed_parent: DataFrame, cols: str | Sequence[str],
                   colocated: bool = False) -> DataFrame:
    """Child rows left after the parents in ``removed_parent`` are deleted with ON DELETE CASCADE.

    Rows with a NULL key reference no parent and stay. ``colocated``: see ``check_foreign_key``.
    """
    keys = _cols(cols)
    p = removed_parent.select(*keys)
    return child.join(p.hint("merge") if colocated else p, keys, "left_anti")
