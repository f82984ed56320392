"""Checked loads: every line of the raw files ends up in the table or in a quarantine, and the load's own
pass counts what it wrote.

``load_checked`` writes one Parquet folder in one pass, partitioned by ``rejected``: lines with the declared
number of fields become rows of the table; the others (a separator inside a text, a cut line) are kept
as they are, with their file. An ``Observation`` on that write collects the counts (rows, rejects, NULL keys,
unreadable numbers, unparseable dates), so no second scan is needed; what a failed task had
counted is not added.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .delimited import LINE_SEP, NULL, header_of, read_lines, split_lines


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    rejected: DataFrame
    counts: Mapping[str, int]


def checked_lines(lines: DataFrame, schema: T.StructType, sep: str = ",", null_value: str = NULL) -> DataFrame:
    """Lines (see ``read_lines``) with the declared columns, ``field_count`` and ``rejected``."""
    parts = F.split("line", "\\Q" + sep + "\\E", -1)
    counted = lines.withColumn("field_count", F.size(parts))
    return counted.select("line", "file", "field_count", (F.col("field_count") != len(schema.fields)).alias("rejected"),
                          *split_lines(F.col("line"), schema, sep, null_value))


def load_metrics(schema: T.StructType, key: str | None = "ID", timestamps: tuple[str, ...] = (), dates: tuple[str, ...] = (),
                 sep: str = ",", null_value: str = NULL) -> list[Column]:
    """Aggregates over ``checked_lines``: row_count, rejected_count, null_keys, bad_numbers, bad_dates. Values that do not
    read are counted in accepted lines only."""
    parts = F.split("line", "\\Q" + sep + "\\E", -1)
    text = {f.name: F.nullif(F.get(parts, F.lit(i)), F.lit(null_value)) for i, f in enumerate(schema.fields)}
    ok = ~F.col("rejected")
    total = lambda tests: sum((F.count(F.when(ok & t, 1)) for t in tests), F.lit(0).cast("long"))
    numbers = [text[f.name].isNotNull() & F.col(f.name).isNull() for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    parsed = [text[c].isNotNull() & C.parse_day_first_timestamp(text[c]).isNull() for c in timestamps]
    parsed += [text[c].isNotNull() & C.parse_day_first_date(text[c]).isNull() for c in dates]
    return [F.count(F.when(ok, 1)).alias("row_count"), F.count(F.when(~ok, 1)).alias("rejected_count"),
            total([F.col(key).isNull()] if key else []).alias("null_keys"), total(numbers).alias("bad_numbers"),
            total(parsed).alias("bad_dates")]


def load_checked(spark: SparkSession, path: str | list[str], schema: T.StructType, target: str, key: str | None = "ID",
                 timestamps: tuple[str, ...] = (), dates: tuple[str, ...] = (), sep: str = ",", header: bool = True,
                 null_value: str = NULL, line_sep: str = LINE_SEP) -> Loaded:
    """Load the files into ``target`` in one pass; see the module. Empty lines are rejected ones."""
    lines = read_lines(spark.read, path, header_of(spark, path, line_sep) if header else None, line_sep)
    seen = Observation()
    out = checked_lines(lines, schema, sep, null_value).observe(seen, *load_metrics(schema, key, timestamps, dates, sep, null_value))
    columns = [f.name for f in schema.fields]
    bad = F.col("rejected")
    # a rejected line keeps its text, an accepted one its fields
    out = out.select(*[F.when(~bad, F.col(c)).alias(c) for c in columns], *[F.when(bad, F.col(c)).alias(f"_{c}") for c in ("line", "field_count", "file")], "rejected")
    out.write.mode("overwrite").partitionBy("rejected").parquet(target)
    back = spark.read.schema(out.schema).parquet(target)
    rejected = back.where("rejected").select(F.col("_line").alias("line"), F.col("_field_count").alias("field_count"), F.col("_file").alias("file"))
    return Loaded(back.where("not rejected").select(*columns), rejected, dict(seen.get))


def load_counts(spark: SparkSession, loads: Mapping[str, Loaded]) -> DataFrame:
    """One row per load: ``table_name`` and its counts (taken while loading; nothing is read again)."""
    names = ["row_count", "rejected_count", "null_keys", "bad_numbers", "bad_dates"]
    rows = [(name, *(int(x.counts[n]) for n in names)) for name, x in loads.items()]
    return spark.createDataFrame(rows, "table_name string, " + ", ".join(f"{n} long" for n in names))
