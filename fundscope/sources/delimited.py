"""Delimited-file load, as the raw files are shipped: ``,`` separated, CRLF rows,
one header line, and NO quoting.

Without quoting a field such as ``"N,0`` splits into two fields (``"N`` and
``0``); that is how the corrupt country value arises, and the cleaning step
relies on seeing it. Extra trailing fields are dropped, missing ones are NULL
(``sources.loads`` keeps such lines apart instead). A row ends at CRLF and nowhere
else: a lone line feed or carriage return is part of a text.
The schema is always declared, never inferred, so dates arrive as text. An empty
text field is an empty text; only the null marker is NULL. A number that can't be
read is NULL, and ``unreadable_numbers`` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

NULL = "\\N"
LINE_SEP = "\r\n"
#: A separator and a quote that no text holds: a whole line is one field of Spark's CSV writer, which
#: writes the header line of each file.
_LINE = {"sep": "\u0001", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\u0003"}


def read_lines(reader, path: str | list[str], header: str | None, line_sep: str = LINE_SEP) -> DataFrame:
    """The lines of text files (``spark.read`` or ``spark.readStream``) as ``line`` with their ``file`` and
    ``block`` (where the split starts). ``header``: the header line, left out where a file starts with it
    (its first split only, so files stay splittable)."""
    lines = reader.option("lineSep", line_sep).text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines if header is None else lines.where((F.col("block") > 0) | (F.col("line") != F.lit(header)))


def header_of(spark: SparkSession, path: str | list[str], line_sep: str = LINE_SEP) -> str | None:
    """The first line of one of the files (all have the same header), None without any."""
    first = read_lines(spark.read, path, None, line_sep).where("block = 0").head()
    return first.line if first else None


def split_lines(line: Column, schema: T.StructType, sep: str = ",", null_value: str = NULL) -> list[Column]:
    """The fields of an unquoted line, with the declared names and types."""
    parts = F.split(line, "\\Q" + sep + "\\E", -1)
    return [F.nullif(F.get(parts, F.lit(i)), F.lit(null_value)).try_cast(f.dataType).alias(f.name)
            for i, f in enumerate(schema.fields)]


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",",
                   header: bool = True, null_value: str = NULL, quoting: bool = False, line_sep: str = LINE_SEP) -> DataFrame:
    """Read delimited text files with a declared schema. Empty lines are no rows.

    ``quoting=False`` (the default): no character but the separator and the line end means anything.
    Files are split across tasks by Spark (no multi-line records, so every file is splittable).
    """
    if quoting:
        return (spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
                .option("nullValue", null_value).option("enforceSchema", True).csv(path))
    lines = read_lines(spark.read, path, header_of(spark, path, line_sep) if header else None, line_sep)
    return lines.where("line <> ''").select(*split_lines(F.col("line"), schema, sep, null_value))


def unreadable_numbers(spark: SparkSession, path: str | list[str], schema: T.StructType, **kw) -> DataFrame:
    """One row: for each numeric column, how many of its texts are no number (``bad_<column>``)."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = read_delimited(spark, path, as_text, **kw)
    numeric = [f for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    return raw.agg(*[F.count(F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), 1)).alias(f"bad_{f.name}")
                     for f in numeric])


def read_project_info(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.PROJECT_INFO_RAW,
                      **kw) -> DataFrame:
    return read_delimited(spark, path, schema, **kw)


def read_pledge(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.PLEDGE_RAW,
                **kw) -> DataFrame:
    return read_delimited(spark, path, schema, **kw)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True,
                    mode: str = "overwrite") -> None:
    """Write in the same raw layout (CRLF rows, no quoting), in parallel, one file per task. Like the
    raw files, it can't show a separator or a line end inside a text."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in df.columns])
    (df.select(line.alias(sep.join(df.columns))).write.mode(mode)
     .options(**_LINE | {"header": header, "quote": "\u0002", "emptyValue": ""}).option("lineSep", LINE_SEP).csv(path))
