"""Declared schemas of the three tables.

The raw files are read with these schemas (never inferred): dates arrive as
text and the corrupt country value must survive the read.
"""

from pyspark.sql import types as T

# project_info as loaded from the delimited file: dates still text.
PROJECT_INFO_RAW = T.StructType([
    T.StructField("ID", T.LongType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("main_category", T.StringType(), True),
    T.StructField("deadline", T.StringType(), True),
    T.StructField("launched", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
])

# pledge as loaded from the delimited file. Money is a decimal from the read on, so sums and
# means are exact (see functions.columns).
PLEDGE_RAW = T.StructType([
    T.StructField("ID", T.LongType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("usd_goal_real", T.DecimalType(18, 4), True),
    T.StructField("usd_pledged_real", T.DecimalType(18, 4), True),
])

# country lookup: code -> display name. ``code`` is the join column, not the key.
COUNTRY = T.StructType([
    T.StructField("countrycode", T.StringType(), False),
    T.StructField("countryname", T.StringType(), False),
    T.StructField("code", T.StringType(), True),
])

#: The collation of the usual SQL servers: texts that differ in case only are equal.
IGNORE_CASE = "UTF8_LCASE"


def ignoring_case(schema: T.StructType, columns: tuple[str, ...] | None = None) -> T.StructType:
    """The schema with ``columns`` (default: all texts) as ``STRING COLLATE UTF8_LCASE``. Tables read with it
    join, group, rank and filter on these columns without case, through every operator."""
    return T.StructType([
        T.StructField(f.name, T.StringType(IGNORE_CASE), f.nullable)
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns) else f
        for f in schema.fields])
