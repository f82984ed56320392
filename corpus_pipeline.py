"""Corpus pipeline: documents to a clean, mixed and sharded training corpus.

Each stage works on all rows its predecessor kept and passes on the columns of ``documents``, extra
ones too; the last adds ``shard`` and ``slot`` (replacing columns of these names). Rows leave in three places: texts that the toxicity model rejects
(0.5 or more), all but one text of each group of near-duplicates (five-word shingles, similarity 0.8
or more), and texts in which a benchmark window of ten words occurs. Mixing repeats or leaves out
rows to meet the source weights; a row taken n times is n rows, which may lie in any file but share
a shard. Null texts are kept by the filters. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundscope.llm import decontaminate, minhash, mixing, sharding, toxicity
from fundscope.llm.common import store, table

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, ["doc_id"], weights=(1, 2, 3), max_epochs=3)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # numbered by id and text, so that rows of one repeated or null id are spread over the pieces of their shard
    return sharding.number_slots(sharding.assign_shards(docs, ["doc_id"], SHARDS), ["doc_id", "text"])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", put_into_shards)]

#: The trained toxicity model has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each stage's rows written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
