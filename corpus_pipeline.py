"""A corpus from raw documents to packed sequences: each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordillera.llm import mixing, neardup, packing, secrets, toxicity
from cordillera.llm._common import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity scores 0.5 or more go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 or more the one with the smallest id stays.

    Each row is judged by its own text, also where rows repeat an id; of rows that repeat an id without a word one stays.
    A row without an id is linked to none and stays."""
    keyed = staged(docs.withColumn("_row", F.monotonically_increasing_id()))
    rows = keyed.where("doc_id is not null").select(F.col("_row").alias("doc_id"), "text")
    ids = keyed.where("doc_id is not null").select("_row", F.struct("doc_id", F.xxhash64("text").alias("h"), "_row").alias("first"))
    found = neardup.near_duplicates(rows, percent=80).withColumnRenamed("doc_id", "_row").join(ids, "_row")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id")), F.when(F.col("n_shingles") == 0, F.col("first.doc_id"))
    kept = found.groupBy(group[0].alias("linked"), group[1].alias("bare")).agg(F.min("first")["_row"].alias("_row")).select("_row")
    stay = keyed.join(kept, "_row", "left_semi").select(*docs.columns)
    return stay.union(keyed.where("doc_id is null").select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; all documents stay."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a CRC in the ids' stead."""
    import public_tokenizers as P

    return packing.digest(packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Learned scores, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
