"""Incremental ingest: batches of records without those that a table holds already, and windowed digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import shared_dir


def add_new(batch: DataFrame, table: str, key: str, order: str) -> None:
    """Appends to the Parquet table the first row of each key that isn't there; running a batch again adds nothing."""
    spark = batch.sparkSession
    first = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")
    try:
        known = spark.read.parquet(table).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    (first.join(known, key, "left_anti") if known else first).write.mode("append").parquet(table)


def ingest(source: DataFrame, table: str, checkpoint: str, key: str, order: str) -> None:
    """Works off what a stream has now, batch by batch, from where the checkpoint stands."""
    query = source.writeStream.foreachBatch(lambda batch, _: add_new(batch, table, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed(stream: DataFrame, time: str, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Counts and sums for each window of event time; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, ingested twice: the second run adds nothing."""
    base = shared_dir(spark) + f"/ingest-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for run in ("a", "b"):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
        ingest(stream, f"{base}/table", f"{base}/checkpoint-{run}", "event_id", "ts")
    return spark.read.parquet(f"{base}/table").select("event_id", "user_id", "event_type")
