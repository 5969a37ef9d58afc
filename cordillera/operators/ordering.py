"""A gapless global position without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bucket(key: str, bounds: list):
    """Twice the number of bounds below the key, one more where it equals a bound: equal frequent keys have their own bucket."""
    if not bounds:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds))
    return F.size(F.filter(held, lambda b: b < F.col(key))) * 2 + F.array_contains(held, F.col(key)).cast("int")


def numbered(df: DataFrame, key: str, tie: str, buckets: int = 256) -> DataFrame:
    """df with idx, from 0, in the order of key, then tie (numbers without nulls; (key, tie) unique for a fixed order).

    Quantiles of both (at most `buckets` numbers each) cut the rows into buckets in order; a bucket of one frequent key is
    cut by tie as well, so no key's rows meet in one task. Counts of buckets, one row for each, give where each begins.
    """
    share = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(key, share, 10000).alias("k"), F.percentile_approx(tie, share, 10000).alias("t")).first()
    keys, ties = sorted(set(bounds["k"] or [])), sorted(set(bounds["t"] or []))
    cut = df.withColumn("_b", _bucket(key, keys)).withColumn("_t", F.when(F.col("_b") % 2 == 1, _bucket(tie, ties)).otherwise(F.lit(0)))
    starts = cut.groupBy("_b", "_t").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_b", "_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_b", "_t").orderBy(key, tie))
    return cut.withColumn("_rn", inner).join(starts, ["_b", "_t"]).withColumn("idx", F.col("_at") + F.col("_rn") - 1).drop("_b", "_t", "_rn", "_at")


def index_query(spark, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return numbered(c, "c_nationkey", "c_custkey").select("c_custkey", "idx", (F.col("c_nationkey") % 4).alias("shard"))


INDEX_SQL = "select c_custkey, row_number() over (order by c_nationkey, c_custkey) - 1 as idx, c_nationkey % 4 as shard from customer"
