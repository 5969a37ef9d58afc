"""Line-delimited JSON: scans that tolerate bad lines, polymorphic readers, append and overwrite sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, schema: StructType, objects_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, errors): errors have the file, the place in it (rising with the lines), and the line's text cut to 200
    characters. Blank lines are skipped; with objects_only, JSON that is no object is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place")).where(F.trim("value") != "")
    parsed = lines.select("value", "file", "place", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("value").isNotNull().alias("json"), F.substring(F.ltrim("value"), 1, 1).alias("first"))
    good = F.col("json") & ((F.col("first") == "{") | F.lit(not objects_only))
    return parsed.where(good).select("r.*"), parsed.where(~good).select("file", "place", F.substring("value", 1, 200).alias("preview"), F.when(F.col("json"), "not an object").otherwise("invalid JSON").alias("error"))


def audit(records: DataFrame, errors: DataFrame, examples: int = 5) -> DataFrame:
    """One row: good, bad, and the first bad lines by file and place; only these reach one task."""
    few = errors.orderBy("file", "place").limit(examples).agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "place", "preview"))), lambda e: e["preview"]).alias("examples"))
    return records.agg(F.count(F.lit(1)).alias("good")).crossJoin(errors.agg(F.count(F.lit(1)).alias("bad"))).crossJoin(few)


def silent(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records alone; malformed lines are dropped by the reader."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def reference_table(spark: SparkSession, path: str, key: str, fields: tuple[str, ...] = ("records", "journals")) -> DataFrame:
    """A JSON array, an object that holds one under `fields`, or JSON lines; of a repeated key the last row counts."""
    start = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).head()
    raw = spark.read.option("multiLine", True).json(path)
    held = [c for c in fields if c in raw.columns]
    array = start is not None and start[0] == "["
    rows = raw.select(F.inline(F.coalesce(*held))) if held else raw if array else spark.read.json(path)
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    return placed.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), "_at").alias("r")).select("r.*")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces what is at path: written beside it first, so a write that fails leaves the old files, then renamed."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside, old, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", f"{path}.old", path))
    df.write.mode("overwrite").json(f"{path}.new")
    fs = target.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(beside, target):
        fs.rename(old, target)
        raise OSError(f"{path} was not replaced")
    fs.delete(old, True)


def seed(df: DataFrame, path: str, refresh: bool = False) -> None:
    """Writes unless something is there already, or refresh is set."""
    df.write.mode("overwrite" if refresh else "ignore").parquet(path)
