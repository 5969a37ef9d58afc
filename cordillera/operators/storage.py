"""Tables written to the folder that driver and executors share, and the shuffle files they were made from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's own. Only a local master (tests) gets a folder made for it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cordillera-"))
        found = sc.getCheckpointDir()
    return found


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there, so lost executors cost nothing. Shuffle
    files of the write go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path, was = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)  # the selection is planned under the setting
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    sc = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("staged-"):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
