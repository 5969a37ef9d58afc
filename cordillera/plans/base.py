"""Named SQL plans over the test tables, each with the text that another engine runs for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    """Views of the named tables; a plan is analysed at once, so later views of the same name don't touch it."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, used: str, text: str, other: str | None = None) -> None:
        """A plan in Spark SQL over the tables in `used`; other: its text elsewhere, if it differs."""
        names = tuple(used.split())

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables(spark, sf_dir, names)
            return spark.sql(text)

        self.queries[name] = run
        self.oracle[name] = other or text

    def frame(self, name: str, run: Callable[[SparkSession, str], DataFrame], other: str | None = None) -> None:
        self.queries[name] = run
        if other:
            self.oracle[name] = other
