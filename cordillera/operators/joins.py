"""Joins to a table with one row a key, where a few keys hold many of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

#: Rows of one key that stay together, and keys of which the shares are told by a broadcast table.
TOGETHER, HOT = 1000, 4096


def hot_keys(table: DataFrame, on: list[str]) -> DataFrame | None:
    """(on, _shares) of the keys with more than TOGETHER rows, at most the HOT most frequent: a key that isn't among them
    has less than 1/HOT of all rows. None where there is no such key. Counts combine before their shuffle."""
    counts = table.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TOGETHER).na.drop(subset=on)
    rows = counts.orderBy(F.desc("_n"), *on).limit(HOT).select(*on, F.ceil(F.col("_n") / TOGETHER).cast("int").alias("_shares"))
    return staged(rows) if rows.limit(1).count() else None


def share_of(by: list[str], shares: Column) -> Column:
    """The share of a hot key that a row falls to, by a hash of the columns in `by`."""
    return F.pmod(F.xxhash64(*by), shares).cast("int")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", hot: DataFrame | None | bool = True) -> DataFrame:
    """left joined to right, of which each key has one row. Rows of a hot key are split into shares by the columns in `by`
    (which should tell them apart), and the key's row of right goes to each share. hot: the result of `hot_keys`, if known;
    else left is read twice, and should be a staged table."""
    if hot is True:
        hot = hot_keys(left, on)
    if hot is None:
        return left.join(right, on, how)
    spread = left.join(F.broadcast(hot), on, "left").withColumn("_share", F.coalesce(share_of(by, F.col("_shares")), F.lit(0))).drop("_shares")
    copies = right.join(F.broadcast(hot), on, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return spread.join(copies, [*on, "_share"], how).drop("_share")
