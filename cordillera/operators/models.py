"""Fits on count and feature tables: principal components, weighted clusters, grouped ridge, bootstraps, linkage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of an array column, in one aggregate: each row adds to width * (width + 1) / 2 sums."""
    width = rows.select(F.size(vector)).first()[0]
    v = F.col(vector)
    products = [(i, j) for i in range(width) for j in range(i, width)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v[i].cast("double")) for i in range(width)]).alias("s"), F.array(*[F.sum(v[i].cast("double") * v[j]) for i, j in products]).alias("p")).first()
    mean = np.array(got["s"]) / got["n"]
    cov = np.zeros((width, width))
    for (i, j), p in zip(products, got["p"]):
        cov[i, j] = cov[j, i] = p / got["n"] - mean[i] * mean[j]
    return got["n"], mean, cov


def principal(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """rows with scores: the first k principal components, each with its largest weight positive. The axes come from one
    aggregate and enter the expressions as literals."""
    _, mean, cov = moments(rows, vector)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)[:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    scores = []
    for c in range(axes.shape[1]):
        weights = F.array(*[F.lit(float(x)) for x in axes[:, c]])
        scores.append(F.aggregate(F.zip_with(F.col(vector), weights, lambda a, b: a.cast("double") * b), F.lit(-float(mean @ axes[:, c])), lambda s, x: s + x))
    return rows.withColumn("scores", F.array(*scores))


def clusters(rows: DataFrame, vector: str, weight: str, k: int, seed: int = 7) -> DataFrame:
    """rows with cluster, by k-means on weighted rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows.withColumn("_v", array_to_vector(vector))
    return KMeans(k=k, seed=seed, featuresCol="_v", weightCol=weight, predictionCol="cluster").fit(ready).transform(ready).drop("_v")


def grouped_ridge(rows: DataFrame, fold: str, features: list[str], target: str, alpha: float) -> DataFrame:
    """rows with predicted: each fold by ridge weights from the others. One aggregate by fold; the rest is a handful of
    numbers, subtracted fold by fold, and comes back as literals."""
    names = [*features, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a).cast("double")).alias(f"s_{a}") for a in names], *[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs]).collect()

    def sums(r):
        gram = np.zeros((len(names), len(names)))
        for a, b in pairs:
            gram[names.index(a), names.index(b)] = gram[names.index(b), names.index(a)] = r[f"p_{a}_{b}"]
        return r["n"], np.array([r[f"s_{a}"] for a in names]), gram

    parts = {r[fold]: sums(r) for r in got}
    guess = F.lit(None).cast("double")
    for k in parts:
        rest = [v for f, v in parts.items() if f != k]
        if not rest:
            continue
        n, s, g = (sum(x) for x in zip(*rest))
        cov = g / n - np.outer(s, s) / n**2
        w = np.linalg.solve(cov[:-1, :-1] + alpha / n * np.eye(len(features)), cov[:-1, -1])
        line = F.lit(float(s[-1] / n - w @ s[:-1] / n))
        for a, x in zip(features, w):
            line = line + F.lit(float(x)) * F.col(a)
        guess = F.when(F.col(fold) == k, line).otherwise(guess)
    return rows.withColumn("predicted", guess)


def r_squared(rows: DataFrame, truth: str, guess: str):
    """1 - residual over total sum of squares, from one aggregate; null for a constant truth."""
    r = rows.agg(F.sum(F.pow(F.col(truth) - F.col(guess), 2)).alias("e"), (F.var_pop(truth) * F.count(truth)).alias("t")).first()
    return 1 - r["e"] / r["t"] if r["t"] else None


def bootstrap_profiles(counts: DataFrame, classes: str, block: str, gene: str, n: str, times: int) -> DataFrame:
    """For each class the median and 5 % quantile, over `times` resamples of blocks, of the correlation between its profile
    and the resampled one. A block's copies in a resample follow a Poisson law with mean 1, read off a hash."""
    base = counts.groupBy(classes, block, gene).agg(F.sum(n).alias("n"))
    u = F.pmod(F.xxhash64(F.col(block), F.col("rep")), F.lit(1_000_000)) / 1e6
    copies = sum((u >= F.lit(c)).cast("int") for c in (0.367879, 0.735759, 0.919699, 0.981012, 0.99634))
    drawn = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("copies", copies)
    sums = drawn.groupBy(classes, "rep", gene).agg(F.sum("n").alias("full"), F.sum(F.col("n") * F.col("copies")).alias("part"))
    m = sums.groupBy(classes, "rep").agg(F.covar_pop("full", "part").alias("c"), (F.var_pop("full") * F.var_pop("part")).alias("v"))
    m = m.withColumn("r", F.when(F.col("v") > 1e-12, F.col("c") / F.sqrt("v")))
    return m.groupBy(classes).agg(F.percentile("r", 0.5).alias("median"), F.percentile("r", 0.05).alias("q05"))


def average_linkage(similarity: np.ndarray, least: float) -> list[int]:
    """Group of each of a few programs: the most alike pair of groups, by mean similarity, joins while it is `least` alike."""
    groups = [[i] for i in range(len(similarity))]
    while len(groups) > 1:
        means = [(np.mean(similarity[np.ix_(a, b)]), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best, i, j = max(means)
        if best < least:
            break
        groups[-i] += groups.pop(-j)
    found = [0] * len(similarity)
    for g, members in enumerate(sorted(groups, key=min)):
        for m in members:
            found[m] = g
    return found


def pca_query(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    s = principal(e, "v", 3)
    return s.select("vec_id", *[F.round(F.col("scores")[i], 5).alias(f"pc{i + 1}") for i in range(3)])


def clusters_query(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.lit(1.0) + F.col("label")).alias("w"))
    return clusters(e, "v", "w", 6).select("vec_id", "cluster")


def grouped_ridge_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("fold", F.col("l_orderkey") % 5)
    done = grouped_ridge(rows, "fold", ["l_quantity"], "l_extendedprice", 0.0)
    return done.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted"), 3).alias("mean"), F.round(F.sqrt(F.avg(F.pow(F.col("l_extendedprice") - F.col("predicted"), 2))), 3).alias("rmse"))


GROUPED_RIDGE_SQL = """with l as (select l_orderkey % 5 as fold, l_quantity as x, l_extendedprice as y from lineitem), f as (select distinct fold from l),
w as (select f.fold, covar_pop(x, y) / var_pop(x) as b, avg(y) - avg(x) * covar_pop(x, y) / var_pop(x) as a from f join l on l.fold <> f.fold group by f.fold)
select l.fold, count(*) as n, round(avg(a + b * x), 3) as mean, round(sqrt(avg(pow(y - a - b * x, 2))), 3) as rmse from l join w on l.fold = w.fold group by l.fold"""


def bootstrap_query(spark, sf_dir: str) -> DataFrame:
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    counts = counts.select((F.col("l_suppkey") % 5).alias("cls"), (F.col("l_suppkey") % 50).alias("block"), F.col("p_brand").alias("gene"), F.col("l_quantity").alias("n"))
    return bootstrap_profiles(counts, "cls", "block", "gene", "n", 20)
