"""Components and masks on edge tables, and small dense solvers for each group."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .joins import hot_keys, salted_join
from .storage import discard, staged


def reached(edges: DataFrame, plain: int = 8) -> DataFrame:
    """edges (a, b) -> (id, label) for every id on an edge: label is the smallest id that it can reach.

    A round takes the smallest label of each id's neighbours. Stars are done in `plain` such rounds; from then on each also
    takes the label of its label, so that long chains halve. Both joins split hubs and common labels. Every round is a
    staged table. No edges: no rows. Self links and repeated edges change nothing.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = staged(edges.where("a is not null and b is not null").select(ways.alias("e")).select("e.a", "e.b").distinct())
    hubs = hot_keys(both, ["b"])
    state, rounds = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label"))), 0
    while True:
        near = salted_join(both, state.select(F.col("id").alias("b"), "label"), ["b"], ["a"], hot=hubs).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step, rounds = state.join(near, "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("was")), rounds + 1
        if rounds > plain:
            step = staged(step)
            jump = state.select(F.col("id").alias("to"), F.col("label").alias("over"))
            step = salted_join(step, jump, ["to"], ["id"]).select("id", F.least("to", "over").alias("to"), "was")
        seen = Observation()
        moved = staged(step.observe(seen, F.max(F.col("to") != F.col("was")).alias("moved")).select("id", F.col("to").alias("label")))
        discard(state)
        state = moved
        if not seen.get["moved"]:
            discard(both)
            return state


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), undirected edges (u, v) -> (id, component): the smallest id in reach."""
    found = reached(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def _ends(x0: str, x1: str, o0: str, o1: str) -> tuple[Column, Column]:
    """Smallest and largest difference of a number from x0 to x1 to one from o0 to o1. Rounding keeps the order of
    differences, squares and sums, so bounds made of them hold for the rounded distances too."""
    return F.greatest(F.col(o0) - F.col(x1), F.col(x0) - F.col(o1), F.lit(0.0)), F.greatest(F.col(o1) - F.col(x0), F.col(x1) - F.col(o0))


def _bounds(a: str, b: str) -> tuple[Column, Column]:
    """Smallest and largest squared distance of a point in box a to one in box b; boxes are columns a_x0, a_x1, a_y0, a_y1."""
    (x, fx), (y, fy) = (_ends(f"{a}_{k}0", f"{a}_{k}1", f"{b}_{k}0", f"{b}_{k}1") for k in "xy")
    return x * x + y * y, fx * fx + fy * fy


def _box() -> list[Column]:
    return [f(k).alias(f"{k}{i}") for k in "xy" for i, f in enumerate((F.min, F.max))]


def _named(table: DataFrame, side: str) -> DataFrame:
    return table.select([F.col(c).alias(f"{side}_{c}") for c in table.columns])


def _links_left(points: DataFrame, pairs: DataFrame, square: float, fine: float) -> DataFrame:
    """points (cell, x, y), pairs of cells (u, v) -> the pairs with a link, by finer boxes, then by the points that they leave."""
    held = points.join(pairs.select(F.col("u").alias("cell")).union(pairs.select("v")).distinct(), "cell", "left_semi")
    held = staged(held.select("cell", "x", "y", F.rint(F.col("x") / fine).alias("sx"), F.rint(F.col("y") / fine).alias("sy")).distinct())
    boxes = staged(held.groupBy("cell", "sx", "sy").agg(*_box()))
    a, b = _named(boxes, "a"), _named(boxes, "b")
    least, most = _bounds("a", "b")
    met = pairs.join(a, F.col("u") == F.col("a_cell")).join(b, F.col("v") == F.col("b_cell")).where(least <= square).withColumn("sure", most <= square)
    met = staged(met.drop("a_cell", "b_cell"))
    sure = met.where("sure").select("u", "v").distinct()
    unsure = met.join(sure, ["u", "v"], "left_anti")

    def close(side: str, cell: str, other: str) -> DataFrame:
        """The points of each pair's box on one side that the other side's box lets come near."""
        own = held.select(F.col("cell").alias(cell), F.col("sx").alias(f"{side}_sx"), F.col("sy").alias(f"{side}_sy"), F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"))
        (x, _), (y, _) = (_ends(f"{side}{k}", f"{side}{k}", f"{other}_{k}0", f"{other}_{k}1") for k in "xy")
        return unsure.join(own, [cell, f"{side}_sx", f"{side}_sy"]).where(x * x + y * y <= square).select("u", "v", "a_sx", "a_sy", "b_sx", "b_sy", f"{side}x", f"{side}y")

    both = close("a", "u", "b").join(close("b", "v", "a"), ["u", "v", "a_sx", "a_sy", "b_sx", "b_sy"])
    x, y = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return sure.union(both.where(x * x + y * y <= square).select("u", "v").distinct())


def near_components(points: DataFrame, square: float) -> DataFrame:
    """points (id, x, y; ids unique) -> (id, component): the smallest id in reach by steps of at most `square`, squared.

    The links themselves, which grow with the square of the density, are never made. Points in one cell of a grid are all
    linked, so cells are what is joined: by their outermost points in eight directions; only pairs of cells that this leaves
    in different components are then decided by finer boxes and by points. Points without finite coordinates stand alone.
    """
    wide = 0.7 * square**0.5  # two points in one cell are at most 0.99 of the radius apart, linked cells at most 2 away
    placed = points.select("id", "x", "y", F.rint(F.col("x") / wide).alias("gx"), F.rint(F.col("y") / wide).alias("gy"))
    finite = placed.where("abs(x) < double('Infinity') and abs(y) < double('Infinity')")
    way = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    outer = [f(F.struct("x", "y"), w) for w in way for f in (F.min_by, F.max_by)]
    cells = staged(finite.groupBy("gx", "gy").agg(F.min("id").alias("cell"), *_box(), F.array_distinct(F.array(*outer)).alias("outer")))
    offsets = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    a = _named(cells, "a").withColumn("o", F.explode(F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(float(j)).alias("y")) for i, j in offsets])))
    b = _named(cells, "b")
    linked = F.exists("a_outer", lambda p: F.exists("b_outer", lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) <= square))
    pairs = a.join(b, (F.col("a_gx") + F.col("o.x") == F.col("b_gx")) & (F.col("a_gy") + F.col("o.y") == F.col("b_gy"))).where("a_cell <> b_cell").where(_bounds("a", "b")[0] <= square)
    pairs = staged(pairs.select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v"), linked.alias("linked")))
    found = reached(pairs.where("linked").select(F.col("u").alias("a"), F.col("v").alias("b")))
    label = cells.select(F.col("cell").alias("id"), "gx", "gy").join(found, "id", "left").select(F.col("id").alias("cell"), "gx", "gy", F.coalesce("label", "id").alias("label"))
    label = staged(label)
    u, v = (label.select(F.col("cell").alias(c), F.col("label").alias(f"{c}_label")) for c in "uv")
    apart = staged(pairs.where("not linked").join(u, "u").join(v, "v").where("u_label <> v_label"))
    if apart.limit(1).count():
        inner = finite.join(label.select("gx", "gy", "cell"), ["gx", "gy"]).select("cell", "x", "y")
        more = _links_left(inner, apart.select("u", "v"), square, wide / 8).join(apart, ["u", "v"])
        top = reached(more.select(F.col("u_label").alias("a"), F.col("v_label").alias("b")))
        label = label.join(top.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left").withColumn("label", F.coalesce("top", "label"))
    label = staged(label.select("gx", "gy", "label"))
    return salted_join(placed, label, ["gx", "gy"], ["id"], "left").select("id", F.coalesce("label", "id").alias("component"))


def nearest(points: DataFrame, radius: float, square: float, k: int, crowd: int = 64) -> DataFrame:
    """points (id, x, y; ids unique) -> (a, b, d): each point's k nearest others within the radius (`square`: squared), ties to
    smaller ids. Grids go from fine to as wide as the radius: whoever has k neighbours within a cell's width is done, so a
    crowd is met in fine cells only. Of points at one place, only the k + 1 smallest ids can be anyone's neighbours.
    """
    points = staged(points.select("id", "x", "y").where("x is not null and y is not null"))
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    near = staged(points.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank"))
    cell = lambda w: [F.floor(F.col(c) / w).alias(f"g{c}") for c in "xy"]
    fine = 0
    while fine < 8 and (near.groupBy(*cell(radius / 4**fine)).count().agg(F.max("count")).first()[0] or 0) > crowd:
        fine += 1
    offsets = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dx, dy, own = F.col("ax") - F.col("x"), F.col("ay") - F.col("y"), Window.partitionBy("a")
    todo, found = points, []
    for w in [radius / 4**i for i in range(fine, -1, -1)]:
        probe = todo.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *cell(w), F.explode(offsets).alias("o"))
        probe = probe.select("a", "ax", "ay", (F.col("gx") + F.col("o.x")).alias("gx"), (F.col("gy") + F.col("o.y")).alias("gy"))
        met = probe.join(near.select(F.col("id").alias("b"), "x", "y", *cell(w)), ["gx", "gy"]).where((F.col("a") != F.col("b")) & (dx * dx + dy * dy <= square))
        met = met.select("a", "b", F.sqrt(dx * dx + dy * dy).alias("d"))
        if w < radius:  # nobody outside the nine cells is as near; the rest is for rounding
            met = met.where(F.col("d") <= 0.999 * w)
        met = met.withColumn("rn", F.row_number().over(own.orderBy("d", "b"))).where(F.col("rn") <= k)
        if w < radius:
            met = met.withColumn("n", F.count(F.lit(1)).over(own)).where(F.col("n") == k)
        found.append(staged(met.select("a", "b", "d")))
        if w < radius:
            todo = staged(todo.join(found[-1].select(F.col("a").alias("id")).distinct(), "id", "left_anti"))
    return reduce(DataFrame.union, found)


def front(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """nodes (id, core boolean): the core's boundary and what is one step from it, where the core's component has `least`
    members. id, part: core, front or peri."""
    core = nodes.where("core").select("id")
    inner = edges.join(core.withColumnRenamed("id", "u"), "u", "left_semi").join(core.withColumnRenamed("id", "v"), "v", "left_semi")
    found = components(core, inner)
    large = found.join(found.groupBy("component").count().where(F.col("count") >= least), "component").select("id")
    both = edges.select("u", "v").union(edges.select("v", "u"))
    outside = nodes.select("id").join(large, "id", "left_anti").withColumnRenamed("id", "v")
    edge = both.join(large.withColumnRenamed("id", "u"), "u", "left_semi").join(outside, "v", "left_semi")
    ring = edge.select(F.col("u").alias("id")).union(edge.select("v")).distinct().withColumn("ring", F.lit(True))
    return nodes.select("id").join(large.withColumn("large", F.lit(True)), "id", "left").join(ring, "id", "left").select("id", F.when(F.col("ring"), "front").when(F.col("large"), "core").otherwise("peri").alias("part"))


def null_space_center(links: DataFrame) -> DataFrame:
    """links (component, spot, cell, weight, value): each component's values less their part that the spot sums see."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        cells, col = np.unique(g["cell"], return_inverse=True)
        spots, row = np.unique(g["spot"], return_inverse=True)
        a = np.zeros((len(spots), len(cells)))
        np.add.at(a, (row, col), g["weight"].to_numpy())
        x = np.zeros(len(cells))
        x[col] = g["value"].to_numpy()
        _, s, vt = np.linalg.svd(a, full_matrices=False)
        basis = vt[s > 1e-9 * max(s.max(initial=0), 1)]
        return pd.DataFrame({"component": g["component"].iloc[0], "cell": cells, "value": x - basis.T @ (basis @ x)})

    return links.groupBy("component").applyInPandas(run, "component long, cell long, value double")


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float) -> dict[str, float]:
    """Ridge weights with a free intercept, from one pass of sums over rows: a Gram matrix of len(features) + 1."""
    names = [*features, target]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s_{a}") for a in names], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    n = sums["n"]
    mean = np.array([sums[f"s_{a}"] / n for a in names])
    gram = np.array([[sums[f"p_{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"] for b in names] for a in names]) / n - np.outer(mean, mean)
    w = np.linalg.solve(gram[:-1, :-1] + alpha / n * np.eye(len(features)), gram[:-1, -1])
    return dict(zip(features, w.tolist())) | {"intercept": float(mean[-1] - w @ mean[:-1])}


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    g = e.withColumn("gx", F.floor(F.col("x") / 0.05)).withColumn("gy", F.floor(F.col("y") / 0.05))
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    probe = g.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), "gx", "gy", F.explode(offsets).alias("o")).select("u", "ux", "uy", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
    near = probe.join(g.select(F.col("id").alias("v"), "x", "y", "gx", "gy"), ["gx", "gy"])
    return e, near.where("u < v and (ux - x) * (ux - x) + (uy - y) * (uy - y) <= 0.0025").select("u", "v")


def components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    return near_components(cells, 0.0025)


def front_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, edges = _cells(spark, sf_dir)
    return front(cells.withColumn("core", F.col("label") < 5), edges, 3)


def null_space_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    links = cells.select(F.col("label").cast("long").alias("component"), (F.col("id") % 7).alias("spot"), F.col("id").alias("cell"), F.lit(1.0).alias("weight"), F.col("x").alias("value"))
    return null_space_center(links)


def ridge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ridge(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1.0)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in sorted(w.items())], "feature string, weight double")
