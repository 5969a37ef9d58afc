"""Areas that shapes share, and the overlap joins on them: candidates by grid cells, exact areas in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def clip(polygon: np.ndarray, normal: tuple[float, float], bound: float) -> np.ndarray:
    """The part of a polygon (n x 2) where normal . p <= bound; possibly empty."""
    if not len(polygon):
        return polygon
    side = polygon @ np.asarray(normal) - bound
    following, ahead = np.roll(polygon, -1, 0), np.roll(side, -1)
    cut = (side <= 0) != (ahead <= 0)
    t = np.where(cut, side / np.where(cut, side - ahead, 1), 0)[:, None]
    points = np.stack([polygon, polygon + t * (following - polygon)], 1).reshape(-1, 2)
    return points[np.stack([side <= 0, cut], 1).ravel()]


def clip_box(polygon: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    for normal, bound in (((1, 0), x1), ((-1, 0), -x0), ((0, 1), y1), ((0, -1), -y0)):
        polygon = clip(polygon, normal, bound)
    return polygon


def disc_area(polygon: np.ndarray, centre: tuple[float, float], radius: float) -> float:
    """Area shared by a polygon and a disc: along each edge, triangles with the centre inside the disc and sectors outside."""
    p = polygon - np.asarray(centre, float)
    v = np.roll(p, -1, 0) - p
    vv, pv = (v * v).sum(1), (p * v).sum(1)
    root = np.sqrt(np.maximum(pv * pv - vv * ((p * p).sum(1) - radius**2), 0))
    safe = np.where(vv > 0, vv, 1)
    t0, t1 = np.clip((-pv - root) / safe, 0, 1), np.clip((-pv + root) / safe, 0, 1)
    a, b, q = p + t0[:, None] * v, p + t1[:, None] * v, p + v

    def cross(u, w):
        return u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0]

    def turn(u, w):
        return np.arctan2(cross(u, w), (u * w).sum(1))

    return abs(float((cross(a, b) + radius**2 * (turn(p, a) + turn(b, q))).sum()) / 2)


def voronoi_cell(point: np.ndarray, others: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of the box nearer to point than to any of the others."""
    x0, y0, x1, y1 = box
    cell = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
    for o in others:
        d = o - point
        cell = clip(cell, tuple(2 * d), float(o @ o - point @ point))
    return cell


def overlap_grid(shapes: DataFrame, size: float) -> DataFrame:
    """shapes (id, xs, ys arrays) -> (id, ix, iy, area): the area a shape has in each grid square. A shape's own squares are
    generated from its box, so there is no join, and nothing wider than one shape is held."""

    def span(c: str):
        return F.explode(F.sequence(F.floor(F.array_min(c) / size), F.floor(F.array_max(c) / size)))

    squares = shapes.where(F.size("xs") >= 3).withColumn("ix", span("xs")).withColumn("iy", span("ys"))

    def run(batches):
        for b in batches:
            held = [abs(area(c)) if len(c := clip_box(np.column_stack([x, y]).astype(float), i * size, j * size, (i + 1) * size, (j + 1) * size)) else 0.0 for x, y, i, j in zip(b["xs"], b["ys"], b["ix"], b["iy"])]
            yield pd.DataFrame({"id": b["id"], "ix": b["ix"], "iy": b["iy"], "area": held})

    return squares.select("id", "xs", "ys", "ix", "iy").mapInPandas(run, "id long, ix long, iy long, area double").where("area > 0")


def overlap_discs(shapes: DataFrame, discs: DataFrame, radius: float) -> DataFrame:
    """shapes (id, xs, ys) and discs (disc, x, y) of one radius -> (id, disc, area) where they meet. Candidates share a
    square of 2 * radius: shapes hold all squares of their box widened by the radius, a disc the one of its centre."""
    side = 2 * radius

    def span(c: str):
        return F.explode(F.sequence(F.floor((F.array_min(c) - radius) / side), F.floor((F.array_max(c) + radius) / side)))

    left = shapes.where(F.size("xs") >= 3).withColumn("ix", span("xs")).withColumn("iy", span("ys"))
    right = discs.withColumn("ix", F.floor(F.col("x") / side)).withColumn("iy", F.floor(F.col("y") / side))

    def run(batches):
        for b in batches:
            held = [disc_area(np.column_stack([xs, ys]).astype(float), (x, y), radius) for xs, ys, x, y in zip(b["xs"], b["ys"], b["x"], b["y"])]
            yield pd.DataFrame({"id": b["id"], "disc": b["disc"], "area": held})

    return left.join(right, ["ix", "iy"]).select("id", "xs", "ys", "disc", "x", "y").mapInPandas(run, "id long, disc long, area double").where("area > 1e-15")


def overlap_query(spark, sf_dir: str) -> DataFrame:
    """A square of side 0.03 around each cell, over a grid of 0.05."""
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    corners = e.select(F.col("vec_id").alias("id"), F.array(x - 0.015, x + 0.015, x + 0.015, x - 0.015).alias("xs"), F.array(y - 0.015, y - 0.015, y + 0.015, y + 0.015).alias("ys"))
    return overlap_grid(corners, 0.05).select("id", "ix", "iy", F.round("area", 9).alias("area"))


#: The same by interval arithmetic on the box of each square.
OVERLAP_SQL = """with b as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings), o as (select 0 as d union all select 1),
t as (select id, x, y, cast(floor((x - 0.015) / 0.05) as bigint) + p.d as ix, cast(floor((y - 0.015) / 0.05) as bigint) + q.d as iy from b cross join o p cross join o q),
a as (select id, ix, iy, greatest(least(x + 0.015, (ix + 1) * 0.05) - greatest(x - 0.015, ix * 0.05), 0) * greatest(least(y + 0.015, (iy + 1) * 0.05) - greatest(y - 0.015, iy * 0.05), 0) as area from t)
select id, ix, iy, round(cast(area as double), 9) as area from a where area > 0"""
