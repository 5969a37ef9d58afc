"""Queries against their SQL on small tables that show what first occurred on large ones."""

import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from cordillera.catalog import ORACLE_SQL, QUERIES
from cordillera.operators import graphs, storage

EMBEDDINGS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])


def embeddings(folder, points, labels=None):
    """points: (x, y); the third and fourth components are 0."""
    rows = [range(len(points)), [[x, y, 0, 0] for x, y in points], labels or [0] * len(points)]
    pq.write_table(pa.table([pa.array(r, type=t) for r, t in zip(rows, EMBEDDINGS.types)], schema=EMBEDDINGS), f"{folder}/embeddings.parquet")


def same(spark, folder, name, tables=("embeddings",)):
    """The query's rows, which have to be those of its SQL; NaN as text, as it equals nothing."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    flat = lambda rows: sorted((tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)
    theirs = con.execute(ORACLE_SQL[name])
    ours = QUERIES[name](spark, str(folder)).select(*[d[0] for d in theirs.description])
    found = flat(map(tuple, ours.collect()))
    assert found == flat(theirs.fetchall())
    return found


def test_laplacian_of_degrees_whose_product_underflows(spark, tmp_path):
    close = [(i / 5, j) for i in range(10) for j in (1.0, 1.001)]  # the median distance is 0.001
    embeddings(tmp_path, [*close, (-1.028, 0), (-1, 0), (-0.951, 0), (-0.923, 0)])
    values = {v[2] for v in same(spark, tmp_path, "normalized_laplacian")}
    assert values >= {-1.0, -math.inf, "NaN"}


def test_components_of_points(spark, tmp_path):
    """Near the density where components join; a link that no outermost point of a cell has; plates just out of reach;
    copies; points that have no place."""
    rng = random.Random(1)
    sparse = [(rng.uniform(2, 3), rng.uniform(2, 3)) for _ in range(300)]
    hidden = [(0.030, 0.333), (0.028, 0.367), (0.029, 0.350), (0.0286, 0.3502), (0.0785, 0.367), (0.0805, 0.333), (0.0787, 0.350)]
    plates = [(x + rng.uniform(0, 0.03), rng.uniform(-1, -0.8)) for x in (0, 0.0801) for _ in range(60)]
    places = [*sparse, *hidden, *plates, (5, 5), (5, 5), (math.nan, 5), (5, math.nan), (math.inf, 5), (math.inf, 5), (1e30, 5), (1e30, 5)]
    rng.shuffle(places)
    embeddings(tmp_path, places)
    label = dict(same(spark, tmp_path, "connected_components"))
    assert len({label[places.index(p)] for p in hidden}) == 1
    assert len({label[i] for i, p in enumerate(places) if p in plates}) > 1


def test_components_of_a_crowd_make_no_links_of_all(spark, tmp_path, monkeypatch):
    rng, rows = random.Random(2), []
    embeddings(tmp_path, [(rng.uniform(0, 0.03), rng.uniform(0, 0.03)) for _ in range(1500)])
    monkeypatch.setattr(graphs, "staged", lambda df: rows.append((out := storage.staged(df)).count()) or out)
    found = QUERIES["connected_components"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == {(i, 0) for i in range(1500)}
    assert max(rows) <= 1500


def test_laplacian_of_crowds_copies_and_stragglers(spark, tmp_path, monkeypatch):
    """Neighbours are found by grids of several widths; copies of one place are met by few of them only."""
    rng, rows = random.Random(3), []
    crowd = [(rng.uniform(0, 0.004), rng.uniform(0, 0.004)) for _ in range(150)]
    around = [(rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1)) for _ in range(150)]
    places = [*crowd, *around, *[(0.001, 0.001)] * 30, *[(0.5, 0.5)] * 9, (0.53, 0.5), (2, 2)]
    rng.shuffle(places)
    embeddings(tmp_path, places, [i % 2 for i in range(len(places))])
    assert same(spark, tmp_path, "normalized_laplacian")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "id long, x double, y double")
    monkeypatch.setattr(graphs, "staged", lambda df: rows.append((out := storage.staged(df)).count()) or out)
    found = {(r["a"], r["b"]) for r in graphs.nearest(points, 0.05, 0.0025, 6).collect()}
    assert len(rows) > 4  # more than one width
    far = lambda i, j: math.sqrt((places[i][0] - places[j][0]) ** 2 + (places[i][1] - places[j][1]) ** 2)
    others = {i: sorted((far(i, j), j) for j in range(len(places)) if j != i and far(i, j) <= 0.05) for i in range(len(places))}
    brute = {(i, j) for i, near in others.items() for _, j in near[:6]}
    assert found == brute
