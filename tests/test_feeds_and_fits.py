"""Payload mappers, the paged source, shared areas, positions and fits on literal inputs."""

import json

import numpy as np
from pyspark.sql import functions as F

from cordillera.operators import geometry, models, ordering
from cordillera.sources import feeds



def one(spark, mapper, body, *more):
    return mapper(spark.createDataFrame([(body,)], "body string"), *more).collect()


def test_paged_source(spark, tmp_path, monkeypatch):
    (tmp_path / "page_fixture.py").write_text("def fetch(w, c):\n    n = {'a': 3, 'b': 1}[w]\n    return (f'{w}{c}', 1, n) if c < n else ('', 0, None)\n")
    spark.sparkContext.addPyFile(str(tmp_path / "page_fixture.py"))
    spark.dataSource.register(feeds.Paged)
    rows = spark.read.format("paged").option("fetch", "page_fixture:fetch").option("windows", "a,b").load().collect()
    assert sorted(r["body"] for r in rows) == ["a0", "a1", "a2", "b0"]


def test_crossref(spark):
    body = {"message": {"items": [{"DOI": "10.1/AB", "title": ["T"], "author": [{"given": "G", "family": "F"}, {"family": "X"}, {}], "published": {"date-parts": [[2020, 1]]}, "container-title": ["J"], "type": "article"}, {"DOI": "10.1/c"}]}}
    rows = {r["doi"]: r for r in one(spark, feeds.crossref, json.dumps(body))}
    r = rows["10.1/AB"]
    assert (r["id"], r["title"], r["authors"], r["venue"], r["year"], r["url"]) == ("DOI:10.1/ab", "T", ["G F", "X"], "J", 2020, "https://doi.org/10.1/AB")
    assert rows["10.1/c"]["authors"] == [] and rows["10.1/c"]["year"] is None


def test_preprints(spark):
    items = [{"doi": "10.1/x", "title": "Spatial atlas", "abstract": "of Cells", "authors": "A B; C;", "date": "2024-02-01"}, {"doi": "10.1/y", "title": "Other"}]
    (r,) = one(spark, feeds.preprints, json.dumps({"collection": items}), "biorxiv", "cells ATLAS")
    assert (r["id"], r["authors"], r["year"]) == ("BIORXIV:10.1/x", ["A B", "C"], 2024)


def test_xml_feeds(spark):
    atom = "<feed><entry><id>http://arxiv.org/abs/2401.1v2</id><title>A\n  b &amp; c</title><summary> s </summary><author><name>N M</name></author><published>2024-01-01</published></entry></feed>"
    (r,) = one(spark, feeds.arxiv, atom)
    assert (r["id"], r["title"], r["authors"], r["year"]) == ("ARXIV:2401.1v2", "A b & c", ["N M"], 2024)
    xml = '<S><PubmedArticle><PMID Version="1">7</PMID><Article><Journal><Title>J</Title></Journal><ArticleTitle>On <i>x</i></ArticleTitle><Abstract><AbstractText Label="A">p</AbstractText><AbstractText>q</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList></Article><ArticleId IdType="doi">10.1/z</ArticleId></PubmedArticle></S>'
    (r,) = one(spark, feeds.pubmed, xml)
    assert (r["id"], r["doi"], r["title"], r["authors"], r["venue"], r["abstract"]) == ("PMID:7", "10.1/z", "On x", ["F L"], "J", "p q")
    assert feeds.arxiv_query("x", author="y", sort="date")["search_query"] == "all:x AND au:y"


def test_verified(spark):
    known = spark.createDataFrame([("doi", "10.1/a")], "kind string, identifier string")
    asked = spark.createDataFrame([("doi", " 10.1/A"), ("pmid", "10.1/a")], "kind string, identifier string")
    assert {r["kind"]: r["found"] for r in feeds.verified(asked, known).collect()} == {"doi": True, "pmid": False}


def test_areas(spark):
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    assert abs(geometry.disc_area(square, (0, 0), 0.5) - np.pi / 16) < 1e-12
    assert abs(geometry.disc_area(square, (0.5, 0.5), 9) - 1) < 1e-12
    assert geometry.disc_area(square, (5, 5), 1) < 1e-12
    rng = np.random.default_rng(1)
    points, centre = rng.random((400_000, 2)), (0.9, 0.4)
    assert abs(geometry.disc_area(square, centre, 0.45) - np.mean(((points - centre) ** 2).sum(1) < 0.45**2)) < 0.004
    assert abs(geometry.area(geometry.clip(square, (1, 1), 1)) - 0.5) < 1e-12
    seeds = rng.random((12, 2))
    parts = [geometry.area(geometry.voronoi_cell(s, np.delete(seeds, i, 0), (0, 0, 1, 1))) for i, s in enumerate(seeds)]
    assert abs(sum(parts) - 1) < 1e-9 and min(parts) > 0
    shapes = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0])], "id long, xs array<double>, ys array<double>")
    assert abs(geometry.overlap_grid(shapes, 0.3).agg(F.sum("area")).first()[0] - 1) < 1e-9
    discs = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.5), (3, 3.0, 3.0)], "disc long, x double, y double")
    found = {r["disc"]: r["area"] for r in geometry.overlap_discs(shapes, discs, 0.25).collect()}
    assert set(found) == {1, 2} and abs(found[1] - np.pi / 64) < 1e-12 and abs(found[2] - np.pi / 16) < 1e-12


def test_numbered(spark):
    rows = [(7 if i % 3 else i, i) for i in range(3000)]
    got = ordering.numbered(spark.createDataFrame(rows, "k long, t long"), "k", "t", 16).collect()
    assert [r["t"] for r in sorted(got, key=lambda r: r["idx"])] == [t for _, t in sorted(rows)]
    assert sorted(r["idx"] for r in got) == list(range(3000))
    assert ordering.numbered(spark.createDataFrame([], "k long, t long"), "k", "t").count() == 0


def test_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, v array<double>")
    got = np.array([r["scores"] for r in models.principal(df, "v", 2).orderBy("id").collect()])
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ vt[:2].T), atol=1e-6)
    rows = spark.createDataFrame([(i % 4, float(i), float(i % 7), 2.0 * i - (i % 7) + 3) for i in range(100)], "fold long, a double, b double, y double")
    assert models.r_squared(models.grouped_ridge(rows, "fold", ["a", "b"], "y", 0.0), "y", "predicted") > 0.999999
    like = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert models.average_linkage(like, 0.5) == [0, 0, 1]


def test_manifest(spark, tmp_path):
    import hashlib

    for name, body in (("a", b"one"), ("b", b"two")):
        (tmp_path / name).write_bytes(body)
    sha = hashlib.sha256(b"one").hexdigest()
    manifest = spark.createDataFrame([("a", sha, 3), ("b", sha, 3), ("c", sha, 3)], "name string, sha256 string, bytes long")
    assert {r["name"]: r["problem"] for r in feeds.checked(spark, str(tmp_path), manifest).collect()} == {"b": "checksum", "c": "missing"}


def test_bootstrap_and_clusters(spark):
    rows = [(0, b, f"g{g}", float(10 * g + 1)) for b in range(20) for g in range(5)]
    (r,) = models.bootstrap_profiles(spark.createDataFrame(rows, "cls long, block long, gene string, n double"), "cls", "block", "gene", "n", 5).collect()
    assert abs(r["median"] - 1) < 1e-9 and abs(r["q05"] - 1) < 1e-9  # equal blocks: every resample has the same profile
    points = [(i, [float(i % 2) * 10, i * 0.01], 1.0) for i in range(40)]
    found = {r["id"]: r["cluster"] for r in models.clusters(spark.createDataFrame(points, "id long, v array<double>, w double"), "v", "w", 2).collect()}
    assert len({found[i] for i in range(0, 40, 2)}) == 1 and len({found[i] for i in range(1, 40, 2)}) == 1 and found[0] != found[1]


def test_fits_on_whole_embeddings(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], float)
    x -= x.mean(0)
    axes = np.linalg.eigh(x.T @ x / len(x))[1][:, ::-1][:, :3]
    got = np.array([[r["pc1"], r["pc2"], r["pc3"]] for r in models.pca_query(spark, sf).orderBy("vec_id").collect()])
    assert np.abs(np.abs(got) - np.abs(x @ axes)).max() < 1e-4
    seen, fit = [], models.clusters

    def spy(rows, vector, *rest):
        seen.append(rows.selectExpr(f"min(size({vector})) as n").first()["n"])
        return fit(rows, vector, *rest)

    monkeypatch.setattr(models, "clusters", spy)
    assert models.clusters_query(spark, sf).count() == len(x) and seen == [x.shape[1]]
