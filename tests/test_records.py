"""Scans, record expressions, components and solvers on literal inputs."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cordillera.functions import records
from cordillera.operators import graphs
from cordillera.sources import ndjson


def test_tolerant_scan(spark, tmp_path):
    path = tmp_path / "a.ndjson"
    path.write_text('{"id": "1"}\n\n[1]\n{bad\n{"id": "2", "more": 3}\n')
    good, bad = ndjson.scan(spark, str(path), StructType([StructField("id", StringType())]))
    assert sorted(r["id"] for r in good.collect()) == ["1", "2"]
    assert sorted(r["error"] for r in bad.collect()) == ["invalid JSON", "not an object"]
    row = ndjson.audit(good, bad).first()
    assert (row["good"], row["bad"]) == (2, 2)


def test_expressions(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/AB.", "A <b>Tall</b> Tale: two", "x; y;;z")], "d string, t string, a string")
    row = df.select(records.doi(F.col("d")).alias("d"), records.title(F.col("t")).alias("t"), records.authors(F.col("a")).alias("a"), records.number(F.lit("1,200.5")).alias("n")).first()
    assert (row["d"], row["t"], row["a"], row["n"]) == ("10.1/ab", "a tall tale two", ["x", "y", "z"], 1200.5)
    empty = F.lit(None).cast("string")
    assert df.select(records.stable_id(empty, empty, empty, F.col("d"), F.col("t"), empty).alias("i")).first()["i"] == "DOI:10.1/ab"
    assert df.select(records.stable_id(empty, F.lit("7"), empty, empty, empty, empty).alias("i")).first()["i"] == "PMID:7"


def test_components_and_front(spark):
    nodes = spark.createDataFrame([(i, i < 5) for i in range(8)], "id long, core boolean")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (6, 5), (3, 7)], "u long, v long")
    found = {r["id"]: r["component"] for r in graphs.components(nodes, edges).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 0}
    parts = {r["id"]: r["part"] for r in graphs.front(nodes, edges, 3).collect()}
    assert parts == {0: "core", 1: "core", 2: "core", 3: "front", 4: "peri", 5: "peri", 6: "peri", 7: "front"}


def test_solvers(spark):
    links = spark.createDataFrame([(0, i % 3, i, 1.0, float(i * i)) for i in range(9)], "component long, spot long, cell long, weight double, value double")
    out = {r["cell"]: r["value"] for r in graphs.null_space_center(links).collect()}
    assert max(abs(sum(out[c] for c in range(9) if c % 3 == s)) for s in range(3)) < 1e-9
    rows = spark.createDataFrame([(float(i), float(i % 4), 2.0 * i - 3.0 * (i % 4) + 1) for i in range(50)], "a double, b double, y double")
    w = graphs.ridge(rows, ["a", "b"], "y", 1e-9)
    assert np.allclose([w["a"], w["b"], w["intercept"]], [2, -3, 1], atol=1e-5)


def test_ndjson_sinks_and_arrays(spark, tmp_path):
    from cordillera.sources import ndjson

    (tmp_path / "one.json").write_text('[\n  {"name": "A",\n   "n": 1}\n]\n')
    assert [r["name"] for r in ndjson.reference_table(spark, str(tmp_path / "one.json"), "name").collect()] == ["A"]
    (tmp_path / "lines.json").write_text('{"name": "A", "n": 1}\n{"name": "A", "n": 2}\n')
    assert [r["n"] for r in ndjson.reference_table(spark, str(tmp_path / "lines.json"), "name").collect()] == [2]
    out = str(tmp_path / "out")
    for n in (3, 2):
        ndjson.overwrite(spark.range(n), out)
        assert spark.read.json(out).count() == n
    ndjson.append(spark.range(1), out)
    assert spark.read.json(out).count() == 3 and not (tmp_path / "out.old").exists() and not (tmp_path / "out.new").exists()


def test_ndjson_audit_in_order(spark, tmp_path):
    from pyspark.sql.types import StructType

    from cordillera.sources import ndjson

    (tmp_path / "x.ndjson").write_text("\n".join(["zz", '{"a": 1}', "", "[1]", "bb", "aa", "cc", "dd"]) + "\n")
    good, bad = ndjson.scan(spark, str(tmp_path / "x.ndjson"), StructType().add("a", "integer"))
    row = ndjson.audit(good, bad).first()
    assert (row["good"], row["bad"], row["examples"]) == (1, 6, ["zz", "[1]", "bb", "aa", "cc"])
