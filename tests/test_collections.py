"""FeatureCollections read by several tasks: the same features in the same order, wherever the file is cut."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardscore.sources import feature_collections as C
from wardscore.sources.boundaries import load_zones, read_features


def ring(i):
    return [[i, 0], [i + 1, 0], [i + 1, 1.5], [i, 1], [i, 0]]


def feature(i, **more):
    odd = ['plain', 'a { brace', '"quoted" }', 'back \\ slash \\" {', '[list] {"type": "Feature"}', 'tab\t\nü{', ''][i % 7]
    kind = {"type": "Polygon", "coordinates": [ring(i)]} if i % 5 else {"type": "MultiPolygon", "coordinates": [[ring(i)], [ring(i + 0.25)]]}
    return {"type": "Feature", "properties": {"id": i, "name": odd, "nested": {"deep": {"er": "}"}}, "none": None}, "geometry": kind, **more}


def collection(features, **more):
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, **more, "features": features}


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_cut_anywhere(spark, tmp_path, small_splits, style):
    features = [feature(i) for i in range(60)]
    (tmp_path / "b.json").write_text(json.dumps(collection(features, extra=[{"type": "other"}], bbox=[0, 0, 1, 1]), **style))
    (tmp_path / "a.json").write_text(json.dumps(collection([feature(100, id="x", bbox=[1, 2, 3, 4]), feature(101)], note={"a": [1]}), **style))
    texts = spark.read.option("lineSep", "{").text(str(tmp_path))
    assert texts.rdd.getNumPartitions() > 10
    got = [json.JSONDecoder().raw_decode(r.value)[0] for r in C.collection_features(spark, str(tmp_path)).orderBy("file_order").collect()]
    assert [g for g in got if g["type"] == "Feature"] == [feature(100, id="x", bbox=[1, 2, 3, 4]), feature(101), *features]
    zones = load_zones(spark, str(tmp_path)).orderBy("file_order").collect()
    assert [z.zone_id for z in zones] == ["100", "101", *map(str, range(60))]
    assert [z.zone_name for z in zones] == [f["properties"]["name"] for f in (feature(100), feature(101), *features)]
    assert [len(z.parts) for z in zones] == [2, 1, *(1 if i % 5 else 2 for i in range(60))]


def test_cut_at_every_length(spark, tmp_path, small_splits):
    want = [feature(i) for i in range(7)]
    (tmp_path / "one.json").write_text(json.dumps(collection(want)))
    draw = random.Random(3)
    for size in sorted(draw.sample(range(40, 2500), 4)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        got = C.collection_features(spark, str(tmp_path)).orderBy("file_order").collect()
        assert [json.JSONDecoder().raw_decode(r.value)[0] for r in got] == want


def test_reference_systems(spark, tmp_path):
    def read(name, doc):
        (tmp_path / name).write_text(json.dumps(doc))
        return read_features(spark, str(tmp_path / name)).collect()

    plane = collection([feature(1)], crs={"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::2263"}})
    assert read("plane.json", plane)[0].system == "2263" and read("plain.json", collection([feature(1)]))[0].system == "4326"
    assert read("none.json", {"type": "FeatureCollection", "features": [feature(2)]})[0].system is None
    assert read("empty.json", collection([])) == []
    with pytest.raises(Exception, match="Unknown reference system"):
        read("other.json", collection([feature(1)], crs={"type": "name", "properties": {"name": "EPSG:27700"}}))
    late = {"type": "FeatureCollection", "features": [feature(1)], "crs": {"type": "name", "properties": {"name": "EPSG:2263"}}}
    with pytest.raises(Exception, match="after the features"):
        read("late.json", late)


def test_lines_are_numbered_in_file_order(spark, tmp_path, small_splits):
    lines = [json.dumps(feature(i)) for i in range(40)]
    (tmp_path / "lines.json").write_text("\n\n".join(lines) + "\n")
    got = C.numbered_lines(spark, str(tmp_path)).orderBy("file_order").collect()
    assert [json.loads(r.value) for r in got] == [feature(i) for i in range(40)]
    assert [r.file_order - got[0].file_order for r in got] == list(range(40))


def test_no_task_reads_more_than_its_range(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(collection([feature(i) for i in range(30)])))
    rows = C.fragments(spark, str(tmp_path))
    plan = C.running(rows, {"_quoted": F.col("_quotes")})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
