"""JSON files in and out, and the landing folder as a stream."""

import json

import pytest

from graphloom.sources import json_files as J
from graphloom.streaming.landing import ingest


def write(folder, name, value):
    path = folder / name
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_roots(spark, tmp_path):
    paths = [write(tmp_path, "a.json", [{"x": 1}, {"x": 2}]), write(tmp_path, "b.json", {"entities": [{"x": 3}]}), write(tmp_path, "c.json", {"x": 4}), write(tmp_path, "d.json", "{broken")]
    docs = J.documents(spark, *paths)
    rows = J.root_records(docs).orderBy("path", "ord").collect()
    assert [json.loads(r.record)["x"] for r in rows] == [1, 2, 3, 4] and [r.ord for r in rows] == [0, 1, 0, 0]
    assert [r.path.rpartition("/")[2] for r in J.rejects(docs).collect()] == ["d.json"]
    with pytest.raises(Exception, match="no source_id"):
        J.checked_records(J.documents(spark, paths[0])).collect()


def test_typed_records(spark, tmp_path):
    record = {"global_idx": 7, "input_used": ["a", "b"], "success": True, "output": {"entities": [{"id": "D1", "label": "Disease", "name": "Flu", "properties": {"k": "v"}}], "relationships": []}}
    path = write(tmp_path, "r.json", [record, {"input_used": "one"}])
    rows = J.typed(J.root_records(J.documents(spark, path)), J.EXTRACTION)
    got = rows.withColumn("used", J.input_used(rows.raw)).orderBy("ord").collect()
    assert got[0].global_idx == 7 and got[0].output.entities[0].properties == {"k": "v"} and got[0].used == ["a", "b"] and got[1].used == ["one"]


def test_paths(spark, tmp_path):
    for n in ("b.json", "a.json", "a.metadata.json", "skip_1.json", "out.json"):
        write(tmp_path, n, [])
    got = J.input_paths(spark, [f"{tmp_path}/b.json"], [str(tmp_path)], ["*.json"], ["skip_*"], [f"{tmp_path}/out.json"])
    assert [p.rpartition("/")[2] for p in got] == ["b.json", "a.json"]
    assert J.latest(spark, str(tmp_path), "*.json").endswith("skip_1.json")


def test_pretty_writer(spark, tmp_path):
    value = [{"a": "é", "b": [1, {"c": None}]}, {"a": "2"}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(value)], "ord int, record string")
    assert J.write_pretty(df, f"{tmp_path}/x.json", "ord") == 2
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == json.dumps(value, ensure_ascii=False, indent=2) + "\n"
    J.write_pretty(df.limit(0), f"{tmp_path}/e.json", newline=False)
    assert (tmp_path / "e.json").read_text() == "[]"


def test_dual_sink_shards_and_checkpoint(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 1), (2, False, 2)], "global_idx long, ok boolean, shard int")
    J.write_raw_and_filtered(df, df.ok, str(tmp_path), "t")
    assert spark.read.parquet(f"{tmp_path}/raw_t").count() == 2 and spark.read.parquet(f"{tmp_path}/filtered_t").count() == 1
    J.write_shards(df, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").where("shard = 2").count() == 1
    J.append_new(df, f"{tmp_path}/done")
    assert J.append_new(df.union(spark.createDataFrame([(3, True, 1)], df.schema)), f"{tmp_path}/done").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    schema = spark.createDataFrame([], "global_idx long, ord long, v string").schema
    landing, target, checkpoint = (f"{tmp_path}/{n}" for n in ("landing", "target", "checkpoint"))
    for part in ([(1, 0, "a"), (2, 1, "b"), (1, 2, "c")], [(2, 3, "d"), (3, 4, "e")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        ingest(spark, landing, schema, target, checkpoint)
    ingest(spark, landing, schema, target, checkpoint)
    assert sorted((r.global_idx, r.v) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b"), (3, "e")]


def test_roots_that_have_to_be_lists(spark):
    df = spark.createDataFrame([("a", '[{"x": 1}, 2]'), ("b", '{"entities": [3]}')], "path string, value string")
    assert sorted((r.path, r.ord, r.record) for r in J.listed_records(df).collect()) == [("a", 0, '{"x":1}'), ("a", 1, "2"), ("b", 0, "3")]
    for bad in ('{"entities": {"x": 1}}', '{"x": []}', "5"):
        with pytest.raises(Exception, match="no list of records"):
            J.listed_records(spark.createDataFrame([("c", bad)], df.schema)).collect()
