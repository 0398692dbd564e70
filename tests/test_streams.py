"""Stateful streams, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import jobs as J
from pagemill.sources import sinks, tables
from pagemill.streaming import logs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def streamed(spark, tmp_path, batches, schema, f, name):
    """Rows that ``f`` makes of a stream whose files are ``batches``, one each a trigger."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / "in"))
        q = f(spark.readStream.schema(schema).json(str(folder / "in"))).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(folder / "out")).collect()


S = 1_000_000


def test_admission_on_a_stream(rocks, tmp_path):
    schema = "account string, kind string, ticket string, at long, tokens long"
    one = [("a", "request", f"t{i}", i, 100) for i in range(8)] + [("b", "request", "big", 0, 801), ("b", "request", "none", 0, None)]
    two = [("a", "settle", "t0", 5 * S, 0), ("a", "request", "t8", 6 * S, 50), ("a", "cooldown", "", 7 * S, 200), ("a", "request", "t9", 8 * S, 1)]
    got = {r["ticket"]: r["admitted_at"] for r in streamed(rocks, tmp_path, [one, two], schema, lambda s: logs.admit_stream(s, 8, 1000), "admit")}
    # settling frees tokens, never a request's place; the cooldown outlasts the window
    assert [got[f"t{i}"] for i in range(8)] == list(range(8)) and got["t8"] == 60 * S and got["t9"] == 207 * S and got["big"] is None and got["none"] == 0


def test_window_without_limits():
    w = logs.Window(0, 0)
    assert [w.admit(5, 10**9) for _ in range(1000)] == [5] * 1000
    w = logs.Window(0, 100, 0.8)
    assert w.admit(0, 80) == 0 and w.admit(1, 81) is None and w.admit(1, 1) == 60 * S


def test_admission_as_early_as_can_be(spark):
    rows = [("a", k, t, c) for k, (t, c) in enumerate([(0, 60), (1, 50), (2, 10), (70, 100), (71, 1), (500, 0)])]
    df = spark.createDataFrame(rows, "a string, k int, s long, c long").withColumn("ts", F.timestamp_seconds("s"))
    got = [r["admitted_at"] // S for r in logs.admit(df, "a", "ts", "c", 0, 100).orderBy("k").collect()]
    assert got == [0, 60, 60, 120, 180, 500]


def test_log_lines_follow(rocks, tmp_path):
    line = lambda n, text="x": f"2024-01-01T00:00:00.{n:09d}Z {text}"
    first = [("l", 1, i, x) for i, x in enumerate([line(1), line(2), line(2), line(3, "y"), "no time"])]
    second = [("l", 2, i, x) for i, x in enumerate([line(2), line(2), line(2), line(3, "y"), line(1), line(4)])]
    third = [("l", 3, i, x) for i, x in enumerate([line(2)] * 3 + [line(4), "2024-01-01T00:00:05.000000000Z z", line(4)])]
    fourth = [("l", 4, i, x) for i, x in enumerate([line(4), "2024-01-01T00:00:05.000000000Z z"])]
    got = streamed(rocks, tmp_path, [first, second, third, fourth], "log string, snapshot int, seq int, line string", logs.follow_stream, "follow")
    new = sorted((r["snapshot"], r["seq"]) for r in got)
    # what is older than a second before the last line is forgotten, so the fourth snapshot's first line is new again
    assert new == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 2), (2, 5), (3, 4), (3, 5), (4, 0)]


def test_heartbeats_and_log_times(spark):
    df = spark.createDataFrame([("running", "2024-01-01T00:00:29.5+00:00"), ("running", "2024-01-01T00:00:30Z"), ("finished", "x"), ("running", "2024-01-01T00:01:00"), (None, None)], "s string, b string")
    at = F.lit("2024-01-01 00:01:00Z").cast("timestamp")
    assert [r[0] for r in df.select(J.heartbeat(F.col("s"), J.beat_time(F.col("b")), at)).collect()] == ["unresponsive", "alive", "finished", "unknown", "unknown"]
    t = spark.createDataFrame([("2024-01-01T00:00:00.1Z",), ("2024-01-01T00:00:00.000000002Z",), ("2024-13-01T00:00:00Z",), ("Trace",), ("2024-01-01T00:00:00",)], "t string")
    got = [r[0] for r in t.select(J.log_order(F.col("t"))).collect()]
    assert [g and g["nanos"] for g in got] == ["100000000", "000000002", None, None, "000000000"]


def test_checkpoints_artifacts_and_recovery(spark, tmp_path):
    folder = tmp_path / "jobs"
    folder.mkdir()
    for name, text in {"a.json": '{"id": "a", "status": "running"}', "b.json": '{"id": "b"', "c.json": "[1]", "d.json": '{"id": "d", "status": "completed"}', "e.json": ""}.items():
        (folder / name).write_text(text)
    sound, corrupt = tables.checkpoints(spark, str(folder), "id string, status string")
    assert {r["id"] for r in sound.collect()} == {"a", "d"} and corrupt.count() >= 2
    assert [tuple(r) for r in J.recover(sound.select("id", "status"), "status").collect()] == [("a", "queued")]
    files = {r["name"]: r for r in tables.artifacts(spark, str(folder)).collect()}
    assert files["c.json"]["bytes"] == 3 and len(files["a.json"]["sha256"]) == 64


def test_json_is_replaced_and_events_appended(spark, tmp_path):
    path = str(tmp_path / "out")
    for k in (1, 2):
        sinks.write_json(spark.createDataFrame([(k,)], "k int"), path)
    assert [r["k"] for r in spark.read.json(path).collect()] == [2]
    for k in (1, 2):
        sinks.append_events(spark.createDataFrame([(k, "progress")], "k int, kind string"), str(tmp_path / "events"))
    assert sorted(r["k"] for r in spark.read.json(str(tmp_path / "events")).collect()) == [1, 2]
    sinks.copy_files(spark, path, str(tmp_path / "copy"))
    assert [r["k"] for r in spark.read.json(str(tmp_path / "copy")).collect()] == [2]
    one = sinks.versioned(spark.range(2), str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="already exists"):
        sinks.versioned(spark.range(3), str(tmp_path / "v"), "1")
    assert spark.read.parquet(one).count() == 2


def test_traces_that_fail_drop_nothing(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "k int").write.json(str(tmp_path / "in"))
    seen = []

    def fails(batch, number):
        raise OSError("disk full")

    q = sinks.best_effort(spark.readStream.schema("k int").json(str(tmp_path / "in")), lambda b, n: seen.extend(r["k"] for r in b.collect()), fails, str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(seen) == [1, 2]


def test_odd_page_counts_are_refused(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "d string, p long")
    n = spark.createDataFrame([("a", 1), ("b", 1)], "d string, n long")
    assert [tuple(r) for r in sinks.every_second_page(pages.filter("d = 'a'"), "d", "p", n.filter("d = 'a'")).collect()] == [("a", 1)]
    with pytest.raises(Exception, match="has 1 pages"):
        sinks.every_second_page(pages, "d", "p", n).collect()


def test_tree_is_flattened(spark, tmp_path):
    tree = {
        "texts": [{"self_ref": "#/t/0", "label": "title", "text": "T", "prov": [{"page_no": 1, "bbox": {"l": 1, "t": 90, "r": 5, "b": 80, "coord_origin": "BOTTOMLEFT"}}, {"page_no": 2, "bbox": {"l": 1, "t": 2, "r": 5, "b": 8}}]}],
        "tables": [{"self_ref": "#/b/0", "prov": [{"page_no": 2}], "data": {"table_cells": [{"text": " ", "bbox": {"l": 0, "t": 0, "r": 1, "b": 1}}, {"text": "c", "bbox": {"l": 0, "t": 0, "r": 1, "b": 1}}]}}, {"self_ref": "#/b/1", "prov": [], "data": {"table_cells": [{"text": "x", "bbox": {"l": 0, "t": 0, "r": 1, "b": 1}}]}}],
    }
    (tmp_path / "tree.json").write_text(json.dumps(tree))
    heights = spark.createDataFrame([(1, 100.0), (2, 100.0)], "page long, height double")
    got = sorted(tuple(r) for r in tables.descriptors(tables.layout_trees(spark, str(tmp_path / "tree.json")), heights).select("page", "ref", "role", "text", "x0", "y0", "x1", "y1").collect())
    assert got == [(1, "#/t/0", "title", "T", 1.0, 10.0, 5.0, 20.0), (2, "#/b/0/cell/1", "table_cell", "c", 0.0, 0.0, 1.0, 1.0), (2, "#/t/0", "title", "T", 1.0, 2.0, 5.0, 8.0)]


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('[provider]\nmodel = "m"\nretries = 2\n[translation]\nreview = true\n')
    allowed = {"provider": {"model": str, "retries": int}, "translation": {"review": bool}}
    assert tables.settings(str(path), allowed)["provider"]["model"] == "m"
    for bad in ("[other]\nx = 1\n", '[provider]\ntimeout = 1\n', '[provider]\nretries = "2"\n'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            tables.settings(str(path), allowed)
