"""Every query with an oracle against DuckDB over the same tables, and the operators' own invariants."""

import math

import duckdb
import pytest

from pagemill.functions import text as X, tokens as M, udtf
from pagemill.operators import packing
from pagemill.plans.queries import ORACLES, QUERIES
from pagemill.streaming import logs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = duck.sql(f"SELECT {columns} FROM ({ORACLES[name]})")
    assert sorted(df.columns) == sorted(duck.sql(ORACLES[name]).columns)
    assert canonical(df.collect()) == canonical(want.fetchall())


def test_interval_union_on_odd_rows(spark, tmp_path):
    # no two rows of a part are equal, so the SQL has one result
    lines = [(1, 10, 2.5), (1, 13, 1.0), (2, 10, 3.5), (2, 14, 0.5), (3, 5, None), (3, 5, 2.0), (3, 7, 1.0), (4, None, 1.0), (4, 3, 1.6), (5, 3, None), (None, 1, 1.0), (None, 1, 4.0)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = canonical(c.sql(ORACLES["interval_union"]).fetchall())
    assert canonical(QUERIES["interval_union"](spark, str(tmp_path)).collect()) == want
    assert ("1", "2", "3") in want and ("3", "1", "3") in want


def test_admission_never_exceeds_the_window(spark, sf):
    seen = {}
    for r in QUERIES["admission_simulation"](spark, sf).collect():
        if r["admitted_at"] is not None:
            seen.setdefault(r["user_id"], []).append((r["admitted_at"], r["tokens"]))
    for own in seen.values():
        for t, _ in own:
            inside = [c for u, c in own if t - 21600_000_000 < u <= t]
            assert len(inside) <= 2 and sum(inside) <= 200


def test_chunks_join_and_fit():
    text = "one line\ntwo lines here\n" * 40 + "x" * 3000
    for budget in (1, 7, 50, 10_000):
        parts = list(udtf.chunks(text, budget))
        assert "".join(parts) == text and all(len(p) <= budget for p in parts)
    assert list(udtf.chunks("ab\ncdef", 6)) == ["ab\ncde", "f"] and list(udtf.chunks("abcd\nef", 6)) == ["abcd\n", "ef"]
    with pytest.raises(ValueError):
        list(udtf.chunks("abc", 0))
    assert list(udtf.halves([5, 5, 5, 30, 1], 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)] and list(udtf.halves([], 3)) == []


@pytest.mark.parametrize("spec", ["0", "1,1", "3-1", "7", "1-2-3", "a", "1,", "-2", "2,1-3"])
def test_page_ranges_refused(spec):
    with pytest.raises(ValueError):
        list(udtf.page_ranges(spec, 6))


def test_page_ranges_keep_order():
    assert list(udtf.page_ranges("5-6, 1,3", 6)) == [5, 6, 1, 3] and list(udtf.page_ranges(None, 3)) == list(udtf.page_ranges("", 3)) == [1, 2, 3]


def test_packing_is_maximal(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([3, 4, 5, 100, 1, 1, 9])], "g string, k int, c long")
    got = [r["batch"] for r in packing.pack_by_budget(df, "g", "k", "c", 10).orderBy("k").collect()]
    assert got == [1, 1, 2, 3, 4, 4, 5]
    none = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 8), ("a", 4, 9)], "g string, k int, c long")
    assert [r["batch"] for r in packing.pack_by_budget(none, "g", "k", "c", 10).orderBy("k").collect()] == [1, 1, 2, 3]


def test_scalars(spark):
    df = spark.createDataFrame([("見る abc", "ﬁ été NBSP　x", "Bearer abc  sk-12 ok", "Sat, 01 Jan 2028 00:00:30 GMT")], "a string, b string, c string, d string")
    from pyspark.sql import functions as F

    as_of = F.lit("2028-01-01 00:00:00").cast("timestamp")
    r = df.select(M.estimate(F.col("a")).alias("a"), X.compact(F.col("b")).alias("b"), X.redact(F.col("c")).alias("c"), M.retry_after(F.col("d"), as_of).alias("d"), M.retry_after(F.lit("7.5"), as_of).alias("e"), M.retry_after(F.lit("-3"), as_of).alias("f"), M.retry_after(F.lit("soon"), as_of).alias("g"), X.ocr_key(F.lit("Straße – ﬁ")).alias("h")).first()
    assert r["a"] == math.ceil(1 * 1.3 + 5 / 2.5) and r["b"] == "fiétéNBSPx" and r["c"] == "[redacted] [redacted] ok"
    assert (r["d"], r["e"], r["f"], r["g"]) == (30.0, 7.5, 0.0, 0.0) and r["h"] == "strasse-fi"


def test_failure_counts_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = logs.failure_counts(stream, "ts", "event_type", 60).writeStream.outputMode("complete").format("memory").queryName("failures").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = logs.failure_counts(events, "ts", "event_type", 60)
    assert sorted(map(str, spark.table("failures").collect())) == sorted(map(str, want.collect()))
