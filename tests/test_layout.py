"""Order-dependent layout on small pages, against what the rules say and against plain versions."""

import numpy as np

from pagemill.operators import layout as Y, ranking, sets, spatial as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


GLYPH = "page int, line long, seq long, c string, x0 double, x1 double, x double, baseline double, size double"


def word(line, text, x, baseline, size):
    return [(1, line, i, c, x + i * size / 2, x + (i + 1) * size / 2, x + i * size / 2, float(baseline), float(size)) for i, c in enumerate(text)]


def test_lines_as_seen(spark):
    rows = word(0, "Vol", 0.0, 100, 10) + word(1, "th", 15.5, 103, 6) + word(2, "tage", 24.0, 100, 10) + word(3, "far", 200.0, 100, 10) + word(4, "low", 0.0, 130, 10)
    got = {r["line"]: r["text"] for r in Y.visual_lines(frame(spark, rows, GLYPH)).collect()}
    assert got == {0: "Volth tage", 3: "far", 4: "low"} or got == {0: "Volthtage", 3: "far", 4: "low"}


def test_rows_and_places(spark):
    rows = [(1, 0, 50.0, 100.0, 10.0), (1, 1, 10.0, 101.0, 10.0), (1, 2, 30.0, 104.0, 6.0), (1, 3, 5.0, 120.0, 10.0), (1, 4, 9.0, 112.0, 10.0)]
    got = {r["ref"]: (r["row"], r["place"]) for r in Y.rows_of(frame(spark, rows, "page int, ref long, x double, baseline double, size double")).collect()}
    assert got == {0: (0, 2), 1: (0, 0), 2: (0, 1), 4: (1, 0), 3: (2, 0)}


BOX = "page int, ref long, x0 double, y0 double, x1 double, y1 double"


def test_shadows_of_glyphs(spark):
    g = lambda ref, c, color, x: (1, ref, c, "F", 20.0, color, x, 0.0, x + 10, 20.0)
    rows = [g(0, "A", 0x808080, 1.0), g(1, "a", 0, 0.0), g(2, "B", 0x808080, 50.0), g(3, "B", 0, 60.0), g(4, "C", 0xFF, 80.0), g(5, "C", 0xFF, 81.0), g(6, "C", 0xFF, 79.0)]
    schema = "page int, ref long, c string, font string, size double, color int, x0 double, y0 double, x1 double, y1 double"
    assert {(r["ref"], r["of"]) for r in Y.shadows(frame(spark, rows, schema)).collect()} == {(0, 1), (5, 4), (6, 4)}


def test_copies_of_texts(spark):
    rows = [(1, 0, "A long label", 0.0, 0.0, 100.0, 10.0), (1, 1, "a LONG", 0.0, 0.0, 60.0, 10.0), (1, 2, "a long", 300.0, 0.0, 360.0, 10.0), (1, 3, "A long label", 1.0, 0.0, 101.0, 10.0), (1, 4, "label", 0.0, 0.0, 60.0, 10.0)]
    got = {(r["ref"], r["of"]) for r in Y.text_copies(frame(spark, rows, "page int, ref long, text string, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got == {(1, 0), (3, 0)}


def test_clusters_grow(spark):
    # 3 meets the box around 0 and 1, though neither of them
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 5.0, 5.0, 30.0, 30.0), (1, 2, 100.0, 0.0, 110.0, 10.0), (1, 3, 20.0, 0.0, 25.0, 4.0), (1, 4, 30.0, 0.0, 40.0, 4.0)]
    got = {r["ref"]: r["cluster"] for r in Y.patch_clusters(frame(spark, rows, BOX)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def test_boxes_meet_once(spark):
    rng = np.random.default_rng(4)
    rows = [(int(p), i, float(x), float(y), float(x + w), float(y + h)) for i, (p, x, y, w, h) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(-200, 700, 300), rng.integers(0, 400, 300), rng.integers(0, 350, 300), rng.integers(0, 90, 300)))]
    rows += [(0, 900, float("nan"), 0.0, 1.0, 1.0), (0, 901, 0.0, 0.0, float("inf"), 1.0), (0, 902, 0.0, 0.0, 1e300, 1.0)]
    df = frame(spark, rows, BOX)
    got = sorted((r["page"], r["a"], r["b"]) for r in S.overlaps(df).collect())
    over = lambda a, b: min(a[4], b[4]) - max(a[2], b[2]) > 0.6 and min(a[5], b[5]) - max(a[3], b[3]) > 0.6
    assert got == sorted((a[0], a[1], b[1]) for a in rows[:300] for b in rows[:300] if a[0] == b[0] and a[1] < b[1] and over(a, b))
    one = S.touching(df, df, "x", 5.0).select("a_ref", "b_ref").collect()
    near = lambda a, b: a[2] - 5 <= b[4] and b[2] <= a[4] + 5
    assert sorted((r[0], r[1]) for r in one) == sorted((a[1], b[1]) for a in rows[:300] for b in rows[:300] if a[0] == b[0] and near(a, b))


def test_equal_points_are_two(spark):
    points = frame(spark, [(1, 0, 5.0, 5.0), (1, 1, 5.0, 5.0), (1, 2, 50.0, 5.0)], "page int, id long, x double, y double")
    boxes = frame(spark, [(1, 7, 0.0, 0.0, 10.0, 10.0), (1, 8, 0.0, 0.0, 9.0, 10.0)], BOX)
    assert sorted((r["id"], r["ref"]) for r in S.own_points(points, boxes, "id").collect() if r["ref"]) == [(0, 8), (1, 8)]


def test_prefixes_of_any_length(spark):
    texts = ["a", "ab", "abc", "b", "hello wo", "hello world", "hello world!", "hello", "hellp", "héllo", "héllo x", "zz"]
    got = {r["t"]: r["within"] for r in sets.prefixes(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    raw = {t: t.encode() for t in texts}
    want = {t: min((o for o in texts if o != t and o.startswith(t)), key=lambda o: raw[o], default=None) for t in texts}
    assert got == {t: o for t, o in want.items() if o}


def test_related_leaves_the_group_out(spark):
    index = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, "alpha"), (4, "alpha"), (4, "beta"), (5, "gamma")], "page long, term string")
    queries = spark.createDataFrame([(9, "alpha"), (9, "beta")], "query long, term string")
    group = spark.createDataFrame([(9, 1)], "query long, page long")
    got = [(r["rank"], r["other"]) for r in ranking.related(index, queries, 5, 3, group).orderBy("rank").collect()]
    assert got == [(1, 4), (2, 3)]
