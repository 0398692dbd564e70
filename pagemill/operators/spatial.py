"""Box joins. Every one has an equality on the page and a grid cell, so none becomes a nested loop.

Boxes are columns page, ref, x0, y0, x1, y1. ``touching`` deals both sides over the cells that an extent touches and keeps a pair in
the first cell that both touch, and only there; the operators filter and aggregate what meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_FAR = 1e6


def cells(lo: Column, hi: Column, size: float) -> Column:
    """The grid columns that an extent touches; none for what is no finite extent."""
    sound = lo.between(-_FAR, _FAR) & hi.between(-_FAR, _FAR) & (lo <= hi)
    return F.explode(F.when(sound, F.sequence(F.floor(lo / size), F.floor(hi / size))).otherwise(F.expr("cast(array() as array<bigint>)")))


def area(side: str = "") -> Column:
    return (F.col(f"{side}x1") - F.col(f"{side}x0")) * (F.col(f"{side}y1") - F.col(f"{side}y0"))


def common(axis: str) -> Column:
    """Length of what a pair's extents share; negative if they are apart."""
    return F.least(f"a_{axis}1", f"b_{axis}1") - F.greatest(f"a_{axis}0", f"b_{axis}0")


def common_area() -> Column:
    return F.greatest(common("x"), F.lit(0.0)) * F.greatest(common("y"), F.lit(0.0))


def intersects(epsilon: float = 0.1) -> Column:
    """Whether a pair shares more than ``epsilon`` both ways."""
    return (common("x") > epsilon) & (common("y") > epsilon)


def touching(a: DataFrame, b: DataFrame, axis: str = "x", reach: Column | float = 0.0, size: float = 100.0, page: str = "page") -> DataFrame:
    """Pairs (columns ``a_`` and ``b_``) of one page whose extents along ``axis`` touch, those of ``a`` widened by ``reach``."""
    reach = reach if isinstance(reach, Column) else F.lit(float(reach))
    lo, hi = F.col(f"{axis}0"), F.col(f"{axis}1")
    one = a.select("*", (lo - reach).alias("__lo"), (hi + reach).alias("__hi"))
    one = one.select("*", cells(F.col("__lo"), F.col("__hi"), size).alias("__cell"))
    two = b.select("*", lo.alias("__lo"), hi.alias("__hi"), cells(lo, hi, size).alias("__cell"))
    one, two = (df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for s, df in (("a", one), ("b", two)))
    first = F.col("a___cell") == F.floor(F.greatest("a___lo", "b___lo") / size)
    meet = (F.col("a___lo") <= F.col("b___hi")) & (F.col("b___lo") <= F.col("a___hi"))
    on = (F.col(f"a_{page}") == F.col(f"b_{page}")) & (F.col("a___cell") == F.col("b___cell")) & first & meet
    return one.join(two, on).drop("a___lo", "a___hi", "a___cell", "b___lo", "b___hi", "b___cell")


def visible_clip(box: Column, width: Column, height: Column) -> Column:
    """The part of a box (struct of x0, y0, x1, y1) on its page; null if it is not finite, empty or off the page."""
    edges = [box[c] for c in ("x0", "y0", "x1", "y1")]
    finite = None
    for e in edges:
        own = e.between(-_FAR * 1e6, _FAR * 1e6)
        finite = own if finite is None else finite & own
    x0, y0, x1, y1 = F.greatest(edges[0], F.lit(0.0)), F.greatest(edges[1], F.lit(0.0)), F.least(edges[2], width), F.least(edges[3], height)
    return F.when(finite & (edges[0] < edges[2]) & (edges[1] < edges[3]) & (x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def rotated(box: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A box on a page turned by 90, 180 or 270 degrees as it stands on the upright page of ``width`` and ``height``."""
    s = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    return F.when(rotation == 90, s(height - y1, x0, height - y0, x1)).when(rotation == 180, s(width - x1, height - y1, width - x0, height - y0)).when(rotation == 270, s(y0, width - x1, y1, width - x0)).otherwise(box)


def own_points(points: DataFrame, boxes: DataFrame, point: str, fallback: Column | None = None, tolerance: float = 1.0, size: float = 100.0) -> DataFrame:
    """``points`` (page, ``point``, x, y, ...) with ``ref`` of the smallest box of the page that holds them, else ``fallback``.

    ``point`` tells points apart. Ties go to the smaller ref. A point looks into one cell only.
    """
    dealt = boxes.select(F.col("page").alias("__page"), F.col("ref").alias("__ref"), "x0", "y0", "x1", "y1", area().alias("__area"), cells(F.col("x0") - tolerance, F.col("x1") + tolerance, size).alias("__b_cell"))
    at = points.withColumn("__cell", F.floor(F.col("x") / size))
    inside = F.col("x").between(F.col("x0") - tolerance, F.col("x1") + tolerance) & F.col("y").between(F.col("y0") - tolerance, F.col("y1") + tolerance)
    joined = at.join(dealt, (F.col("page") == F.col("__page")) & (F.col("__cell") == F.col("__b_cell")) & inside, "left")
    rest = [c for c in points.columns if c not in ("page", point)]
    ref = F.min_by("__ref", F.when(F.col("__ref").isNotNull(), F.struct("__area", "__ref")))
    own = joined.groupBy("page", point).agg(*[F.first(c).alias(c) for c in rest], ref.alias("ref"))
    return own.withColumn("ref", F.coalesce("ref", fallback)) if fallback is not None else own


def word_owners(glyphs: DataFrame, word: list[str], seq: str, ref: str) -> DataFrame:
    """``glyphs`` with ``ref`` of the box that owns most of their word's glyphs, the first seen of equals; null words keep theirs."""
    votes = glyphs.filter(F.col(word[-1]).isNotNull()).groupBy(*word, ref).agg(F.count("*").alias("n"), F.min(seq).alias("at"))
    winner = votes.groupBy(*word).agg(F.min_by(ref, F.struct(-F.col("n"), "at")).alias("__ref"))
    return glyphs.join(winner, word, "left").withColumn(ref, F.coalesce("__ref", ref)).drop("__ref").select(*glyphs.columns)


def smallest_container(regions: DataFrame, boxes: DataFrame, slack: float = 2.0, size: float = 100.0) -> DataFrame:
    """Page and ref of each region (with its text's ``size``) and ``container``, the smallest box around it up to ``slack``.

    A container is lower than four sizes and wider than three; ties go to the smaller ref.
    """
    near = touching(regions, boxes, "x", slack, size)
    inside = (F.col("b_x0") - slack <= F.col("a_x0")) & (F.col("b_y0") - slack <= F.col("a_y0")) & (F.col("a_x1") <= F.col("b_x1") + slack) & (F.col("a_y1") <= F.col("b_y1") + slack)
    shape = (F.col("b_y1") - F.col("b_y0") < F.col("a_size") * 4) & (F.col("b_x1") - F.col("b_x0") > F.col("a_size") * 3)
    return near.filter(inside & shape).groupBy(F.col("a_page").alias("page"), F.col("a_ref").alias("ref")).agg(F.min_by("b_ref", F.struct(area("b_"), "b_ref")).alias("container"))


def overlaps(boxes: DataFrame, epsilon: float = 0.6, size: float = 100.0) -> DataFrame:
    """Pairs (page, a, b), a < b, of placements any of whose boxes (several rows a ref) share more than ``epsilon`` both ways."""
    near = touching(boxes, boxes, "x", 0.0, size).filter((F.col("a_ref") < F.col("b_ref")) & intersects(epsilon))
    return near.select(F.col("a_page").alias("page"), F.col("a_ref").alias("a"), F.col("b_ref").alias("b")).distinct()


def inside_any(rows: DataFrame, boxes: DataFrame, slack: float = 1.0, size: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(rows inside none of ``boxes`` up to ``slack``, the others)."""
    near = touching(rows, boxes, "x", slack, size)
    inside = (F.col("b_x0") - slack <= F.col("a_x0")) & (F.col("b_y0") - slack <= F.col("a_y0")) & (F.col("a_x1") <= F.col("b_x1") + slack) & (F.col("a_y1") <= F.col("b_y1") + slack)
    held = near.filter(inside).select(F.col("a_page").alias("page"), F.col("a_ref").alias("ref")).distinct()
    return rows.join(held, ["page", "ref"], "left_anti"), rows.join(held, ["page", "ref"], "left_semi")


def not_covered(rows: DataFrame, boxes: DataFrame, share: float = 0.8, size: float = 100.0) -> DataFrame:
    """Rows of whose area no one box covers more than ``share``."""
    held = touching(rows, boxes, "x", 0.0, size).filter(common_area() > share * area("a_")).select(F.col("a_page").alias("page"), F.col("a_ref").alias("ref")).distinct()
    return rows.join(held, ["page", "ref"], "left_anti")


def left_peers(regions: DataFrame, size: float = 16.0) -> DataFrame:
    """Page and ref of regions (ref, native, size, box) with a neighbouring row of another width on the same left edge."""
    edge = regions.select("page", "ref", "native", "size", "y0", (F.col("x1") - F.col("x0")).alias("width"), F.col("x0"), F.col("x0").alias("x1"))
    near = touching(edge, edge, "x", F.greatest(F.lit(2.0), F.col("size") * 0.2), size)
    gap = F.abs(F.col("b_y0") - F.col("a_y0"))
    peer = (F.col("a_ref") != F.col("b_ref")) & (F.col("a_native") == F.col("b_native")) & (F.abs(F.col("b_x0") - F.col("a_x0")) < F.greatest(F.lit(2.0), F.col("a_size") * 0.2))
    peer &= (F.abs(F.col("b_size") - F.col("a_size")) < F.col("a_size") * 0.15) & (gap > F.col("a_size") * 0.7) & (gap < F.col("a_size") * 4) & (F.abs(F.col("b_width") - F.col("a_width")) > F.col("a_size"))
    return near.filter(peer).select(F.col("a_page").alias("page"), F.col("a_ref").alias("ref")).distinct()


def frame_limits(regions: DataFrame, others: DataFrame, width: float, height: float, size: float = 100.0) -> DataFrame:
    """How far a region's frame may grow: ``right`` and ``bottom``, by the page and by others beside and below it.

    One beside it overlaps in height and begins at its right edge or beyond; one below overlaps in width.
    """
    keys = [F.col("a_page").alias("page"), F.col("a_ref").alias("ref")]
    apart = F.col("a_ref") != F.col("b_ref")
    beside = touching(regions, others, "y", 0.1, size).filter(apart & (F.col("b_y0") < F.col("a_y1") + 0.1) & (F.col("b_y1") > F.col("a_y0") - 0.1) & (F.col("b_x0") >= F.col("a_x1") - 0.2))
    below = touching(regions, others, "x", 0.0, size).filter(apart & (F.col("b_x0") < F.col("a_x1")) & (F.col("b_x1") > F.col("a_x0")) & (F.col("b_y0") >= F.col("a_y1") - 0.2))
    met = beside.select(*keys, (F.col("b_x0") - 1).alias("right"), F.lit(None).cast("double").alias("bottom")).unionByName(below.select(*keys, F.lit(None).cast("double").alias("right"), (F.col("b_y0") - 1).alias("bottom")))
    own = regions.select("page", "ref", F.lit(width - 3.0).alias("right"), F.lit(height - 2.0).alias("bottom"))
    return own.unionByName(met).groupBy("page", "ref").agg(F.min("right").alias("right"), F.min("bottom").alias("bottom"))


def largest_overlap(images: DataFrame, placements: DataFrame, size: float = 100.0) -> DataFrame:
    """Page and ref of each image and ``owner``, the placement that shares most of its area (the first of equals)."""
    near = touching(images, placements, "x", 0.0, size).filter(intersects(0.1))
    return near.groupBy(F.col("a_page").alias("page"), F.col("a_ref").alias("ref")).agg(F.min_by("b_ref", F.struct(-common_area(), "b_ref")).alias("owner"))


def same_text(descriptors: DataFrame, glyphs: DataFrame, key, size: float = 100.0) -> DataFrame:
    """Page and ref of descriptors (with ``text``) that say what the glyphs there do.

    Local glyphs (ref in reading order, c, size, box) lie within the descriptor's width up to 2, overlap its height, and are centred on it
    up to half the larger of the two heights. ``key`` folds texts for the comparison.
    """
    mid = lambda s, d: (F.col(f"{s}_{d}0") + F.col(f"{s}_{d}1")) / 2
    centred = F.abs(mid("a", "y") - mid("b", "y")) < F.greatest(F.col("a_y1") - F.col("a_y0"), F.col("b_size")) * 0.5
    local = mid("b", "x").between(F.col("a_x0") - 2, F.col("a_x1") + 2) & (F.greatest("a_y0", "b_y0") < F.least("a_y1", "b_y1")) & centred
    near = touching(descriptors, glyphs, "x", 2.0, size).filter(local)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_ref", "b_c"))), lambda x: x["b_c"]), "")
    own = near.groupBy(F.col("a_page").alias("page"), F.col("a_ref").alias("ref"), F.col("a_text").alias("text")).agg(text.alias("native"))
    return own.filter((key(F.col("text")) != "") & (key(F.col("text")) == key(F.col("native")))).select("page", "ref")


def text_inside(frames: DataFrame, glyphs: DataFrame, grow: float = 1.8, size: float = 100.0) -> DataFrame:
    """Page and ref of each frame and the text of the glyphs centred in it, in their order; null if there are none."""
    mid = lambda s, d: (F.col(f"{s}_{d}0") + F.col(f"{s}_{d}1")) / 2
    near = touching(frames, glyphs, "x", grow, size)
    near = near.filter(mid("b", "x").between(F.col("a_x0") - grow, F.col("a_x1") + grow) & mid("b", "y").between(F.col("a_y0") - grow, F.col("a_y1") + grow))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_ref", "b_c"))), lambda x: x["b_c"]), "")
    own = near.groupBy(F.col("a_page").alias("page"), F.col("a_ref").alias("ref")).agg(text.alias("observed"))
    return frames.join(own, ["page", "ref"], "left")


def split_tails(lines: DataFrame, size: float = 50.0) -> DataFrame:
    """(page, tail, head): lines of one or two letters that go on the word of another line, the first of those that fit.

    ``lines``: page, ref (in order), text, font, size, baseline, x0, x1. A head is three letters or more; the tail has its font, size and
    baseline and begins where it ends.
    """
    heads = lines.filter(F.trim("text").rlike(r"\A[A-Za-z]{3,}\z"))
    tails = lines.filter(F.col("text").rlike(r"(?U)\A\p{Alpha}{1,2}\z")).withColumn("x1", F.col("x0"))
    ends = heads.withColumn("x0", F.col("x1"))
    near = touching(ends, tails, "x", F.col("size") * 0.2, size)
    gap = F.col("b_x0") - F.col("a_x1")
    fits = (F.col("a_ref") != F.col("b_ref")) & (F.col("a_font") == F.col("b_font")) & (F.abs(F.col("b_size") - F.col("a_size")) < 0.1) & (F.abs(F.col("b_baseline") - F.col("a_baseline")) < 0.1)
    fits &= (gap >= -F.col("a_size") * 0.08) & (gap < F.col("a_size") * 0.12)
    return near.filter(fits).groupBy(F.col("b_page").alias("page"), F.col("b_ref").alias("tail")).agg(F.min("a_ref").alias("head"))


def subscript_lines(lines: DataFrame, glyphs: DataFrame, size: float = 50.0) -> DataFrame:
    """Page and ref of lines of three small letters or more that hang below a larger glyph just before them (``lines``: text, size, baseline, x0)."""
    words = lines.filter(F.trim("text").rlike(r"\A[a-z]{3,}\z")).withColumn("x1", F.col("x0"))
    near = touching(words, glyphs.withColumn("x0", F.col("x1")), "x", F.col("size") * 0.5, size)
    gap, drop = F.col("a_x0") - F.col("b_x1"), F.col("a_baseline") - F.col("b_baseline")
    hangs = (F.col("b_size") > F.col("a_size") * 1.18) & F.col("b_c").rlike(r"(?U)\w") & (gap > -F.col("a_size") * 0.35) & (gap < F.col("a_size") * 0.4) & (drop > F.col("a_size") * 0.1) & (drop < F.col("a_size"))
    return near.filter(hangs).select(F.col("a_page").alias("page"), F.col("a_ref").alias("ref")).distinct()


def underlined(rules: DataFrame, rows: DataFrame, size: float = 100.0) -> DataFrame:
    """(page, rule, row, glyphs): thin rules (ref, box, color) under a text row, the first that fits.

    ``rows`` are glyphs: ref, row, size, baseline, box, color. The rule lies just below the baseline, is thin, covers two glyphs or more
    by nine tenths, ends where they end, and has their colour.
    """
    near = touching(rules, rows, "x", 0.0, size)
    gap = (F.col("a_y0") + F.col("a_y1")) / 2 - F.col("b_baseline")
    near = near.filter((gap >= F.col("b_size") * 0.015) & (gap <= F.col("b_size") * 0.18) & (F.col("a_y1") - F.col("a_y0") <= F.col("b_size") * 0.09) & (common("x") >= (F.col("b_x1") - F.col("b_x0")) * 0.9))
    own = near.groupBy(F.col("a_page").alias("page"), F.col("a_ref").alias("rule"), F.col("b_row").alias("row")).agg(
        F.count("*").alias("glyphs"), F.min("b_x0").alias("lo"), F.max("b_x1").alias("hi"), F.first("a_x0").alias("x0"), F.first("a_x1").alias("x1"), F.max("b_size").alias("size"), F.max(F.abs(F.col("a_color") - F.col("b_color"))).alias("off"),
    )
    tolerance = F.greatest(F.lit(0.75), F.col("size") * 0.075)
    own = own.filter((F.col("glyphs") >= 2) & (F.abs(F.col("x0") - F.col("lo")) <= tolerance) & (F.abs(F.col("x1") - F.col("hi")) <= tolerance) & (F.col("off") <= 0.035))
    return own.groupBy("page", "rule").agg(F.min(F.struct("row", "glyphs")).alias("o")).select("page", "rule", "o.row", "o.glyphs")


def peer_clamped(labels: DataFrame, reach: float, factor: float = 1.5) -> DataFrame:
    """``labels`` (page, ref, box) with boxes much larger than the median of the peers in their column cut to it.

    Peers begin within ``reach`` of the label's left edge, itself included; fewer than three decide nothing.
    """
    edge = labels.select("page", "ref", "x0", F.col("x0").alias("x1"), "y0", "y1", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    near = touching(edge, edge, "x", reach, max(reach, 1.0)).filter(F.abs(F.col("b_x0") - F.col("a_x0")) < reach)
    peers = near.groupBy(F.col("a_page").alias("page"), F.col("a_ref").alias("ref")).agg(F.count("*").alias("n"), F.median("b_w").alias("w"), F.median("b_h").alias("h"), F.median("b_x0").alias("left"))
    own = labels.join(peers, ["page", "ref"], "left")
    large = (F.col("n") >= 3) & ((F.col("x1") - F.col("x0") > F.col("w") * factor) | (F.col("y1") - F.col("y0") > F.col("h") * factor))
    mid = (F.col("y0") + F.col("y1")) / 2
    cut = {"x0": F.col("left"), "y0": mid - F.col("h") / 2, "x1": F.col("left") + F.col("w"), "y1": mid + F.col("h") / 2}
    return own.select(*[F.when(large, cut[c]).otherwise(F.col(c)).alias(c) if c in cut else F.col(c) for c in labels.columns])


def repeated_artwork(images: DataFrame, descriptors: DataFrame, least: int = 3, size: float = 100.0) -> DataFrame:
    """Digests of images on ``least`` pages or more with an institution's name in one of their boxes (digest, ref, page, box; text)."""
    often = images.groupBy("digest").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= least)
    near = touching(descriptors, images, "x", 1.0, size)
    inside = (F.col("b_x0") - 1 <= F.col("a_x0")) & (F.col("b_y0") - 1 <= F.col("a_y0")) & (F.col("a_x1") <= F.col("b_x1") + 1) & (F.col("a_y1") <= F.col("b_y1") + 1)
    named = near.filter(inside & F.col("a_text").rlike(r"(?i)\b(?:university|college|institute)\b|大学|学院")).select(F.col("b_digest").alias("digest")).distinct()
    return often.join(named, "digest", "left_semi")


def quantised_owner(points: DataFrame, owners: DataFrame) -> DataFrame:
    """Points (id, x, y) that lie on an owner (x, y) up to 0.02, both rounded to hundredths."""
    unit = lambda c: F.bround(F.col(c) * 100).cast("long")
    probes = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    own = owners.select(unit("x").alias("o_x"), unit("y").alias("o_y")).distinct()
    near = points.select("*", unit("x").alias("p_x"), unit("y").alias("p_y")).select("*", probes.alias("i")).select("*", probes.alias("j"))
    hit = near.join(own, (F.col("p_x") + F.col("i") == F.col("o_x")) & (F.col("p_y") + F.col("j") == F.col("o_y")), "left_semi")
    return points.join(hit.select("id").distinct(), "id", "left_semi")
