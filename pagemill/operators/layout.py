"""Order-dependent layout: rows, visual lines, shadows, copies and clusters, page by page.

Each of these decides about an object by what was decided about others before, which no window or join can say. A page's
objects are few, so a page is one call of ``applyInPandas``; pages are dealt over tasks by their key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions import text as X


def _by_page(df: DataFrame, f: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        page = frame["page"].iloc[0]
        return pd.DataFrame([(page, *x) for x in f(frame.to_dict("records"))], columns=["page", *names])

    kind = df.schema["page"].dataType.simpleString()
    return df.groupBy("page").applyInPandas(run, f"page {kind}, {schema}")


def rows_of(glyphs: DataFrame) -> DataFrame:
    """(page, ref, row, place): glyphs (ref, x, baseline, size) in rows from the top, places from the left.

    The largest glyphs come first and found rows; another joins the nearest row whose founder's baseline is less than 0.6 of its size away.
    """

    def one(own: list[dict]) -> Iterator[tuple]:
        rows: list[list[dict]] = []
        for g in sorted(own, key=lambda g: (-g["size"], g["ref"])):
            off = [(abs(r[0]["baseline"] - g["baseline"]), k) for k, r in enumerate(rows) if abs(r[0]["baseline"] - g["baseline"]) < r[0]["size"] * 0.6]
            if off:
                rows[min(off)[1]].append(g)
            else:
                rows.append([g])
        for k, row in enumerate(sorted(rows, key=lambda r: r[0]["baseline"])):
            for place, g in enumerate(sorted(row, key=lambda g: g["x"])):
                yield g["ref"], k, place

    return _by_page(glyphs, one, "ref long, row int, place int")


def visual_lines(glyphs: DataFrame) -> DataFrame:
    """(page, line, text): upright lines as they are seen, from drawing objects (``glyphs``: line, seq, c, x0, x1, x, baseline, size).

    A small line of letters and digits goes to the nearest larger one it stands beside, as its script. Lines on one baseline and of one
    size are joined where they are neither far apart nor far over each other, to the last that fits. Between pieces of a line that are
    apart a blank is put in. ``line`` is the smallest number of what a line is made of.
    """

    def one(own: list[dict]) -> Iterator[tuple]:
        lines: dict[int, dict] = {}
        for g in sorted(own, key=lambda g: (g["line"], g["seq"])):
            lines.setdefault(g["line"], {"order": g["line"], "glyphs": []})["glyphs"].append(g)
        for r in lines.values():
            r["size"] = max(g["size"] for g in r["glyphs"])
            main = [g["baseline"] for g in r["glyphs"] if g["size"] >= r["size"] * 0.85 and not g["c"].isspace()]
            r["baseline"] = median(main or [g["baseline"] for g in r["glyphs"]])
            r["x0"], r["x1"] = min(g["x0"] for g in r["glyphs"]), max(g["x1"] for g in r["glyphs"])
        left = list(lines.values())

        def absorb(into: dict, r: dict) -> None:
            into["glyphs"] = into["glyphs"] + r["glyphs"]
            into["x0"], into["x1"], into["order"] = min(into["x0"], r["x0"]), max(into["x1"], r["x1"]), min(into["order"], r["order"])

        for small in sorted(left, key=lambda r: r["size"]):
            if all(g["c"].isalnum() for g in small["glyphs"]):
                bases = [
                    (abs(small["baseline"] - r["baseline"]), k) for k, r in enumerate(left)
                    if r is not small and r["size"] > small["size"] * 1.18 and 0.12 * r["size"] < abs(small["baseline"] - r["baseline"]) < 0.75 * r["size"]
                    and any(g["c"].isalnum() and g["size"] >= r["size"] * 0.85 and -0.2 * r["size"] <= small["x0"] - g["x1"] <= 0.4 * r["size"] for g in r["glyphs"])
                ]
                if bases:
                    absorb(left[min(bases)[1]], small)
                    left = [r for r in left if r is not small]
        joined: list[dict] = []
        for r in sorted(left, key=lambda r: (r["baseline"], r["x0"])):
            for into in reversed(joined):
                larger = max(into["size"], r["size"])
                level = abs(into["baseline"] - r["baseline"]) < larger * 0.12 and abs(into["size"] - r["size"]) < larger * 0.15
                if level and -0.6 * r["size"] <= r["x0"] - into["x1"] <= 0.65 * r["size"]:
                    absorb(into, r)
                    break
            else:
                joined.append(r)
        for r in sorted(joined, key=lambda r: r["order"]):
            text, last = "", None
            for g in sorted(r["glyphs"], key=lambda g: g["x"]):
                apart = last is not None and last["line"] != g["line"] and not last["c"].isspace() and not g["c"].isspace()
                if apart and g["x0"] - last["x1"] > r["size"] * 0.18 and abs(g["baseline"] - last["baseline"]) < r["size"] * 0.12:
                    text += " "
                text += g["c"]
                last = g
            yield r["order"], text

    return _by_page(glyphs, one, "line long, text string")


def shadows(glyphs: DataFrame) -> DataFrame:
    """(page, ref, of): glyphs (ref in order, c, font, size, color, box) that another draws again, with that one.

    A shadow is a gray copy of a darker glyph, or a copy of an earlier one of the same colour; their edges are at most 0.13 of the size
    apart, and 3 at most. It goes to the nearest; what is a shadow itself has none.
    """

    def one(own: list[dict]) -> Iterator[tuple]:
        own = sorted(own, key=lambda g: g["ref"])
        alike: dict[tuple, list[int]] = {}
        rgb = [[g["color"] >> s & 255 for s in (16, 8, 0)] for g in own]
        for i, g in enumerate(own):
            alike.setdefault((g["c"].casefold(), g["font"], round(g["size"], 1)), []).append(i)
        gone: set[int] = set()
        for i, g in enumerate(own):
            gray, best = max(rgb[i]) - min(rgb[i]) <= 2 and 96 <= rgb[i][0] <= 225, []
            for j in alike[g["c"].casefold(), g["font"], round(g["size"], 1)]:
                o = own[j]
                if j == i or j in gone or abs(o["size"] - g["size"]) > 0.1:
                    continue
                again = o["color"] == g["color"] and o["c"] == g["c"] and j < i
                apart = [abs(o[e] - g[e]) for e in ("x0", "y0", "x1", "y1")]
                if (again or (gray and sum(rgb[j]) < sum(rgb[i]))) and max(apart) <= min(3, g["size"] * 0.13):
                    best.append((sum(apart), j))
            if best:
                gone.add(i)
                yield g["ref"], own[min(best)[1]]["ref"]

    return _by_page(glyphs, one, "ref long, of long")


def text_copies(regions: DataFrame) -> DataFrame:
    """(page, ref, of): regions (ref in order, text, box) that repeat the beginning of a longer one over the same place, with that one.

    Longest first; white space and case do not count; the boxes share over 0.8 of the smaller. What is a copy itself has none.
    """

    def one(own: list[dict]) -> Iterator[tuple]:
        stay: list[tuple[dict, str]] = []
        for r in sorted(own, key=lambda r: (-len(r["text"]), r["ref"])):
            bare = "".join(r["text"].split()).casefold()
            area = (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
            for o, text in stay:
                w, h = min(r["x1"], o["x1"]) - max(r["x0"], o["x0"]), min(r["y1"], o["y1"]) - max(r["y0"], o["y0"])
                if text.startswith(bare) and max(w, 0) * max(h, 0) > 0.8 * min(area, (o["x1"] - o["x0"]) * (o["y1"] - o["y0"])):
                    yield r["ref"], o["ref"]
                    break
            else:
                stay.append((r, bare))

    return _by_page(regions, one, "ref long, of long")


def patch_clusters(patches: DataFrame) -> DataFrame:
    """(page, ref, cluster): patches (ref in order, box) that meet, directly or through the box around those that met before.

    ``cluster`` is the number of the first patch in it.
    """

    def one(own: list[dict]) -> Iterator[tuple]:
        clusters: list[tuple[list[float], list[int]]] = []
        for r in sorted(own, key=lambda r: r["ref"]):
            box, refs, apart = [r["x0"], r["y0"], r["x1"], r["y1"]], [r["ref"]], []
            for b, others in clusters:
                if min(box[2], b[2]) > max(box[0], b[0]) and min(box[3], b[3]) > max(box[1], b[1]):
                    box = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
                    refs = refs + others
                else:
                    apart.append((b, others))
            clusters = [*apart, (box, refs)]
        for _, refs in clusters:
            for ref in refs:
                yield ref, min(refs)

    return _by_page(patches, one, "ref long, cluster long")


def chunk_numbers(lines: DataFrame, page: str, order: str) -> DataFrame:
    """``lines`` (text, bullet, heading, keyed, size, x0, y0) with ``chunk``: a new one begins at a bullet, a shift of more than three sizes
    (40 at least), a gap of more than 2.1, a second keyed row, and in headings a change of size by a fifth. Blank lines are left out.
    """
    own = lines.filter(X.strip(F.col("text")) != "")
    w = Window.partitionBy(page).orderBy(order)
    was = lambda c: F.lag(c).over(w)
    column = F.abs(F.col("x0") - was("x0")) > F.greatest(F.lit(40.0), F.col("size") * 3)
    gap = F.col("y0") - was("y0") > F.col("size") * 2.1
    size = F.col("heading") & (F.abs(F.col("size") - was("size")) > F.greatest("size", was("size")) * 0.2)
    opens = F.coalesce(F.col("bullet") | column | gap | (F.col("keyed") & was("keyed")) | size, F.lit(True)) | was("x0").isNull()
    marked = own.withColumn("__opens", opens.cast("int"))
    return marked.withColumn("chunk", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def spaced_text(glyphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, text): glyphs (c, x0, x1, baseline, size, piece) joined in order, a blank where another piece begins apart from the last."""
    w = Window.partitionBy(*keys).orderBy(order)
    was = lambda c: F.lag(c).over(w)
    blank = lambda c: c.rlike(r"(?U)\A\s\z")
    apart = (was("piece") != F.col("piece")) & ~blank(was("c")) & ~blank(F.col("c")) & (F.col("x0") - was("x1") > F.col("size") * 0.18) & (F.abs(F.col("baseline") - was("baseline")) < F.col("size") * 0.12)
    own = glyphs.withColumn("__s", F.concat(F.when(apart, " ").otherwise(""), "c"))
    return own.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__s"))), lambda x: x["__s"]), "").alias("text"))


def continuations(regions: DataFrame, page: str, order: list[str], width: float) -> DataFrame:
    """(page, first, next): neighbours in reading order of which the second, indented, goes on a full-width sentence of the first.

    ``regions``: ref, text, size, box. The first has over 75 characters, no end mark, and reaches 0.9 of the width.
    """
    w = Window.partitionBy(page).orderBy(*order)
    nxt = lambda c: F.lead(c).over(w)
    goes_on = (F.length("text") > 75) & ~F.col("text").rlike(r"[.;:!?]\z") & nxt("text").rlike(r"\A[a-z]") & (F.col("x1") > width * 0.9)
    goes_on &= (F.col("x0") <= nxt("x0")) & (nxt("x0") < F.col("x0") + F.col("size") * 6) & (F.abs(F.col("size") - nxt("size")) < 0.5)
    drop = nxt("y0") - F.col("y0")
    goes_on &= (drop > F.col("size") * 0.65) & (drop < F.col("size") * 1.5)
    return regions.select(page, F.col("ref").alias("first"), nxt("ref").alias("next"), goes_on.alias("__on")).filter("__on").drop("__on")


def page_style(glyphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per region its box, the median of its sizes, and the most frequent style (color, bold, italic), the first met of equals."""
    box = glyphs.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.median("size").alias("size"))
    counts = glyphs.groupBy(*keys, "color", "bold", "italic").agg(F.count("*").alias("n"), F.min(order).alias("at"))
    style = counts.groupBy(*keys).agg(F.min_by(F.struct("color", "bold", "italic"), F.struct(-F.col("n"), "at")).alias("s"))
    return box.join(style, keys).select(*keys, "x0", "y0", "x1", "y1", "size", "s.color", "s.bold", "s.italic")


def style_lines(phrases: DataFrame, lines: DataFrame, most: int = 6) -> DataFrame:
    """(page, phrase, first, end): the first run of up to ``most`` lines (page, ref from 0 without gaps, text) that is a phrase but for white space."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    w = Window.partitionBy("page").orderBy("ref")
    own = lines.select("page", F.col("ref").alias("first"), F.collect_list(bare(F.col("text"))).over(w.rowsBetween(0, most - 1)).alias("next"))
    spans = own.select("page", "first", F.posexplode(F.transform("next", lambda _, i: F.array_join(F.slice("next", F.lit(1), i + 1), ""))).alias("k", "t"))
    spans = spans.select("page", "first", (F.col("k") + 1).alias("n"), "t")
    found = phrases.select("page", "phrase", bare(F.col("source")).alias("t")).join(spans, ["page", "t"])
    return found.groupBy("page", "phrase").agg(F.min(F.struct("first", "n")).alias("o")).select("page", "phrase", "o.first", (F.col("o.first") + F.col("o.n")).alias("end"))


def orphan_pages(lines: DataFrame, page: str, order: str) -> DataFrame:
    """Pages of more than one line whose last is a single ideograph."""
    last = lines.groupBy(page).agg(F.count("*").alias("n"), F.max_by("text", order).alias("last"))
    return last.filter((F.col("n") > 1) & X.strip(F.col("last")).rlike(r"\A[㐀-鿿]\z")).select(page)


def context(pages: DataFrame, descriptors: DataFrame, page: str) -> DataFrame:
    """(page, context): a page's text and what its descriptors (ord, text, native) say that the text at their place does not."""
    tight = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    extra = descriptors.filter((tight(F.col("text")) != "") & ~F.contains(tight(F.col("native")), tight(F.col("text"))))
    extra = extra.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("extra"))
    more = F.when(F.col("extra").isNotNull(), F.concat(F.lit("\nAdditional text from document structure and figures:\n"), "extra")).otherwise("")
    return pages.join(extra, page, "left").select(page, F.concat(X.squeeze_context(F.col("text")), more).alias("context"))


def anchored_runs(words: DataFrame, keys: list[str], order: str, anchors: Column, score: float = 0.94) -> DataFrame:
    """Runs of well-read words (text, score, box) of a line that hold one of ``anchors`` (an array), with their box and text.

    A word counts if it is two letters or more, not all capitals, with one mark behind it at most.
    """
    good = (F.col("score") >= score) & F.col("text").rlike(r"\A[A-Za-z]{2,}[.,:!?]?\z") & (F.upper("text") != F.col("text"))
    w = Window.partitionBy(*keys).orderBy(order)
    run = F.sum(F.when(good, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = words.withColumn("run", run).filter(good).withColumn("__anchor", F.array_contains(anchors, F.lower(F.regexp_replace("text", r"\A[.,:!?]+|[.,:!?]+\z", ""))))
    out = own.groupBy(*keys, "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"), F.bool_or("__anchor").alias("__any"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return out.filter("__any").drop("__any", "run")
