"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at ``bits`` or fewer differing bits. They are cut into ``bits // 2 + 1`` segments, so that of two linked
ones at least one segment differs by one bit at most. Each segment is indexed under every variant with one bit made a
wildcard; equal variants meet in an equality join and the pair is verified on all 64 bits. A pair is reported under the
first variant its fingerprints share, so only once.

No pairs are emitted within a group before it is contracted: variants are first dealt out by (variant, fingerprint) ranges,
which no hot variant can fill, and each fingerprint is tied to the few before it in its run. The components of these ties
label the fingerprints; heavy variants whose fingerprints all have one label drop out, and the join keeps only pairs of
different labels. Equal fingerprints count once throughout.

Defined cases: a null, empty or wordless text has fingerprint zero and links like any other; a text of any length is hashed
whole, its shingles' bits counted in blocks of bounded size; ties and repeated rows share their component; null keys never
serve as component id unless there is no other; an empty table gives an empty result; ``keep_first`` passes other columns
through whatever their names, ``group`` and ``report`` ignore them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.llm._base import Scratch, lookup_salted

SEED = 42


def fingerprint(text: str | None, n: int = 4) -> int:
    """64 bits, signed: a bit is set where over half of the shingles' XXH64 have it; repeats count."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[n:], strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4) -> DataFrame:
    """The key and ``fp`` (long) of every row."""
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), n) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], [key, "fp"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by one bit at most."""
    m = bits // 2 + 1
    edges = [round(64 * k / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(bits: int) -> list[tuple[int, int]]:
    """(the bits that a variant keeps, its number in the room that another segment leaves free), for each variant."""
    out = []
    parts = segments(bits)
    for k, (first, width) in enumerate(parts):
        whole, free = ((1 << width) - 1) << first, parts[k - 1][0]
        out += [(_long(whole & ~(1 << (first + i))), _long((len(out) + i) << free)) for i in range(width)]
    return out


def variants(fps: DataFrame, bits: int) -> DataFrame:
    """``fps`` with ``variant`` and ``key``, once for each one-wildcard variant of each segment.

    ``key`` holds what the variant keeps of the fingerprint, and the variant's number.
    """
    masks = F.array(*[F.struct(F.lit(v).cast("byte").alias("v"), F.lit(m).cast("long").alias("m"), F.lit(t).cast("long").alias("t")) for v, (m, t) in enumerate(_masks(bits))])
    key = F.col("fp").bitwiseAND(F.col("__m.m")).bitwiseOR(F.col("__m.t"))
    return fps.select("*", F.explode(masks).alias("__m")).select(*fps.columns, F.col("__m.v").alias("variant"), key.alias("key"))


def _first_shared(variant: Column, x: Column, bits: int) -> Column:
    """Whether ``variant``, shared by fingerprints that differ by ``x``, is the first they share."""
    out, earlier, at = F.lit(False), F.lit(True), 0
    for first, width in segments(bits):
        part = x.bitwiseAND(F.lit(_long(((1 << width) - 1) << first)))
        out |= variant.between(at, at + width - 1) & earlier & ((part != 0) | (variant == at))
        earlier &= F.bit_count(part) > 1
        at += width
    return out


def _ties(keyed: DataFrame, bits: int) -> DataFrame:
    """(a, b) of close fingerprints that are neighbours in a run of one variant, or in a long run close to its head."""

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x ^ y).view(np.uint64)) <= bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            key, fp = (np.asarray(c) for c in batch.columns)
            if not len(fp):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(fp)])
            i = np.flatnonzero(key[1:] == key[:-1])
            i = i[close(fp[i], fp[i + 1])]
            out_a, out_b = [fp[i]], [fp[i + 1]]
            goes_on = key[0] == last
            for j in sorted({*np.flatnonzero(size >= 32).tolist(), *([0] if goes_on else [])}):
                own = fp[starts[j] : starts[j] + size[j]]
                for p in heads if j == 0 and goes_on else own[:4]:
                    near = own[close(own, p) & (own != p)]
                    out_a.append(np.full(len(near), p))
                    out_b.append(near)
            if not (goes_on and len(starts) == 1):
                heads = fp[starts[-1] :][:4].copy()
            last = key[-1]
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = keyed.select("key", "fp").repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, label) for every end of ``edges`` (a, b), a settled table; the label is the smallest end of its component.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until nothing changes; each step drops
    the table of the one before.
    """
    with Scratch(edges.sparkSession, "components") as scratch:
        edges = scratch.settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")

        def state(df: DataFrame) -> tuple:
            return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

        was, now = None, state(edges)
        while now[0] and now != was:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").distinct()
            # small star: every larger end, its smaller neighbours and itself meet at the smallest of them
            low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
            joined = large.join(low, F.col("b") == F.col("u"))
            small = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
            last, edges = edges, scratch.settle(small, "edges")
            scratch.drop(last)
            was, now = now, state(edges)
        return scratch.keep(edges.select(F.col("b").alias("fp"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("fp"), F.col("a").alias("label"))).distinct(), "labels")


def links(fps: DataFrame, bits: int = 4, hot: int = 256) -> DataFrame:
    """A set of links (a, b) between different fingerprints whose components are those of all links; a settled table.

    In a variant of more than ``hot`` fingerprints, those of its most frequent label are not compared with each other.
    """
    with Scratch(fps.sparkSession, "links") as scratch:
        ties = scratch.settle(_ties(variants(fps.select("fp"), bits), bits), "ties")
        labels = components(ties)
        named = scratch.settle(fps.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "named")
        keyed = variants(named, bits)
        heavy = keyed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter(F.col("n") > hot)
        heavy = scratch.settle(heavy, "heavy")

        def joined(left: DataFrame, right: DataFrame, more: Column | None) -> DataFrame:
            a, b = (df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for s, df in (("a", left), ("b", right)))
            x = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
            on = (F.col("a_key") == F.col("b_key")) & (F.col("a_label") != F.col("b_label")) & (F.bit_count(x) <= bits)
            # of both sides, which then have the same columns and share one exchange
            on &= _first_shared(F.greatest("a_variant", "b_variant").cast("int"), x, bits) & more
            return a.join(b.hint("merge"), on).select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b"))

        few = keyed.join(heavy.select("key"), "key", "left_anti")
        # a heavy variant of one label holds no link that matters
        many = keyed.join(heavy.filter("lo < hi").select("key"), "key", "left_semi")
        most = many.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.sum("c").alias("n"))
        many = scratch.settle(lookup_salted(many.select("key", "variant", "fp", "label"), most, "key", "n"), "hot")
        minor = many.filter("label <> top")
        apart = (F.col("b_label") == F.col("b_top")) | (F.col("a_fp") < F.col("b_fp"))
        return scratch.keep(ties.unionByName(joined(few, few, F.col("a_fp") < F.col("b_fp"))).unionByName(joined(minor, many, apart)), "links")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """The key, ``fp`` and ``component_id`` (the smallest key reachable over links) of every row; a settled table."""
    with Scratch(docs.sparkSession, "simhash") as scratch:
        rows = scratch.settle(fingerprints(docs, key, text), "fps")
        fps = scratch.settle(rows.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "distinct")
        labels = components(links(fps, bits))
        named = scratch.settle(fps.join(labels, "fp", "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label")), "named")
        first = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
        member = lookup_salted(named.select("fp", "n", "label"), first, "label", "m")
        return scratch.keep(lookup_salted(rows, member.select("fp", "n", "component_id"), "fp", "n"), "groups")


def report(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, the fingerprint as 16 hexadecimal digits, and the component."""
    return grouped.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """One row of each component stays: that with the smallest key; of rows that repeat the key, one.

    Rows with a null key stay, as nothing tells which of them came first.
    """
    first = group(docs, key, text, bits).filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("__s_first")).distinct()
    own = docs.select(F.struct("*").alias("__s_row"), F.col(key).alias("__s_key"), F.xxhash64(F.col(text).cast("string")).alias("__s_hash"))
    kept = own.join(first, F.col("__s_key") == F.col("__s_first"), "left_semi")
    kept = kept.withColumn("__s_at", F.row_number().over(Window.partitionBy("__s_key").orderBy("__s_hash"))).filter("__s_at = 1")
    return kept.unionByName(own.filter(F.col("__s_key").isNull()).withColumn("__s_at", F.lit(1))).select(*[F.col(f"__s_row.`{c}`") for c in docs.columns])
