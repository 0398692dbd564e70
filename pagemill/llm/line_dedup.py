"""Line dedup by a deletion-neighbourhood join: of equal lines, and of lines one character edit apart, the earliest stays.

Lines are compared without the white space around them; blank ones are never touched. Order is (key nulls first, hash of
the document, line number). Equal lines meet on a 128-bit hash. A longer line (``edit_chars`` or more) also goes if an
earlier different line is one insertion, deletion or substitution away:

* every variant with one character deleted is a hashed key; a key holds its place too where it stands for a substitution;
* lines meet in equal keys, where the earliest of a key is enough: each other line of the key is one edit from it;
* what the hashes say is verified by edit distance on the texts.

An earlier line counts even if it went itself, so of a chain of lines that differ by one edit each only the first stays.

Two filters go before, so that only lines with a chance emit variants. Lines one edit apart agree on all but one of any
number of blocks they are cut into, so lines that share no all-but-one combination (first of 2 blocks, then of 16) drop out.
Neither filter loses a pair.

Filters and meeting are one pass each over rows dealt by ranges of (key, line), which split a hot key like any other; what
a range cannot see of its first and last key is kept by the filters, and settled from one row a range in the meeting.

Defined cases: a null or empty text stays as it is; rows that repeat both key and text are one document and fare alike; rows
that repeat only the key are two; ties cannot occur, as the order is total; a text of any length is cut into lines inside its
row, and a line of n characters emits 2n variants in batches of bounded size; an empty table gives an empty result; other
columns pass through whatever their names, scratch columns carry the prefix ``__l_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm._base import Scratch, let, lookup_salted
from pagemill.llm.sharding import number_rows

_SPACE = " \t\r\x0b\x0c"
#: A variant's kind, before its line's rank: the line itself, a variant with its place, a variant alone.
_WHOLE, _PLACED, _SHORT, _KIND = 0, 1, 2, 56
_BATCH = 1 << 16


def _hash(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("__l_a"), F.xxhash64(F.lit(1), text).alias("__l_b")]


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``__l_id``, ``__l_doc``, ``__l_n``, ``__l_line`` and its hash for every line that is not blank."""
    df = docs.select(F.col(key).alias("__l_id"), F.col(text).cast("string").alias("__l_text"))
    df = df.filter(F.col("__l_text").isNotNull()).select("__l_id", F.xxhash64("__l_id", "__l_text").alias("__l_doc"), F.posexplode(F.split("__l_text", "\n")).alias("__l_n", "__l_line"))
    return df.withColumn("__l_line", F.btrim("__l_line", F.lit(_SPACE))).filter("__l_line <> ''").select("*", *_hash(F.col("__l_line")))


def _halves(line: Column) -> Column:
    """Keys of two blocks, as in ``block_keys``."""
    n = F.length(line)
    ls = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")))
    return F.flatten(F.transform(ls, lambda x: F.array(F.xxhash64(F.lit(0), x, line.substr(F.lit(1), x)), F.xxhash64(F.lit(1), x, F.reverse(F.reverse(line).substr(F.lit(1), x))))))


def block_keys(line: str, blocks: int) -> set[tuple]:
    """All-but-one combinations of ``blocks`` blocks: lines one edit apart share at least one.

    Blocks are counted from both ends over an even length, so that lengths that differ by one share a way to cut.
    """
    n, out = len(line), set()
    for half in {n // 2, (n + 1) // 2}:
        edges = [2 * half * j // blocks for j in range(blocks + 1)]
        for j in range(blocks):
            tail = 2 * half - edges[j + 1]
            out.add((half, j, line[: edges[j]], line[max(0, n - tail) :] if tail else ""))
    return out


def _key_rows(lines: DataFrame, blocks: int) -> DataFrame:
    """(key, a, b): hashed ``block_keys`` of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            keys, at = [], []
            for i, line in enumerate(batch.column(2).to_pylist()):
                for half, j, head, tail in block_keys(line, blocks):
                    keys.append(xxh64_intdigest(f"{half}:{j}:{len(head)}:{head}{tail}".encode()))
                    at.append(i)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(0).take(taken), batch.column(1).take(taken)], ["key", "__l_a", "__l_b"])

    return lines.select("__l_a", "__l_b", "__l_line").mapInArrow(run, "key long, __l_a long, __l_b long")


def _sharing(keyed: DataFrame) -> DataFrame:
    """(a, b) of the rows (key, a, b) whose key another row has too, and of the rows at the ends of a range, which may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_hit = None, True  # the last row so far, its fate still open; the first of the range stays
        for batch in batches:
            rows = np.stack([np.asarray(c) for c in batch.columns])
            if not rows.shape[1]:
                continue
            hit = np.zeros(rows.shape[1] + (held is not None), bool)
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            hit[0] = held_hit
            same = rows[0, 1:] == rows[0, :-1]
            hit[1:] |= same
            hit[:-1] |= same
            held, held_hit = rows[:, -1:], bool(hit[-1])
            out = rows[1:, :-1][:, hit[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["__l_a", "__l_b"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2])], ["__l_a", "__l_b"])

    by = ["key", "__l_a", "__l_b"]
    return keyed.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, "__l_a long, __l_b long").distinct()


def deletion_hashes(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """(hash of the whole, hashes with each one code deleted): polynomials modulo 2**64, from one pass of prefix sums."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), base, np.uint64)])
        values = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        sums = np.r_[np.uint64(0), np.cumsum(values * powers[:-1], dtype=np.uint64)]
        inverse = np.uint64(pow(base, -1, 1 << 64))
        return int(sums[-1]), sums[:-1] + (sums[-1] - sums[1:]) * inverse


def _variant_rows(lines: DataFrame) -> DataFrame:
    """(key, code): the hashes of each line and its variants, with their kind and the line's rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(codes))], ["key", "code"])

        keys, codes, size = [], [], 0
        for batch in batches:
            for rank, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
                n = len(chars)
                whole, gone = deletion_hashes(chars)
                with np.errstate(over="ignore"):
                    placed = (gone ^ (gone >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(n, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) + np.uint64(n)
                short = np.unique(gone)
                keys.append(np.concatenate([np.array([whole], np.uint64), placed, short]))
                codes.append(np.repeat(np.array([_WHOLE, _PLACED, _SHORT], np.int64) << _KIND, [1, n, len(short)]) | rank)
                size += len(keys[-1])
                if size >= _BATCH:
                    yield flushed()
                    keys, codes, size = [], [], 0
        if size:
            yield flushed()

    return lines.select("__l_rank", "__l_line").mapInArrow(run, "key long, code long")


def _meet(variants: DataFrame) -> DataFrame:
    """(what, x, y, z) of the meetings in each range of ``variants``.

    0: line of rank x meets the earlier one of rank y; 1: key x and code y of a range's first key, which may have begun in
    the range before; 2: of a range's first and last key x the rank of the line itself (y) and of the first placed one (z).
    """
    mask = (1 << _KIND) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(what: int, *columns) -> pa.RecordBatch:
            x = [np.asarray(c, np.int64) for c in columns]
            x += [np.zeros(len(x[0]), np.int64)] * (3 - len(x))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), what, np.int8)), *map(pa.array, x)], ["what", "x", "y", "z"])

        first = last = None  # key, the line itself, the first placed one; -1 for none
        for batch in batches:
            key, code = (np.asarray(c) for c in batch.columns)
            if not len(key):
                continue
            kind, rank = code >> _KIND, code & mask
            new = np.r_[True, key[1:] != key[:-1]]
            of, at = np.cumsum(new) - 1, np.flatnonzero(new)
            ends = {}
            for k in (_WHOLE, _PLACED):
                own = np.flatnonzero(kind == k)[::-1]
                ends[k] = np.full(len(at), -1)
                ends[k][of[own]] = rank[own]  # of equal places the last assignment holds: the first row
            whole, placed = ends[_WHOLE], ends[_PLACED]
            if last is not None and key[0] == last[0]:
                whole[0], placed[0] = (old if old >= 0 else now for old, now in zip(last[1:], (whole[0], placed[0]), strict=True))
            last = (int(key[-1]), int(whole[-1]), int(placed[-1]))
            if first is None or key[0] == first[0]:
                first = (int(key[0]), int(whole[0]), int(placed[0]))
            is_open = key == first[0]
            if is_open.any():
                yield rows(1, key[is_open], code[is_open])
            one = np.flatnonzero((kind == _PLACED) & ~is_open & (placed[of] < rank))
            two = np.flatnonzero((kind == _SHORT) & ~is_open & (whole[of] >= 0))
            yield rows(0, rank[one], placed[of[one]])
            yield rows(0, np.maximum(rank[two], whole[of[two]]), np.minimum(rank[two], whole[of[two]]))
        if first is not None:
            yield rows(2, *np.array(sorted({first, last})).T)

    dealt = variants.repartitionByRange("key", "code").sortWithinPartitions("key", "code")
    return dealt.mapInArrow(run, "what byte, x long, y long, z long")


def _pairs(met: DataFrame) -> DataFrame:
    """(rank, other): for each line that meets an earlier one the earliest."""
    mask = F.lit((1 << _KIND) - 1)
    some = lambda c: F.min(F.when(F.col(c) >= 0, F.col(c)))
    # two rows a range at most
    ends = met.filter("what = 2").groupBy(F.col("x").alias("key")).agg(some("y").alias("whole"), some("z").alias("placed"))
    left = met.filter("what = 1").join(F.broadcast(ends), F.col("x") == F.col("key"))
    left = left.select(F.shiftright("y", _KIND).alias("kind"), F.col("y").bitwiseAND(mask).alias("r"), F.when(F.shiftright("y", _KIND) == _PLACED, F.col("placed")).when(F.shiftright("y", _KIND) == _SHORT, F.col("whole")).alias("o"))
    left = left.filter((F.col("o") < F.col("r")) | ((F.col("kind") == _SHORT) & (F.col("o") > F.col("r"))))
    met = met.filter("what = 0").select(F.col("x").alias("rank"), F.col("y").alias("other"))
    met = met.unionByName(left.select(F.greatest("r", "o").alias("rank"), F.least("r", "o").alias("other")))
    return met.groupBy("rank").agg(F.min("other").alias("other"))


def _texts(docs: DataFrame, some: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, at, line) of the lines ``some`` (a, b, at), each taken from its first place.

    The texts go to the places by their documents' hash, in one plan at every size, as no bound on ``some`` is known.
    """
    wanted = some.groupBy(F.col("at.__l_doc").alias("__l_of")).agg(F.collect_list(F.struct(F.col("at"), "__l_a", "__l_b")).alias("__l_some"))
    own = docs.select(F.col(key).alias("__l_id"), F.col(text).cast("string").alias("__l_text")).filter(F.col("__l_text").isNotNull())
    own = own.withColumn("__l_doc", F.xxhash64("__l_id", "__l_text")).join(wanted.hint("merge"), F.col("__l_doc") == F.col("__l_of"))
    # one row of rows that repeat key and text
    pick = let(F.split("__l_text", "\n"), lambda ls: F.transform("__l_some", lambda x: F.struct(x["__l_a"].alias("__l_a"), x["__l_b"].alias("__l_b"), x["at"].alias("at"), F.btrim(ls[x["at"]["__l_n"]], F.lit(_SPACE)).alias("__l_line"))))
    return own.select(F.explode(pick).alias("x")).select("x.*").dropDuplicates(["__l_a", "__l_b"])


def near(docs: DataFrame, firsts: DataFrame, key: str, text: str, edit_chars: int, scratch: Scratch) -> DataFrame:
    """Hashes of lines that are one edit from an earlier line. ``firsts``: hash, ``at`` (its first place), and the halves' keys."""
    halves = firsts.filter("halves is not null").select("__l_a", "__l_b", F.explode("halves").alias("key"))
    some = scratch.settle(_sharing(halves), "lines")
    some = scratch.settle(firsts.select("__l_a", "__l_b", "at").join(some.hint("merge"), ["__l_a", "__l_b"], "left_semi"), "lines")
    lines = scratch.settle(_texts(docs, some, key, text), "line-texts")
    scratch.drop(some)
    keyed = scratch.settle(_key_rows(lines, 16), "line-keys")
    lines = scratch.settle(lines.join(_sharing(keyed).hint("merge"), ["__l_a", "__l_b"], "left_semi").select("__l_a", "__l_b", "at.*", "__l_line"), "line-texts")
    scratch.drop(keyed)
    lines, _ = number_rows(lines, ["__l_id", "__l_doc", "__l_n"], "__l_rank")
    lines = scratch.settle(lines.select("__l_rank", "__l_a", "__l_b", "__l_line"), "ranked")
    met = scratch.settle(_meet(scratch.settle(_variant_rows(lines), "variants")), "met")
    other = lines.select(F.col("__l_rank").alias("other"), F.col("__l_line").alias("o_line"))
    checked = _pairs(met).join(lines, F.col("rank") == F.col("__l_rank")).join(other, "other")
    return checked.filter(F.levenshtein("__l_line", "o_line", 1).between(0, 1)).select("__l_a", "__l_b")


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", edit_chars: int = 16) -> DataFrame:
    """``__l_id``, ``__l_doc`` and the sorted arrays ``same`` and ``near`` of line numbers to remove, for documents that have any; a settled table."""
    with Scratch(docs.sparkSession, "line-dedup") as scratch:
        lines = lines_of(docs, key, text)
        at = F.struct("__l_id", "__l_doc", "__l_n")
        places = scratch.settle(lines.select("__l_id", "__l_doc", "__l_n", "__l_a", "__l_b", F.when(F.length("__l_line") >= edit_chars, _halves(F.col("__l_line"))).alias("halves")), "line-places")
        firsts = scratch.settle(places.groupBy("__l_a", "__l_b").agg(F.min(at).alias("at"), F.count("*").alias("n"), F.first("halves").alias("halves")), "line-firsts")
        with Scratch(docs.sparkSession, "near") as inner:
            close = inner.keep(near(docs, firsts, key, text, edit_chars, inner), "near")
        fate = firsts.join(close.withColumn("near", F.lit(True)).hint("merge"), ["__l_a", "__l_b"], "left").filter("n > 1 or near")
        # by one column; a hash that two lines share is told apart by the other half
        fate = scratch.settle(fate.groupBy("__l_a").agg(F.collect_list(F.struct("__l_b", "at", F.coalesce("near", F.lit(False)).alias("near"))).alias("fates"), F.sum("n").alias("n")), "fates")
        scratch.drop(firsts)
        hit = lookup_salted(places.select("__l_id", "__l_doc", "__l_n", "__l_a", "__l_b"), fate, "__l_a", "n", hint="merge").filter("fates is not null")
        hit = hit.withColumn("fate", F.filter("fates", lambda x: x["__l_b"] == F.col("__l_b"))[0]).filter("fate is not null")
        same = ~F.expr("fate.at <=> struct(__l_id as __l_id, __l_doc as __l_doc, __l_n as __l_n)")
        hit = hit.select("__l_id", "__l_doc", "__l_n", (same & ~F.col("fate.near")).alias("same"), F.col("fate.near").alias("near")).filter("same or near")
        numbers = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("__l_n")))).alias(c)
        return scratch.keep(hit.groupBy("__l_id", "__l_doc").agg(numbers("same"), numbers("near")), "removals")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", edit_chars: int = 16) -> DataFrame:
    """All rows with ``text`` rid of its repeated lines, and the counts ``__l_lines``, ``__l_same``, ``__l_near``."""
    gone = removals(docs, key, text, edit_chars).select(F.col("__l_id").alias("__l_id2"), F.col("__l_doc").alias("__l_doc2"), "same", "near")
    own = docs.select(F.struct("*").alias("__l_row"), F.col(key).alias("__l_id"), F.col(text).cast("string").alias("__l_text"))
    own = own.withColumn("__l_doc", F.xxhash64("__l_id", "__l_text"))
    df = own.join(gone.hint("merge"), (F.col("__l_doc") == F.col("__l_doc2")) & F.col("__l_id").eqNullSafe(F.col("__l_id2")), "left")
    lines = F.split("__l_text", "\n")
    drop = F.concat("same", "near")
    kept = F.when(F.col("same").isNull(), F.col("__l_text")).otherwise(_without(F.col("__l_text"), drop))
    count = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(_SPACE)) != "")).cast("long")
    columns = [(kept if c == text else F.col(f"__l_row.`{c}`")).alias(c) for c in docs.columns]
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return df.select(*columns, F.when(F.col("__l_text").isNull(), 0).otherwise(count).alias("__l_lines"), size("same").alias("__l_same"), size("near").alias("__l_near"))


def _without(text: Column, numbers: Column) -> Column:
    """``text`` without the lines of these numbers."""
    whole = F.transform(F.array(F.split(text, "\n")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), numbers), lambda i: x[i]), "\n"))
    return whole[0]


def keep_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edit_chars: int = 16) -> DataFrame:
    """``docs`` with their remaining lines. A document all of whose lines went stood elsewhere before, and goes too."""
    df = dedup(docs, key, text, edit_chars)
    return df.filter("__l_lines = 0 or __l_lines > __l_same + __l_near").select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", edit_chars: int = 16) -> DataFrame:
    """Per row: the key, lines, lines removed as equal and as near, and the SHA-256 of what remains."""
    df = dedup(docs.select(F.col(key), F.col(text)), key, text, edit_chars)
    return df.select(key, F.col("__l_lines").alias("n_lines"), F.col("__l_same").alias("n_same"), F.col("__l_near").alias("n_near"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
