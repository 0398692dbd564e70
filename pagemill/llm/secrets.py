"""Secret scans, DataFrame functions only: fixed patterns, and character Markov models for what they miss.

Two first-order Markov chains over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A candidate run is a secret where the log-likelihood ratio of the two chains favours "random" by a margin:
what one in a thousand ordinary samples held out from training passes, and ``LEAST_MARGIN`` at least.

Without samples of the caller's own, ``labelled`` makes them: random strings drawn by hash over the alphabets that keys are
written in, against identifiers put together from the corpus's words in the styles of code, paths and compounds, numbers and
ruler lines. Neither is what the patterns find. The sample is bounded: ``sample_docs`` documents by the hash of their key,
``sample_tokens`` tokens of each label. The text itself is scanned whole.

All positions are code points, the end exclusive. Defined cases: a null text is empty (no spans), as is an empty one; texts
of any length are scanned in time that grows little faster than their length; ties and repeated rows are scanned row by row;
null keys stand like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.llm._base import Scratch, let, settle

#: Kind, pattern, the group whose length counts, the least length.
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = ("assign", "access", "hex", "markov")
#: What the models judge: unbroken runs of at least so many key characters.
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
_BLOCK = 256
#: The alphabets of random strings.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (_UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_", _LOWER + _DIGITS, _UPPER + _DIGITS, _UPPER + "234567", "0123456789ABCDEF", "0123456789abcdef")
LEAST_MARGIN = 6.0


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it; in blocks, so that the cost stays near linear."""

    def sums(a: Column) -> Column:
        zero = F.struct(F.lit(0).alias("s"), F.expr("cast(array() as array<int>)").alias("a"))
        step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
        return F.aggregate(a, zero, step, lambda acc: acc["a"])

    def blocked(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, _BLOCK))
        total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
        return let(blocks, lambda bs: let(sums(F.transform(bs, total)), lambda off: F.flatten(F.transform(bs, lambda x, i: F.transform(sums(x), lambda y: y + off[i])))))

    return F.when(F.size(a_ := lengths) == 0, F.expr("cast(array() as array<int>)")).when(F.size(a_) <= _BLOCK, sums(a_)).otherwise(blocked(a_))


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<s,e,kind,value>> of the leftmost non-overlapping matches, those too short dropped."""
    k = KINDS.index(kind)
    none = F.expr("cast(array() as array<struct<s:int,e:int,kind:int,value:string>>)")

    def found(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        lengths = F.transform(m, F.length)
        steps = F.zip_with(F.slice(gaps, 1, F.size(m)), lengths, lambda g, n: g + n)
        ends = F.zip_with(_before(steps), steps, lambda b, s: b + s)
        starts = F.zip_with(ends, lengths, lambda e, n: e - n)
        values = F.regexp_extract_all(text, F.lit(pattern), group) if group else m
        rows = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e"), values.alias("v")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("kind"), x["v"].alias("value")))
        return F.filter(rows, lambda x: F.length(x["value"]) >= least)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), 0), found)).otherwise(none)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", run_chars: int = 16) -> DataFrame:
    """Per row: the key, ``base`` (spans of the fixed patterns) and ``runs`` (candidates that touch none of them)."""
    t = F.col("__text")
    df = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    df = df.select(key, F.flatten(F.array(*[_spans(t, *p) for p in PATTERNS])).alias("base"), _spans(t, "markov", RUN % run_chars, 0, run_chars).alias("__all"))
    return df.select(key, F.array_sort("base").alias("base"), _free(F.col("__all"), F.col("base")).alias("runs"))


def _free(runs: Column, base: Column) -> Column:
    """The runs that touch no span of ``base``.

    Of a long ``base`` the spans that begin before a run's end and those that end by its start are counted by halving: if the
    counts are equal, none lies across it.
    """

    def below(ordered: Column, bound: Column) -> Column:
        """How many of ``ordered`` are less than ``bound``."""
        zero = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

        def step(a: Column, _: Column) -> Column:
            mid = F.shiftright(a["lo"] + a["hi"], 1)
            less = F.get(ordered, mid) < bound
            return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(less, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(less, a["hi"]).otherwise(mid).alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), zero, step, lambda a: a["lo"])

    few = F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))
    edge = lambda c: F.array_sort(F.transform(base, lambda b: b[c]))
    many = let(edge("s"), lambda starts: let(edge("e"), lambda ends: F.filter(runs, lambda r: below(starts, r["e"]) == below(ends, r["s"] + 1))))
    return F.when(F.size(base) == 0, runs).when(F.size(base) <= 16, few).otherwise(many)


def random_strings(spark: SparkSession, n: int, seed: int = 0, alphabets: tuple[str, ...] = ALPHABETS) -> DataFrame:
    """(token) ``n`` strings of 16 to 64 characters, drawn by hash from one of the alphabets each."""
    h = lambda *c: F.xxhash64(F.lit(seed), F.col("id"), *c)
    letters = F.element_at(F.array(*map(F.lit, alphabets)), (F.pmod(h(F.lit("a")), F.lit(len(alphabets))) + 1).cast("int"))
    length = (16 + F.pmod(h(F.lit("n")), F.lit(49))).cast("int")
    drawn = let(letters, lambda ls: F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(ls, (F.pmod(h(i), F.length(ls)) + 1).cast("int"), F.lit(1))), ""))
    return spark.range(n).select(drawn.alias("token"))


def identifiers(docs: DataFrame, key: str, text: str, sample_docs: int, n: int, seed: int = 0) -> DataFrame:
    """(token) at most ``n`` identifiers of 16 characters or more, made from words of ``sample_docs`` documents; and numbers and ruler lines."""
    spark = docs.sparkSession
    keys = docs.select(F.col(key).alias("__k")).filter("__k is not null").distinct().withColumn("__h", F.xxhash64("__k")).orderBy("__h", "__k").limit(sample_docs)
    # ``sample_docs`` keys at most
    words = docs.join(F.broadcast(keys), F.col(key) == F.col("__k"), "left_semi").select(F.regexp_extract_all(F.col(text).cast("string"), F.lit(r"(?<!\S)[A-Z]?[a-z]{1,24}(?=[\s.,;:!?]|$)"), 0).alias("w"))
    fours = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1)), F.lit(2)), lambda i: F.slice("w", i, 4))
    four = words.filter(F.size("w") > 0).select(F.explode(fours).alias("w"))
    plain = F.transform("w", F.lower)
    camel = F.transform("w", F.initcap)
    number = F.pmod(F.xxhash64("w"), F.lit(1000)).cast("string")
    forms = F.array(
        F.array_join(plain, "_"), F.array_join(plain, "-"), F.array_join(camel, ""), F.array_join(plain, ""), F.array_join(F.transform("w", F.upper), "_"), F.concat(F.lit("/"), F.array_join("w", "/")),
        F.concat(F.array_join(plain, "_"), F.lit("_"), number), F.concat(F.array_join(camel, ""), number), F.concat(F.array_join("w", "="), F.lit("="), number),
    )
    # a form for each four words, chosen by hash
    made = four.select(F.get(forms, F.pmod(F.xxhash64(F.lit(seed + 2), "w"), F.size(forms)).cast("int")).alias("token")).filter(F.length("token").between(16, 96)).distinct()
    made = made.orderBy(F.xxhash64(F.lit(seed), "token"), "token").limit(n)
    ruler = spark.range(320).select(F.repeat(F.element_at(F.split(F.lit("= - _ / +"), " "), (F.col("id") % 5 + 1).cast("int")), (16 + F.col("id") / 5).cast("int")).alias("token"))
    return made.unionByName(random_strings(spark, n // 10, seed + 1, (_DIGITS,))).unionByName(ruler)


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 2000, sample_tokens: int = 20_000, seed: int = 0) -> DataFrame:
    """Labelled samples (token, random) that do not come from what the patterns find."""
    random = random_strings(docs.sparkSession, sample_tokens, seed).withColumn("random", F.lit(True))
    return random.unionByName(identifiers(docs, key, text, sample_docs, sample_tokens, seed).withColumn("random", F.lit(False)))


@dataclass(frozen=True)
class Model:
    """Ratios by transition, the margin, and on the samples held out the share of random ones found and of others."""

    weights: list[float]
    margin: float
    recall: float
    false_finds: float


def fit(samples: DataFrame, least_margin: float = LEAST_MARGIN) -> Model:
    """Trains on four fifths of the different samples, by their hash, and sets the margin on the rest."""
    samples = settle(samples.select("token", "random").distinct(), "samples")
    held = F.pmod(F.xxhash64("token"), F.lit(5)) == 0
    weights = train(samples.filter(~held))
    scored = settle(samples.filter(held).select("random", llr(F.col("token"), _constant(weights)).alias("x")), "scored")
    margin = max(least_margin, scored.filter(~F.col("random")).agg(F.percentile("x", F.lit(0.999))).first()[0] or 0.0)
    share = scored.groupBy("random").agg(F.avg((F.col("x") > margin).cast("double")).alias("p")).collect()
    shares = {r["random"]: r["p"] for r in share}
    return Model(weights, margin, shares.get(True, 0.0), shares.get(False, 0.0))


def _constant(weights: list[float]) -> Column:
    """A constant of the plan: of fixed size, and no join to bring it in."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, at 128 * previous + next; previous 0 begins a token.

    Chances after a character lean on those of single characters, add-one over 66; what lies outside ASCII counts as 127. The counts come back from one grouped
    sum over all samples: at most 2 x 128 x 128 rows.
    """
    code = lambda c: F.when(F.ascii(c) < 127, F.ascii(c)).otherwise(127)
    codes = F.transform(F.split("token", ""), code)
    pairs = let(codes, lambda a: F.transform(a, lambda c, i: F.coalesce(F.get(a, i - 1), F.lit(0)) * 128 + c))
    counts = samples.filter(F.length("token") > 0).select("random", F.explode(pairs).alias("p")).groupBy("random", "p").count().collect()
    n = {(r["random"], r["p"]): r["count"] for r in counts}
    after: dict[tuple[bool, int], int] = {}
    single: dict[tuple[bool, int], int] = {}
    for (label, p), c in n.items():
        after[label, p // 128] = after.get((label, p // 128), 0) + c
        single[label, p % 128] = single.get((label, p % 128), 0) + c
    total = {label: sum(c for (x, _), c in single.items() if x == label) for label in (True, False)}

    def chance(label: bool, p: int) -> float:
        alone = (single.get((label, p % 128), 0) + 1) / (total[label] + 66)
        return (n.get((label, p), 0) + 5 * alone) / (after.get((label, p // 128), 0) + 5)

    return [math.log(chance(True, p) / chance(False, p)) for p in range(128 * 128)]


def llr(token: Column, model: Column) -> Column:
    """Log-likelihood ratio of ``token``, random over ordinary; ``model`` is an array column."""
    code = lambda c: F.when(F.ascii(c) < 127, F.ascii(c)).otherwise(127)
    codes = F.transform(F.split(token, ""), code)
    zero = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), (a["sum"] + model[a["last"] * 128 + c]).alias("sum"))
    return F.aggregate(codes, zero, step, lambda a: a["sum"])


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, samples: DataFrame | None = None, key: str = "doc_id", text: str = "text", run_chars: int = 16, margin: float | None = None) -> DataFrame:
    """Per row: the key, ``base`` and ``spans`` (base ones and the models'), arrays of (s, e, kind, value) in order.

    Runs score above ``margin``; that of ``fit`` unless one is given.
    """
    scanned = settle(scan(docs, key, text, run_chars), "spans")
    with Scratch(docs.sparkSession, "secrets"):
        model = fit(labelled(docs, key, text) if samples is None else samples)
    weights = _constant(model.weights)
    extra = F.filter("runs", lambda x: llr(x["value"], weights) > (model.margin if margin is None else margin))
    ordered = F.array_sort(F.concat("base", extra))
    return scanned.select(key, "base", F.when(F.size("runs") == 0, F.col("base")).otherwise(ordered).alias("spans"))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of what ``find`` returns."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )

