"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = s(t_k - w.x): one weight vector over hashed text features shared by all grades, and ordered thresholds
t_0 < t_1 < ... Features are the distinct tokens of a text, their first four bytes, and the shape of what stands between
tokens, hashed into ``2**hash_bits`` places, and ranges of a few ratios of the whole text. Whole texts are read.

``fit`` takes at most ``train_rows`` labelled rows, those with the smallest hash of key and grade, then of the smallest grade
and features; only features of at least
``least_docs`` of these get a weight. The fit runs in one task over that bounded sample. ``score`` gives each row its
expected grade and its tail probability P(grade >= keep_grade), by which rows are selected.

Defined cases: a null text has no tokens and is scored by the ratios of an empty text; a very long one is read alone; null labels are left out; repeated
rows are scored alike, and count as often as they stand in the labels; without labels, or with labels of one grade only,
weights are zero and thresholds those of the smoothed frequencies; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm._words import blocks, hashes, joined, runs

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>!@^~+=_{}[]\\/")] = True
_RANGES = 10
_RATIOS = 5


def features(texts: list[str], hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every different feature of each text, in order of text."""
    data, starts = joined(texts)
    n, size = len(texts), 1 << hash_bits
    first, end = runs(_TOKEN[data])
    text = np.searchsorted(starts, first, "right") - 1
    h = hashes(data, first, end)
    long = end - first > 4
    prefix = hashes(data, first[long], first[long] + 4) ^ np.uint64(0x5555)
    out_a, out_b = runs((data > 32) & ~_TOKEN[data])
    shape = hashes(data, out_a, out_b, fold=False) ^ np.uint64(0xAAAA)
    own = [(text, h), (text[long], prefix), (np.searchsorted(starts, out_a, "right") - 1, shape)]
    pairs = np.unique(np.concatenate([(t.astype(np.int64) << hash_bits) | (x >> np.uint64(64 - hash_bits)).astype(np.int64) for t, x in own]))
    at, feature = pairs >> hash_bits, pairs & (size - 1)

    # ratios: different tokens to tokens, capitals, marks and digits to bytes, and the length
    edges = np.r_[starts, len(data)]
    count = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][edges])
    length = np.maximum(np.diff(edges) - 1, 1)
    tokens = np.bincount(text, minlength=n)
    different = np.bincount(np.unique((text.astype(np.int64) << 44) | (h >> np.uint64(20)).astype(np.int64)) >> 44, minlength=n)
    richness = different / np.maximum(tokens, 1) * np.log1p(np.maximum(tokens, 1)) / 6
    ratios = [richness, count(_UPPER[data]) / length * 2, count(_MARK[data]) / length * 4, count((data >= 48) & (data < 58)) / length * 4, np.log2(length) / 20]
    more = [size + k * _RANGES + np.clip((r * _RANGES).astype(np.int64), 0, _RANGES - 1) for k, r in enumerate(ratios)]
    at = np.concatenate([at, *[np.arange(n)] * _RATIOS])
    feature = np.concatenate([feature, *more])
    order = np.argsort(at, kind="stable")
    return at[order], feature[order]


def _s(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_arrays(at: np.ndarray, feature: np.ndarray, grades: np.ndarray, size: int, n_grades: int, least_docs: int = 5, decay: float = 4e-4, steps: int = 250, balance: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the mean negative log-likelihood with weight decay.

    Rows count by their grade's share to the power ``-balance``, so that rare grades are heard.
    """
    n = len(grades)
    w = np.zeros(size)
    shares = np.cumsum(np.bincount(grades, minlength=n_grades)[:-1] + 1) / (n + n_grades)
    t = np.log(shares / (1 - shares))
    if n == 0 or len(np.unique(grades)) < 2:
        return w, t
    used = np.bincount(feature, minlength=size) >= least_docs
    keep = used[feature]
    at, feature = at[keep], feature[keep]
    ids, feature = np.unique(feature, return_inverse=True)
    v = np.zeros(len(ids))
    gaps = np.log(np.maximum(np.diff(t), 1e-3))
    theta = np.concatenate([v, t[:1], gaps])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    share = np.bincount(grades, minlength=n_grades)[grades] / n
    row = share**-balance
    row /= row.sum()
    for step in range(1, steps + 1):
        v, t = theta[: len(ids)], theta[len(ids)] + np.r_[0, np.cumsum(np.exp(theta[len(ids) + 1 :]))]
        z = np.bincount(at, v[feature], minlength=n)
        hi = np.where(grades < n_grades - 1, _s(t[np.minimum(grades, n_grades - 2)] - z), 1.0)
        lo = np.where(grades > 0, _s(t[np.maximum(grades - 1, 0)] - z), 0.0)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = np.where(grades < n_grades - 1, hi * (1 - hi), 0), np.where(grades > 0, lo * (1 - lo), 0)
        dz = row * (dhi - dlo) / p
        dt = np.zeros(n_grades - 1)
        np.add.at(dt, np.minimum(grades, n_grades - 2), -row * dhi / p)
        np.add.at(dt, np.maximum(grades - 1, 0), row * dlo / p)
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, dz[at], minlength=len(ids)) + decay * v, tail[:1], tail[1:] * np.exp(theta[len(ids) + 1 :])])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    w[ids] = theta[: len(ids)]
    return w, theta[len(ids)] + np.r_[0, np.cumsum(np.exp(theta[len(ids) + 1 :]))]


def fit(rated: DataFrame, n_grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", hash_bits: int = 18, train_rows: int = 16_000) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from at most ``train_rows`` rated rows, those with the smallest hash of key and grade."""
    size = (1 << hash_bits) + _RANGES * _RATIOS
    rows = rated.filter(F.col(grade).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(grade).cast("int").alias("grade"), F.xxhash64(F.col(key), F.col(grade)).alias("h"))
    cut = rows.select("h").orderBy("h").limit(train_rows).agg(F.max("h").alias("h")).first()["h"]  # keeps texts out of the sort
    if cut is None:
        return fit_arrays(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), size, n_grades)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, grades = [x or "" for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for first, part in blocks(texts):
                at, feature = features(part, hash_bits)
                lists = np.split(feature.astype(np.int32), np.flatnonzero(np.diff(at)) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array(grades[first : first + len(part)], pa.int32()), batch.column(2).slice(first, len(part))], ["features", "grade", "h"])

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values("h", kind="stable")
        lists = [np.asarray(x) for x in own["features"]]
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        w, t = fit_arrays(at, np.concatenate(lists), own["grade"].to_numpy(), size, n_grades)
        yield pd.DataFrame({"w": [w.astype("<f4").tobytes()], "t": [t.astype("<f8").tobytes()]})

    sample = rows.filter(F.col("h") <= cut).select("text", "grade", "h").mapInArrow(extract, "features array<int>, grade int, h long")
    # ties of the last hash are more than the bound, which holds for what the one task gets
    row = sample.orderBy("h", "grade", "features").limit(train_rows).mapInPandas(train, "w binary, t binary").first()
    return np.frombuffer(row["w"], "<f4"), np.frombuffer(row["t"], "<f8")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep_grade: int, keep_chance: float = 0.5, key: str = "doc_id", text: str = "text", hash_bits: int = 18) -> DataFrame:
    """The key, ``expected_grade``, ``tail_probability`` (of ``keep_grade`` or more) and ``kept`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            z = np.zeros(len(texts))
            for first, part in blocks(texts):
                at, feature = features(part, hash_bits)
                z[first : first + len(part)] = np.bincount(at, w[feature], minlength=len(part))
            above = 1 - _s(t[None, :] - z[:, None])
            tail = above[:, keep_grade - 1]
            columns = [pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= keep_chance)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "expected_grade", "tail_probability", "kept"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating from two labels: 0 toxic, 1 neither toxic nor good, 2 good; null where neither label tells."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def grade(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = 16_000) -> DataFrame:
    """Fit on the labelled rows and score all."""
    rated = labels.select(F.col(key).alias("__key"), grade_of(F.col("quality"), F.col("toxic")).alias("__grade"))
    few = rated.filter(F.col("__grade").isNotNull() & F.col("__key").isNotNull())
    # the labels' own bound comes first: texts are fetched for the sample alone
    few = few.withColumn("__h", F.xxhash64("__key", "__grade")).orderBy("__h", "__key").limit(train_rows)
    sample = docs.select(F.col(key), F.col(text)).join(F.broadcast(few), F.col(key) == F.col("__key"))
    model = fit(sample.select(F.col("__key"), F.col(text).alias("__text"), "__grade"), 3, "__key", "__text", "__grade", train_rows=train_rows)
    return score(docs, model, 2, key=key, text=text)
