"""Words of many texts at once, with 64-bit hashes, by array operations over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 20


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(_STEP, base, np.uint64)])


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
#: A value for each byte; letters A-Z have those of a-z.
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with a line feed after each, where each begins)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(d) + 1 for d in data], np.int64)
    return np.frombuffer(b"\n".join([*data, b""]), np.uint8), np.cumsum(lengths) - lengths


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of true elements."""
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and don't overlap."""
    table = _FOLDED if fold else _VALUE
    out = np.zeros(len(first), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(end, first[at] + _STEP, "right")))
            a, n = int(first[at]), int(end[to - 1] - first[at])
            if n > _STEP:  # one very long word: in parts, each weighed by where it begins
                h = np.uint64(0)
                for k, p in enumerate(range(a, a + n, _STEP)):
                    part = data[p : min(p + _STEP, a + n)]
                    h += (table[part] * _UP[: len(part)]).sum(dtype=np.uint64) * np.uint64(pow(_BASE, k * _STEP, 1 << 64))
                out[at] = h
            else:
                sums = np.r_[np.uint64(0), np.cumsum(table[data[a : a + n]] * _UP[:n], dtype=np.uint64)]
                f, e = first[at:to] - a, end[at:to] - a
                out[at:to] = (sums[e] - sums[f]) * _DOWN[f]
            at = to
        return mix(out + (end - first).astype(np.uint64))


def blocks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in blocks of at most ``most`` characters; a longer text goes alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]
