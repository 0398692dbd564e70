"""Byte-level BPE by DuckDB recursive queries, one database per partition.

Texts become pieces, pieces pre-tokens, and only pre-tokens not met before in the partition go to the database. There,
token-position rows join the merge table; each word contracts its pair of least rank and all those that nothing of a lower
rank can reach (``merge_table`` finds from the vocabulary itself what can), again until no pair is left. Decoding takes the
bytes of each id from the vocabulary and puts them together in order.

Words of over ``CHUNK`` bytes go in chunks, as the steps of the recursion grow with a word's length. Ids are the encoding of
their bytes if and only if each two neighbours are that of theirs: until some merge crosses a border between tokens, either
side goes its own way, so the first to cross would do so with these two tokens alone. Chunks therefore stand as they are
where the tokens at a border fit; where they don't, the tokens around it are encoded anew, twice as many each time, until
they do.

Memory: rows come in blocks of bounded bytes, the memory of words drops those longest unused when it would pass twice ``cached`` of them, and each
database has a memory limit. Defined cases: a null text is empty (no ids); a text of any length goes whole, alone in its
block if it is long; ties and repeated rows are encoded row by row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm._kept import kept
from pagemill.llm._pretokens import Spans, cut_lines


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, codes), in order, of every pair of tokens that merges or whose neighbours may have to wait for it.

    A pair of rank r may contract before its turn if nothing of a lower rank can come to touch it, nor what it becomes:

    - its rank is the least of its neighbours' (of equal ones the left-most goes first);
    - the token x before it, should it grow to the left, joins no first token y of the pair at a rank up to r: no token of
      such a rank is some longer token that ends in x, and y (``left`` has the least such rank of x, y);
    - the like for what comes after it (``right``);
    - the token it becomes is part of no token of lower rank (its code is even).

    Until its turn merging then goes on beside it as if it were still a pair, so the ids are those of contracting the least
    rank of the word alone, which always may. A code holds the rank, one bound for the pair after it, one for the pair
    before it, and that last bit.
    """
    rank: dict[tuple[int, int], int] = {}
    left: dict[tuple[int, int], int] = {}
    right: dict[tuple[int, int], int] = {}
    waits = set()
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is None or b is None:
                continue
            rank[a, b] = r
            waits.update(x for x in (a, b) if x > r)
            for k in range(1, i):
                x = ranks.get(token[k:i])
                if x is not None and left.get((x, b), NO) > r:
                    left[x, b] = r
            for k in range(i + 1, len(token)):
                x = ranks.get(token[i:k])
                if x is not None and right.get((a, x), NO) > r:
                    right[a, x] = r
    pairs = sorted(rank.keys() | left.keys() | right.keys())
    own, before, after = (np.array([of.get(p, NO) for p in pairs], np.int64) for of in (rank, left, right))
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return a << 32 | b, own << 43 | np.minimum(own, before) << 22 | np.minimum(own + 1, after) << 1 | np.isin(own, sorted(waits))


#: The rank of a pair that does not merge; ranks are less.
NO = (1 << 20) - 1
#: The code of a pair that neither merges nor holds up another.
FREE = NO << 43 | NO << 22 | NO << 1


def _hit(code: str, before: str, after: str, token: str) -> str:
    """Whether the pair of ``code`` contracts, which begins at ``token``; the codes beside it."""
    alone = f"best < {NO << 32} AND ((({code} >> 43) << 32) | ({token} >> 32)) = best"
    return f"({code} & 1 = 0 AND {code} >> 43 < (({before} >> 22) & {2 * NO + 1}) AND {code} >> 43 < (({after} >> 1) & {2 * NO + 1}) OR {alone})"


def _then(code: str, token: str, hit: str) -> str:
    """The id at a place after the step."""
    return f"CASE WHEN {hit} THEN {code} >> 43 ELSE {token} & {(1 << 32) - 1} END"


_HIT = _hit("code", "code_1", "code1", "token")
#: A row is a token of a word, with its position before its id, and the code of the pair that begins there. A step contracts
#: all pairs of a word that may, joins the new neighbours to the merge table, and marks words without a pair as done.
ENCODE = f"""
WITH RECURSIVE step(word, token, code, done) AS (
    SELECT word, token, code, false FROM start
    UNION ALL
    SELECT c.word, c.token, coalesce(m.code, {FREE}), c.done FROM (
        SELECT word, ((token >> 32) << 32) | {_then("code", "token", _HIT)} AS token,
               CASE WHEN {_HIT} THEN {_then("code2", "token2", _hit("code2", "code1", "code3", "token2"))}
                    ELSE {_then("code1", "token1", _hit("code1", "code", "code2", "token1"))} END AS next,
               best >= {NO << 32} AS done
        FROM (SELECT word, token, code, min(((code >> 43) << 32) | (token >> 32)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best,
                     lag(code, 2, {FREE}) OVER w AS code_2, lag(code, 1, {FREE}) OVER w AS code_1, lead(code, 1, {FREE}) OVER w AS code1, lead(code, 2, {FREE}) OVER w AS code2,
                     lead(code, 3, {FREE}) OVER w AS code3, lag(token, 1, -1) OVER w AS token_1, lead(token, 1, -1) OVER w AS token1, lead(token, 2, -1) OVER w AS token2
              FROM step WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY token))
        WHERE NOT {_hit("code_1", "code_2", "code", "token_1")}
    ) c LEFT JOIN merges m ON m.pair = ((c.token & {(1 << 32) - 1}) << 32) | c.next
)
SELECT word, (token & {(1 << 32) - 1})::INTEGER AS id FROM step WHERE done ORDER BY word, token
"""


#: Bytes of a chunk of a long word. A multiple of many short periods, so that what repeats in a word is cut in step.
CHUNK = 120


class Encoder:
    """Encodes and decodes pre-tokens in a DuckDB database of its own."""

    def __init__(self, path: str, pattern: str, cached: int = 600_000, memory: str = "200MB", threads: int = 1):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        if max(self.ranks.values()) >= NO:
            raise ValueError(f"ranks of {NO} and more are not known")
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"memory_limit": memory, "threads": threads, "temp_directory": ""})
        pair, code = merge_table(self.ranks)
        self._table("merges", pair=pair, code=code)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        #: The bytes of each id.
        self.vocab = Spans([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)])
        self.fits: dict[tuple[int, int], bool] = {}
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        #: The code of each pair of bytes.
        both = self.byte_id[:, None] << 32 | self.byte_id
        at = np.minimum(np.searchsorted(pair, both), max(len(pair) - 1, 0))
        self.byte_code = np.where(pair[at] == both, code[at], FREE) if len(pair) else np.full(both.shape, FREE)
        self.cached, self.block = cached, 0
        #: The place of each known word, in order; the ids at each place, what it counts for and the block that last had it.
        self.known: dict[str, int] = {}
        self.found, self.weight, self.used = Spans([], 4), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _table(self, name: str, **columns) -> None:
        self.db.register("__in", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM __in")
        self.db.unregister("__in")

    def words(self, words: list[str]) -> Spans:
        """Ids of each of ``words``.

        What was met before is remembered, up to twice ``cached`` words, or ``cached`` and those of a block; a long word
        counts as several, and the longest unused go first.
        """
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        weight = [1 + len(w) // 100 for w in fresh]
        if self.weight.sum() + sum(weight) > 2 * self.cached:
            self._forget()
            known = self.known
            fresh = [w for w in dict.fromkeys(words) if w not in known]
            weight = [1 + len(w) // 100 for w in fresh]
        if fresh:
            new = self.encode([w.encode("utf-8") for w in fresh])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.found = Spans.of(np.concatenate([self.found.data, new.data]), np.concatenate([self.found.lengths, new.lengths]))
            self.weight = np.concatenate([self.weight, np.array(weight, np.int64)])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.block += 1
        self.used[place] = self.block
        return self.found.take(place)

    def _forget(self) -> None:
        """Keep the words last used that count for ``cached``."""
        last = np.argsort(-self.used, kind="stable")
        last = np.sort(last[np.cumsum(self.weight[last]) <= self.cached])
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(last.tolist())}
        self.found, self.weight, self.used = self.found.take(last), self.weight[last], self.used[last]

    def encode(self, words: list[bytes]) -> Spans:
        """Ids of each word; a word that is a token is that token."""
        tokens = list(map(self.ranks.get, words))
        rest = [k for k, i in enumerate(tokens) if i is None and len(words[k]) <= 2 * CHUNK]
        long = [k for k, i in enumerate(tokens) if i is None and len(words[k]) > 2 * CHUNK]
        ids, lengths = self._recurse([words[k] for k in rest])
        chunked = [self._chunked(words[k]) for k in long]
        single = [k for k, i in enumerate(tokens) if i is not None]
        data = np.concatenate([ids, *chunked, np.array([tokens[k] for k in single], np.uint32)])
        lengths = np.concatenate([lengths, np.array([len(c) for c in chunked], np.int64), np.ones(len(single), np.int64)])
        place = np.empty(len(words), np.int64)
        place[rest + long + single] = np.arange(len(words))
        return Spans.of(data, lengths).take(place)

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word by merging alone, be it a token or not."""
        # a chunk takes more steps than a word does, and all steps' rows are kept
        ids, lengths = self._recurse(words, 40_000)
        return np.split(ids, np.cumsum(lengths)[:-1]) if words else []

    def _chunked(self, word: bytes) -> np.ndarray:
        """Ids of a word of any length."""
        parts = self.merged([word[i : i + CHUNK] for i in range(0, len(word), CHUNK)])
        ids = np.concatenate(parts)
        borders, width = np.cumsum([len(p) for p in parts])[:-1], 2
        while len(borders := self._broken(ids, borders)):
            lo, hi = np.maximum(borders - width, 0), np.minimum(borders + width, len(ids))
            first = np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1]]
            lo, hi = lo[first], np.maximum.reduceat(hi, np.flatnonzero(first))
            anew = self.merged([b"".join(map(self.bytes_of.__getitem__, ids[a:b].tolist())) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            pieces, edges, at, size = [], [], 0, 0
            for a, b, new in zip(lo.tolist(), hi.tolist(), anew, strict=True):
                pieces += [ids[at:a], new]
                edges += [size + a - at, size + a - at + len(new)]
                size, at = edges[-1], b
            ids = np.concatenate([*pieces, ids[at:]])
            borders = np.unique([e for e in edges if 0 < e < len(ids)]).astype(np.int64)
            width *= 2
        return ids

    def _broken(self, ids: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Those of ``borders`` whose two tokens are not the encoding of their bytes."""
        pairs = list(zip(ids[borders - 1].tolist(), ids[borders].tolist(), strict=True))
        fresh = [p for p in dict.fromkeys(pairs) if p not in self.fits]
        if len(self.fits) + len(fresh) > 100_000:
            self.fits, fresh = {}, list(dict.fromkeys(pairs))
        for p, got in zip(fresh, self.merged([self.bytes_of[a] + self.bytes_of[b] for a, b in fresh]), strict=True):
            self.fits[p] = got.tolist() == list(p)
        return borders[[not self.fits[p] for p in pairs]] if pairs else borders[:0]

    def _recurse(self, words: list[bytes], most: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        sizes, ids, counts, at = np.array([len(w) for w in words], np.int64), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(sizes)
        while at < len(words):  # by bounded bytes
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            lengths = sizes[at:to]
            data = np.frombuffer(b"".join(words[at:to]), np.uint8)
            last = np.cumsum(lengths)
            pos = np.arange(len(data)) - np.repeat(last - lengths, lengths)
            code = np.full(len(data), FREE)
            code[:-1] = self.byte_code[data[:-1], data[1:]]
            code[last[lengths > 0] - 1] = FREE
            self._table("start", word=np.repeat(np.arange(to - at, dtype=np.int32), lengths), token=pos << 32 | self.byte_id[data], code=code)
            got = self.db.sql(ENCODE).to_arrow_table()
            ids.append(got["id"].to_numpy().astype(np.uint32))
            counts.append(np.bincount(got["word"].to_numpy(), minlength=to - at))
            at = to
        return np.concatenate(ids), np.concatenate(counts)

    def decode(self, ids: Spans) -> Spans:
        """The bytes of each sequence of ids."""
        text = self.vocab.take(ids.data)
        ends = np.concatenate([[0], np.cumsum(text.lengths)])[np.cumsum(ids.lengths)]
        return Spans.of(text.data, np.diff(ends, prepend=0))


def _encoded(texts: list[str], enc: Encoder) -> Iterator[tuple[bytes, bytes]]:
    """(ids as little-endian 32-bit integers, decoded bytes) of each text; ``enc`` remembers words."""
    codes, offsets, seen = cut_lines(texts)
    find = enc.pattern.findall
    # letters alone, but for a blank before them, are one match
    split = [[p] if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else find(p) for p in seen.to_pylist()]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    ids = enc.words(list(chain.from_iterable(split)))
    del split
    ends = np.concatenate([[0], np.cumsum(ids.lengths)])[np.cumsum(counts)]
    ids = Spans.of(ids.data, np.diff(ends, prepend=0))
    text = enc.decode(ids)
    yield from zip(ids.joined(codes, offsets), text.joined(codes, offsets), strict=True)


def encoder(path: str, pattern: str, cached: int):
    """A context with the encoder of this Python worker, which its next tasks use again."""
    return kept(("bpe", path, pattern, cached), lambda: Encoder(path, pattern, cached))


def blocks(texts: list[str], most: int) -> Iterator[list[str]]:
    """``texts`` in blocks of at most ``most`` characters; a longer one goes alone."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > most:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", cached: int = 600_000, block_chars: int = 10_000_000) -> DataFrame:
    """The key, ``ids`` (binary, little-endian unsigned 32-bit integers) and ``decoded`` (binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path, pattern, cached) as enc:
            for batch in batches:
                texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
                for part in blocks(texts, block_chars):
                    got = list(_encoded(part, enc))
                    columns = [batch.column(0).slice(at, len(part)), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"])
                    at += len(part)

    return _mapped(docs, key, text, run, "ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", cached: int = 600_000, block_chars: int = 10_000_000) -> DataFrame:
    """The key, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row: what ``encode`` returns, digested where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path, pattern, cached) as enc:
            for batch in batches:
                rows = []
                for part in blocks([t or "" for t in batch.column(1).to_pylist()], block_chars):
                    rows += [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(b).hexdigest()) for i, b in _encoded(part, enc)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, key, text, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, key: str, text: str, run, schema: str) -> DataFrame:
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {schema}")

