"""Token-id files with Elias-Fano document boundaries.

A file holds a run of documents in ascending key order: their ids concatenated in one array of 16- or 32-bit integers, and
two Elias-Fano sequences, the ends of the documents in that array and their keys less the first. A sequence of n values up
to u takes about n * (2 + log2(u / n)) bits; every 256th set bit of its upper part has its place on record, from which
``select`` finds a value in a bounded number of steps, without a table of 64-bit offsets.

Layout, little-endian: "PMTOKEN1"; eight u64 (part, sequence in the part, documents, of these with null key, ids, bytes an
id, bytes of the key sequence, first key as i64); end sequence; key sequence; ids; a line feed.

The strings of the tokenizer's added tokens are ordinary text, or with ``added`` one id each, as the library has it by default.

Defined cases: a null text is empty (the end id only); null keys come first; ties and repeated rows stand next to each
other; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagemill.llm._base import new_path, settle
from pagemill.llm._files import read_files, write_files
from pagemill.llm._kept import kept
from pagemill.llm._pretokens import Spans, bare, cut_lines
from pagemill.llm.bpe import blocks

MAGIC = b"PMTOKEN1"
SAMPLE = 256
#: ASCII marks: neither white space nor letters nor digits.
MARKS = string.punctuation
#: Bytes of pieces that a worker remembers from block to block; up to twice as many in between.
KEPT_BYTES = 16_000_000
#: Letters and digits up to U+024F.
ALNUM = np.array([chr(c).isalnum() for c in range(0x250)])


class EliasFano:
    """A non-decreasing sequence of n integers from 0 to u."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        u = int(v[-1]) if n else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = v & np.uint64((1 << bits) - 1)
        packed = np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, packed, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<4Q", self.n, self.low_bits, len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, bits, high, samples = struct.unpack_from("<4Q", data)
        low = (n * bits + 7) // 8
        a = np.frombuffer(data, np.uint8, low + high, 32)
        return cls(n, bits, a[:low], a[low:], np.frombuffer(data, "<u4", samples, 32 + low + high))

    def select(self, i: int) -> int:
        """Value ``i``: from the sampled place before it on, byte by byte to its set bit in the upper part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, first = divmod(at, 8)
        x = int(self.high[byte]) >> first << first
        while (c := x.bit_count()) <= left:
            left -= c
            byte += 1
            x = int(self.high[byte])
        for _ in range(left):
            x &= x - 1
        place = byte * 8 + (x & -x).bit_length() - 1
        first = i * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (place - i) << self.low_bits | (word >> first % 8) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """All values in order."""
        if not self.n:
            return np.zeros(0, np.int64)
        upper = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.int64)
        return (upper << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)


def pack(part: int, at: int, keys: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A file; ``keys`` are in order, nulls first."""
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum(lengths)).to_bytes()
    places = EliasFano.of((known - first).view(np.uint64)).to_bytes()
    head = struct.pack("<7Qq", part, at, len(keys), nulls, sum(lengths), width, len(places), first)
    return b"".join((MAGIC, head, ends, places, ids, b"\n"))


class TokenFile:
    """A file's documents: ``ids_of(i)`` reads one by the boundaries alone."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.part, self.at, self.n, self.nulls, self.n_ids, width, key_bytes, self.first = struct.unpack_from("<7Qq", data, 8)
        view, end = memoryview(data), len(data) - 1
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, end - self.n_ids * width)
        self.ends = EliasFano.from_bytes(view[72:])
        self.places = EliasFano.from_bytes(view[end - self.n_ids * width - key_bytes :])

    def keys(self) -> list[int | None]:
        return [None] * self.nulls + (self.places.all() + self.first).tolist()

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class Words:
    """The tokenizer, and the ids of pieces it met: up to twice ``cached``, or those of a block, the longest unused going first.

    Pieces and ids are arrays, and all steps but the library's own go through them outside Python.
    """

    def __init__(self, path: str, cached: int, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces hold no added token's string but as ordinary text
        found = self.tokenizer.get_added_tokens_decoder()
        #: The id of each added token by its string, and what cuts a text at them: text and strings in turn.
        self.added, self.cut = {}, None
        if added:
            if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in found.values()):
                raise ValueError("added tokens that look at the text around them are not known")
            self.added = {x.content: i for i, x in found.items()}
            if self.added:
                self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        #: Bytes of each id: a byte-level vocabulary has a character for each.
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = list(map(len, vocab))
        # pieces put together must not make up an added token
        self.most = 1 if any(c in x.content[1:] for x in found.values() for c in " \n") else 500
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.cached, self.block = cached, 0
        #: Pieces, their ids and the block that last had each.
        self.known, self.found, self.used = pa.array([], pa.string()), Spans([], self.width), np.zeros(0, np.int64)

    def ids(self, pieces: pa.StringArray) -> Spans:
        """Ids of each of ``pieces``."""
        if not len(pieces):
            return Spans([], self.width)
        # between a letter or digit and marks up to the end a match ends and another begins
        stems = pc.utf8_rtrim(pieces, MARKS)
        cut = ends_alnum(stems) & np.asarray(pc.less(pc.binary_length(stems), pc.binary_length(pieces)))
        tails = ends_from(pieces.filter(pa.array(cut)), np.asarray(pc.binary_length(stems))[cut])
        encoded = pa.concat_arrays([pc.if_else(pa.array(cut), stems, pieces), tails]).dictionary_encode()
        place = self._places(encoded.dictionary)[np.asarray(encoded.indices)]
        at = np.flatnonzero(cut)
        got = self.found.take(np.insert(place[: len(pieces)], at + 1, place[len(pieces) :]))
        out = Spans.of(got.data, np.add.reduceat(got.lengths, np.arange(len(pieces)) + np.cumsum(cut) - cut))
        self._forget()
        return out

    def _places(self, pieces: pa.StringArray) -> np.ndarray:
        """The places of ``pieces``, each different, among the known ones; those not yet known go to the library."""
        self.block += 1
        at = pc.index_in(pieces, value_set=self.known)
        new = np.asarray(at.is_null())
        at = np.array(at.fill_null(0), np.int64)
        self.used[at[~new]] = self.block
        fresh = pieces.filter(pa.array(new))
        # no match of the pattern crosses the border of pieces that begin with one white space and end in none, see ``_pretokens.pieces``
        joint = pc.and_(pc.match_substring_regex(fresh, "^[ \n]"), bare(pc.utf8_slice_codeunits(fresh, 1)))
        n, data, lengths, order = len(self.known), [self.found.data], [self.found.lengths], []
        for some, most in (joint, self.most), (pc.invert(joint), 1):
            own = fresh.filter(some)
            order.append(own)
            for k in range(0, len(own), 20_000):
                ids, sizes = self._encode(own.slice(k, 20_000), most)
                data.append(ids)
                lengths.append(sizes)
        joint = np.asarray(joint)
        at[np.flatnonzero(new)[np.r_[np.flatnonzero(joint), np.flatnonzero(~joint)]]] = n + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, *order])
        self.found = Spans.of(np.concatenate(data), np.concatenate(lengths))
        self.used = np.r_[self.used, np.full(len(fresh), self.block)]
        return at

    def _forget(self) -> None:
        """Where there are over twice as many, keep the ``cached`` pieces last used, of ``KEPT_BYTES`` in all and none of over a sixteenth of that."""
        if len(self.known) > 2 * self.cached or self.known.nbytes > 2 * KEPT_BYTES:
            size = np.asarray(pc.binary_length(self.known)).astype(np.int64)
            last = np.argsort(-self.used, kind="stable")
            last = last[size[last] <= KEPT_BYTES // 16][: self.cached]
            last = np.sort(last[np.cumsum(size[last]) <= KEPT_BYTES])
            self.known, self.found, self.used = self.known.take(pa.array(last)), self.found.take(last), self.used[last]

    def _encode(self, pieces: pa.StringArray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has; they go to the library ``most`` at once and are told apart by their bytes."""
        parts = pieces
        if most > 1:
            parts = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), most), len(pieces)], pa.int32()), pieces), "")
        ids = np.concatenate([np.array(e.ids, f"<u{self.width}") for e in self.tokenizer.encode_batch_fast(parts.to_pylist(), add_special_tokens=False)])
        reach = np.cumsum(self.bytes_of[ids])
        want = np.cumsum(np.asarray(pc.binary_length(pieces)), dtype=np.int64)
        ends = np.searchsorted(reach, want, "right")
        if not np.array_equal(np.r_[0, reach][ends], want):
            raise ValueError("the tokenizer cuts texts otherwise than its pattern")
        return ids, np.diff(ends, prepend=0)


def ends_alnum(strings: pa.StringArray) -> np.ndarray:
    """Whether the last character of each is a letter or digit up to U+024F."""
    offsets, data = buffers(strings)
    if not len(data):
        return np.zeros(len(strings), bool)
    ends = offsets[1:]
    last, before = data[np.maximum(ends - 1, 0)].astype(np.int64), data[np.maximum(ends - 2, 0)].astype(np.int64)
    code = np.where(last < 0x80, last, np.where((before >= 0xC2) & (before <= 0xC9), (before & 0x1F) << 6 | last & 0x3F, 0))
    return (ends > offsets[:-1]) & (code < len(ALNUM)) & ALNUM[np.minimum(code, len(ALNUM) - 1)]


def ends_from(strings: pa.StringArray, first: np.ndarray) -> pa.StringArray:
    """Each string from its byte ``first`` on."""
    offsets, data = buffers(strings)
    lengths = np.diff(offsets) - first
    to = np.r_[0, np.cumsum(lengths)]
    body = data[np.repeat(offsets[1:] - to[1:], lengths) + np.arange(to[-1])]
    return pa.StringArray.from_buffers(len(strings), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(body))


def buffers(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where strings begin and the last ends, and the bytes."""
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = strings.buffers()
    return np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64), np.frombuffer(data or b"", np.uint8)


def encode_texts(texts: list[str], own: Words) -> list[bytes]:
    """Ids of each text as bytes."""
    if any(x in t for x in own.added for t in texts):
        cut = [own.cut(t) for t in texts]
        encoded = iter(_encode_words([x for parts in cut for x in parts[::2]], own))
        return [b"".join([own.added[x].to_bytes(own.width, "little") if k % 2 else next(encoded) for k, x in enumerate(parts)]) for parts in cut]
    return _encode_words(texts, own)


def _encode_words(texts: list[str], own: Words) -> list[bytes]:
    codes, offsets, seen = cut_lines(texts)
    return list(own.ids(seen).joined(codes, offsets))


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text", file_ids: int = 4_000_000, cached: int = 300_000, added: bool = False) -> None:
    """Write the ids of all rows, each followed by ``end_id``, to files of about ``file_ids`` ids in key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        keys, lengths, held, size = [], [], [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(part, at, keys, lengths, b"".join(held), width)], pa.binary())], ["content"])

        with kept(("words", path, cached, added), lambda: Words(path, cached, added)) as own:
            width = own.width
            end = end_id.to_bytes(width, "little")
            for batch in batches:
                names, texts, done = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], 0
                for some in blocks(texts, 8_000_000):
                    for name, ids in zip(names[done : done + len(some)], encode_texts(some, own), strict=True):
                        keys.append(name)
                        lengths.append(len(ids) // width + 1)
                        held += ids, end
                        size += lengths[-1]
                        if size >= file_ids:
                            yield file()
                            at += 1
                            keys, lengths, held, size = [], [], [], 0
                    done += len(some)
            if keys:
                yield file()

    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text"))
    # the last column orders rows that repeat a key
    order = [F.asc_nulls_first("__key"), F.xxhash64("__text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    write_files(rows.mapInArrow(run, "content binary"), folder)


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """The key, ``start``, ``n_tokens`` and ``ids_crc32`` of every document in the files of ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(content.as_py())
                ends = f.ends.all()
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(f.ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [np.full(f.n, f.part), np.full(f.n, f.at), pa.array(f.keys(), pa.int64()), starts, ends - starts, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "at", "key", "start", "n", "crc"])

    rows = read_files(spark, folder).select("content").mapInArrow(run, "part long, at long, key long, start long, n long, crc long")
    rows = settle(rows, "token-rows")
    # a row for each file: one for some millions of ids
    files = rows.groupBy("part", "at").agg(F.sum("n").alias("ids"))
    before = files.select("part", "at", F.coalesce(F.sum("ids").over(Window.orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, ["part", "at"]).select(F.col("key").alias(key), (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Write the files of ``docs`` to the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "tokens")
    write(docs, path, folder, end_id, key, text, added=added)
    return read(docs.sparkSession, folder, key)
