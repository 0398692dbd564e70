"""Cutting texts at places where any byte-level pre-tokeniser of the GPT-2 kind cuts, so that pieces can be encoded once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(text: str) -> list[str]:
    """``text`` cut before every single blank that has no white space on either side.

    No match of the pattern crosses such a place: the run before the blank holds none, and after it a new match begins
    with the blank. The same holds for a single line feed, which is a match of its own.
    """
    out, last = [], None
    for p in text.split(" "):
        if last and p and not last[-1].isspace() and not p[0].isspace():
            out.append(" " + p)
        elif last is None:
            out.append(p)
        else:
            out[-1] += " " + p
        last = out[-1]
    return out


def cut_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(codes of the pieces of all texts, where each text's begin and the last ends, the pieces by code).

    Texts whose line feeds all stand alone are cut before these as well. No step goes through the pieces in Python but for texts with white space of two characters or at their ends.
    """
    column = pa.array(texts, pa.string())
    # a blank goes before each line feed, which then stands for the two
    beside = pc.match_substring_regex(column, "[\t-\r ]\n|\n[\t-\r ]")
    lists = pc.split_pattern(pc.if_else(beside, column, pc.replace_substring(column, "\n", " \n")), " ")
    beside = np.asarray(beside)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    encoded = lists.values.dictionary_encode()
    del column, lists  # a block's texts each
    codes, seen = np.asarray(encoded.indices).astype(np.int64), encoded.dictionary
    if not len(codes):
        return codes, offsets, seen
    line = pc.starts_with(seen, "\n")
    odd = ~np.asarray(bare(pc.if_else(line, pc.utf8_slice_codeunits(seen, 1), seen)))
    first = offsets[:-1]
    again = np.flatnonzero(np.logical_or.reduceat(odd[codes], first) | beside & np.logical_or.reduceat(np.asarray(line)[codes], first))
    heads, at = np.unique(codes[first], return_inverse=True)
    codes[first] = len(seen) + at
    names = [pc.if_else(line, seen, pc.binary_join_element_wise(" ", seen, "")), seen.take(pa.array(heads))]
    if len(again):
        codes, offsets, more = _cut_again(texts, again, codes, offsets, len(seen) + len(heads))
        names.append(pa.array(more, pa.string()))
    return codes, offsets, pa.concat_arrays(names)


def bare(strings: pa.StringArray) -> pa.BooleanArray:
    """Whether each has characters, and no white space (``str.isspace``) at either end."""
    inner = pc.binary_length(pc.utf8_trim_whitespace(strings))
    return pc.and_(pc.greater(inner, 0), pc.equal(inner, pc.binary_length(strings)))


def _cut_again(texts: list[str], again: np.ndarray, codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes and offsets with the texts ``again`` cut by ``pieces``, whose codes begin at ``n``; those pieces."""
    known: dict[str, int] = {}
    parts = np.split(codes, offsets[1:-1])
    for i in again.tolist():
        own = [known.setdefault(p, n + len(known)) for p in pieces(texts[i])] if texts[i] else []
        parts[i] = np.array(own, np.int64)
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)]), list(known)


class Spans:
    """Byte strings end to end, to be put together by code; made of items of ``width`` bytes."""

    def __init__(self, values: list[bytes], width: int = 1):
        self._set(np.frombuffer(b"".join(values), f"u{width}"), np.array([len(v) for v in values], np.int64) // width)

    @classmethod
    def of(cls, data: np.ndarray, lengths: np.ndarray) -> Spans:
        """Strings of ``lengths`` items, which lie end to end in ``data``."""
        out = cls.__new__(cls)
        out._set(data, lengths)
        return out

    def _set(self, data: np.ndarray, lengths: np.ndarray) -> None:
        self.lengths, self.data, self.width = lengths, data, data.itemsize
        self.starts = (np.cumsum(lengths) - lengths).astype(np.int32)

    def take(self, codes: np.ndarray) -> Spans:
        """The strings of ``codes``."""
        lengths = self.lengths[codes]
        return Spans.of(self._items(codes, lengths), lengths)

    def _items(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        before = np.cumsum(lengths, dtype=np.int32)
        before -= lengths.astype(np.int32)
        place = np.repeat(self.starts[codes] - before, lengths)
        place += np.arange(len(place), dtype=np.int32)
        return self.data.take(place)

    def joined(self, codes: np.ndarray, offsets: np.ndarray, most: int = 1_000_000) -> Iterator[bytes]:
        """The strings of each text's codes put together, text by text; a few texts at a time, of ``most`` items."""
        sizes = np.r_[0, np.cumsum(self.lengths[codes])][offsets]
        at, n = 0, len(offsets) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            own = codes[offsets[at] : offsets[to]]
            data = self._items(own, self.lengths[own]).tobytes()
            ends = ((sizes[at : to + 1] - sizes[at]) * self.width).tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                yield data[a:b]
            at = to
