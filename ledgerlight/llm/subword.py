"""Encoding texts with a public tokenizer inside tasks.

A byte-level BPE never merges across the start of a space-led word, nor from a
letter into the mark that ends it, so a text whose spaces do not stand inside longer
white-space runs is the concatenation of such units. Arrow splits texts into units
and numbers the distinct ones of a chunk; each worker encodes a distinct unit once,
with the ``tokenizers`` library, and assembles texts from those ids with NumPy. Texts
with other white space are encoded whole. Both ways give the library's ids, special
tokens included.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space with white space on both sides (or at the end): units would split a run. A text with a null character is not cut either.
_RUN = rf"{_SPACE} (?:{_SPACE}|\z)|\x00"
_LETTER = "[A-Za-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u044f]"
#: Where units meet besides spaces: before a mark that ends a word, around a line end between letters or marks.
_MARK, _LINE = rf"({_LETTER})([.,;:!?])([ \n])", rf"({_LETTER}|[.,;:!?])\n({_LETTER}|[A-Z])"
_CHUNK = 1000


class UnitEncoder:
    """``max_units`` bounds the memory of a worker; the table is emptied beyond it."""

    def __init__(self, path: str, max_units: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocab = self._tokenizer.get_vocab()
        self._n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, at in vocab.items():
            self._n_bytes[at] = len(token)
        self._max_units = max_units
        self._clear()

    def _clear(self) -> None:
        self._rows: dict = {}
        self._starts = np.zeros(1 << 12, np.int64)
        self._lens = np.zeros(1 << 12, np.int64)
        self._ids = np.zeros(1 << 14, np.uint32)
        self._n_rows = self._n_ids = 0

    def _whole(self, texts: list[str]) -> list:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: np.ndarray, lens: np.ndarray) -> int:
        """Appends rows and returns the number of the first."""
        n, m = self._n_rows, self._n_ids
        while n + len(lens) > len(self._starts):
            self._starts, self._lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self._starts, self._lens))
        while m + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._lens[n : n + len(lens)] = lens
        self._starts[n : n + len(lens)] = m + np.cumsum(lens) - lens
        self._ids[m : m + len(ids)] = ids
        self._n_rows, self._n_ids = n + len(lens), m + len(ids)
        return n

    def _add_listed(self, texts: list[str]) -> int:
        found = self._whole(texts)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return self._add(np.fromiter((i for x in found for i in x), np.uint32, int(lens.sum())), lens)

    def _add_units(self, units: list[str]) -> None:
        """Encodes many space-led units in one call; the tokens' byte lengths tell where each ends."""
        led = [len(u) > 1 and u[0] == " " and not u[1].isspace() for u in units]
        odd = [u for u, x in zip(units, led, strict=True) if not x]
        units = [u for u, x in zip(units, led, strict=True) if x]
        if odd:
            first = self._add_listed(odd)
            self._rows.update(zip(odd, range(first, first + len(odd)), strict=True))
        for at in range(0, len(units), _CHUNK):
            chunk = units[at : at + _CHUNK]
            ids = np.array(self._whole(["".join(chunk)])[0], np.uint32)
            ends = np.cumsum([len(u.encode()) for u in chunk])
            cuts = np.searchsorted(np.cumsum(self._n_bytes[ids]), ends) + 1
            first = self._add(ids, np.diff(cuts, prepend=0))
            self._rows.update(zip(chunk, range(first, first + len(chunk)), strict=True))

    def _rows_of(self, units: list[str]) -> np.ndarray:
        new = [u for u in units if u not in self._rows]
        if new:
            self._add_units(new)
        return np.fromiter(map(self._rows.__getitem__, units), np.int64, len(units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings without nulls), one after another, and the number of ids of each."""
        if self._n_rows > self._max_units or self._n_ids > 32 * self._max_units:
            self._clear()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        runs = pc.match_substring_regex(texts, _RUN)
        marked = pc.if_else(runs, "", texts)
        marked = pc.replace_substring_regex(marked, _MARK, "\\1\x00\\2\\3")
        marked = pc.replace_substring_regex(marked, _LINE, "\\1\x00\n\x00\\2")
        split = pc.split_pattern(pc.replace_substring(marked, " ", "\x00 "), "\x00")
        coded = split.flatten().dictionary_encode()
        rows = self._rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        firsts = split.offsets.to_numpy()[:-1].astype(np.int64)
        kept = self._n_rows, self._n_ids
        if whole := texts.filter(runs).to_pylist():
            rows[firsts[runs.to_numpy(zero_copy_only=False)]] = self._add_listed(whole) + np.arange(len(whole))
        lens = self._lens[rows]
        ends = np.cumsum(lens)
        ids = self._ids[np.repeat(self._starts[rows] - (ends - lens), lens) + np.arange(int(ends[-1]))]
        self._n_rows, self._n_ids = kept
        return ids, np.add.reduceat(lens, firsts)


def chunks_of_text(texts: pa.Array, max_bytes: int = 1 << 22):
    """Slices (from, to) of an array of texts, each of about ``max_bytes`` or of one text."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(held):
        before = held[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(held, before + max_bytes, "right")))
        yield start, end
        start = end


def encode_documents(encoder: UnitEncoder, texts: pa.Array, end_id: int):
    """Yields (index, ids of the text with ``end_id`` appended); a null text is empty."""
    texts = pc.fill_null(texts, "")
    for a, b in chunks_of_text(texts):
        ids, lens = encoder.encode(texts.slice(a, b - a))
        ends = np.cumsum(lens)
        ids = np.insert(ids, ends, end_id).astype(np.uint32)
        ends = ends + np.arange(1, b - a + 1)
        for i, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
            yield a + i, ids[lo:hi]
