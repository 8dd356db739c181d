"""Words as byte strings: their contexts, and tables of values by word.

Both models over bytes (language and toxicity) score words one by one, so a task
scores each distinct word once and adds up rows of a table.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.subword import chunks_of_text

_NEAREST = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def _marks() -> str:
    """Combining marks, as ranges of a character class: they stand inside words of many scripts."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(found), lambda x: x[1] - x[0])]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


_MARK = re.compile(f"[{_marks()}]")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKED_LETTERS = re.compile(rf"[^\W\d_]+(?:{_MARK.pattern}+[^\W\d_]*)*")
_OTHERS = re.compile(r"[\W\d_]")
_BLANKED = "".join(chr(c) if chr(c).isalpha() else " " for c in range(128))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; combining marks belong to the letters before them."""
    text = text.lower()
    if text.isascii():
        return text.translate(_BLANKED).split()
    # A text has few distinct characters: classes are matched on those, and what is no letter is blanked.
    distinct = "".join(set(text))
    if _MARK.search(distinct):
        return _MARKED_LETTERS.findall(text)
    others = _OTHERS.findall(distinct)
    if len(others) > 64:
        return _LETTERS.findall(text)
    for c in others:
        text = text.replace(c, " ")
    return text.split()


def grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' bytes (each word with a space before): row of the word, byte, window of the bytes before (at most ``order``, the nearest lowest), and how many those are."""
    flat = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    keep = np.flatnonzero(place > 0)  # the space itself costs the same in every language: it is not coded
    length = np.minimum(place[keep], order)
    window = np.zeros(len(keep), np.uint64)
    for k in range(1, order + 1):
        there = np.flatnonzero(length >= k)
        window[there] |= flat[keep[there] - k].astype(np.uint64) << np.uint64(8 * (k - 1))
    return np.repeat(np.arange(len(words)), lens)[keep], flat[keep], window, length


def context(window: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """The ``k`` nearest bytes of windows (7 at most) as one number that no other context has."""
    return (window & _NEAREST[k]) | (np.asarray(k).astype(np.uint64) + np.uint64(1)) << np.uint64(56)


def key_of(context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    mixed = (context ^ (context >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ ((byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))


class WordTable:
    """Values of words by row, filled as words come; emptied beyond ``max_words`` and beyond ``max_chars`` in them, so memory stays bounded."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], columns: int, max_words: int = 400_000, max_chars: int = 16_000_000):
        self._score, self._max, self._max_chars, self._chars = score, max_words, max_chars, 0
        self._rows: dict[str, int] = {}
        self.values = np.zeros((1 << 12, columns))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Row numbers of the words of each text."""
        if len(self._rows) > self._max or self._chars > self._max_chars:
            self._rows.clear()
            self._chars = 0
        table = self._rows
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in table]
        if new:
            n = len(table)
            while n + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[n : n + len(new)] = self._score(new)
            table.update(zip(new, range(n, n + len(new)), strict=True))
            self._chars += sum(map(len, new))
        return [np.fromiter(map(table.__getitem__, words), np.int64, len(words)) for words in texts]


def words_of_texts(texts: pa.Array):
    """Yields lists of the words of each text, whole texts in bounded chunks; a null text has none."""
    for a, b in chunks_of_text(texts, 1 << 20):
        yield [words_of(t or "") for t in texts.slice(a, b - a).to_pylist()]


def rows_of_texts(table: WordTable, texts: pa.Array):
    """Yields the row numbers of each text's words."""
    for words in words_of_texts(texts):
        yield from table.rows(words)


def most_held(per_word: DataFrame, times: Column, most: int) -> DataFrame:
    """The words that most texts hold, about ``most`` at most; of words of the last count those of the smallest hash. The cut is found from how many words have each count."""
    cut, share, room = 0, 1.0, most
    for r in sorted(per_word.groupBy(times.alias("times")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        if r["words"] > room:
            cut, share = r["times"], room / r["words"]
            break
        room -= r["words"]
    return per_word.filter((times > cut) | ((times == cut) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20))))


def held_out(of: Column, folds: int, fold: int) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(of.cast("string"), F.lit(""))) % folds) == fold
