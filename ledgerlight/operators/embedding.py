"""Embeddings of texts by random indexing: no model and no service.

Every word has a sparse signed vector of its own: a hash of it names a few places and
their signs. A text's vector is the sum over its words, so equal words add up and
others cancel on average; cosines of such sums estimate those of the full word counts.
The sums are whole numbers, the same whatever order words come in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def signed_places(word: Column, dims: int, places: int) -> Column:
    """Where a word's vector is not zero: place + 1 where it is 1, the negative of that where it is -1. Eight hex digits of the word's md5 each; up to four places."""
    if not 1 <= places <= 4:
        raise ValueError("one to four places")
    digits = F.md5(word)

    def one(k: int) -> Column:
        place = F.conv(F.substring(digits, 8 * k + 1, 7), 16, 10).cast("bigint") % dims + 1
        odd = F.substring(digits, 8 * k + 8, 1).isin(*"13579bdf")
        return F.when(odd, -place).otherwise(place)

    return F.array(*[one(k) for k in range(places)])


def embed_text(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dims: int = 64, places: int = 4) -> DataFrame:
    """id_col, embedding (array of ``dims`` longs): one row per id; texts without a word, and null ones, have zeros.

    A text's words are summed where it is read: one row of sums a text and task is shuffled.
    Rows that share an id are one text.
    """
    made = texts.select(F.col(id_col), F.arrow_udf(_summed(dims, places), "array<bigint>")(words_of(F.col(text_col))).alias("_v"))
    return made.groupBy(id_col).agg(F.array(*[F.sum(F.col("_v")[d]) for d in range(dims)]).alias("embedding"))


def _summed(dims: int, places: int, most_words: int = 100_000, at_once: int = 500_000) -> Callable[[pa.Array], pa.Array]:
    """Sums of the vectors of each row's words (see ``signed_places``). A word is hashed once a task until ``most_words`` are known; about ``at_once`` words are looked up at a time."""
    if not 1 <= places <= 4:
        raise ValueError("one to four places")
    known: dict[str, tuple[int, ...]] = {}

    def signed(word: str) -> tuple[int, ...]:
        digits = hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
        found = []
        for k in range(places):
            place = int(digits[8 * k : 8 * k + 7], 16) % dims
            # A negative sign is the second half of 2 * dims counters.
            found.append(place + dims if digits[8 * k + 7] in "13579bdf" else place)
        return tuple(found)

    def summed(words: pa.Array) -> pa.Array:
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, out, at = np.cumsum(sizes), [], 0
        while at < len(words):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
            part = words.slice(at, upto - at).flatten().dictionary_encode()
            if len(known) > most_words:
                known.clear()
            table = np.array([known.get(w) or known.setdefault(w, signed(w)) for w in part.dictionary.to_pylist()], np.int64).reshape(-1, places)
            row = np.repeat(np.arange(upto - at), sizes[at:upto])
            cells = sum((np.bincount(row * (2 * dims) + place, minlength=(upto - at) * 2 * dims) for place in table[part.indices.to_numpy()].T), np.zeros((upto - at) * 2 * dims, np.int64))
            cells = cells.reshape(-1, 2, dims)
            out.append((cells[:, 0] - cells[:, 1]).reshape(-1))
            at = upto
        values = np.concatenate(out) if out else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * dims, pa.array(values, pa.int64()))

    return summed


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda t, x: t + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))
