"""Phrases whose words stand together more often than apart, mined by sketches, then exactly.

At first nothing is counted exactly: the hash of every sequence of one or two words goes
into a count-min sketch. Its cells are the first bits of the hash, 2^40 at least, so many
that it does not fill up as the input grows. Tasks hold only the cells that they have
met, sort and combine them, and deal them by the first bits to slices, where the sketches
of all tasks are added up; cells stop at the threshold. A cell never holds less than any
of its sequences occurs, so what is below the threshold cannot be frequent, and nothing
that holds it can. Of each slice a few bits are published: those that its cells of the
threshold have in three rows. Sequences of three and four words without a ruled-out pair
are sketched in the same way. The last pass counts the survivors exactly: chunks of
text deal their counts, with the words themselves, to slices by the hash, too.
Scores come from exact counts, and phrases inside a longer candidate that holds most
of their occurrences are subsumed by it.

What is published grows with the input up to ``max_cells`` bits a row; where more
sequences are frequent than it can tell apart, more others survive into the last pass,
and results stay the same. Sequences are counted by their words, not by their hashes:
two of one hash are told apart.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into
words ``[^\\x20\\x09]+``. A null text is empty, a null lang is ``und``, as is that
lang itself; repeated rows count as often as they stand there; other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import broadcast_if_small, materialize, shipped

LONGEST = 4
#: Lengths of sequences that are sketched in one pass; later levels count only what holds no ruled-out sequence of those before.
LEVELS = ((1, 2), (3, 4))
#: Rows of what is published of a sketch.
DEPTH = 3
#: Bits of one row of it, at least and at most; sequences for each bit in between.
MIN_CELLS, MAX_CELLS, LOAD = 1 << 14, 1 << 24, 24
#: Bits of a slice's number at least, bits of a cell's place in its slice, and sequences for each slice beyond, about.
_SLICE_BITS, _PLACE_BITS, _SLICE = 8, 32, 1 << 23
#: Bytes of text that a task reads at a time, for the sketch and for the last pass, and sequences that it combines at a time.
_CHARS, _COUNTED_CHARS, _ADDED = 1 << 21, 1 << 23, 1 << 22
#: Characters of text for a task at least, where there are more tasks than four a core.
TASK_CHARS = 1 << 26

#: Of UTF-8: marks that end a piece, blanks, and A-Z in lower case; other characters hold none of these bytes.
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 10 + b" abcdefghijklmnopqrstuvwxyz")
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Of a word's eight bytes, those that belong to it if it has 0, 1, ..., 8 left; longer words than ``_LONG`` bytes are Python objects.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 256


class Words:
    """Words of a UTF-8 text in order: the text in lower case, where they begin and end, whether one stands in a piece with the next, and their hashes."""

    def __init__(self, text: bytes):
        self.text = text.translate(_TABLE)
        data = np.frombuffer(self.text + b"\n" * 9, np.uint8)
        ends = data == 10
        inside = ~(ends | (data == 32))
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        piece = np.cumsum(ends, dtype=np.int32)[self.starts]
        self.joined = piece[1:] == piece[:-1]
        self.lengths = self.ends - self.starts
        self._eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
        self._begin = self._eight[self.starts] & _LEFT[np.minimum(self.lengths, 8)]
        mixed = (self.lengths.astype(np.uint64) * _ODD[0] ^ self._begin) * _MIX
        self.hashes = mixed ^ (mixed >> np.uint64(32))
        of, done = self._rest(np.flatnonzero(self.lengths > 8), 8)
        while len(of):
            mixed = (self.hashes[of] ^ self._eights(of, done)) * _MIX
            self.hashes[of] = mixed ^ (mixed >> np.uint64(32))
            of, done = self._rest(of, done + 8)
        for k in np.flatnonzero(self.lengths > _LONG):
            self.hashes[k] = xxhash.xxh64_intdigest(self.word(k), 42)

    def word(self, k: int) -> bytes:
        return self.text[self.starts[k] : self.ends[k]]

    def _rest(self, of: np.ndarray, done: int) -> tuple[np.ndarray, int]:
        """Of the words ``of`` those of more than ``done`` bytes; long words are left out."""
        lengths = self.lengths[of]
        return of[(lengths > done) & (lengths <= _LONG)], done

    def _eights(self, of: np.ndarray, done: int) -> np.ndarray:
        return self._eight[self.starts[of] + done] & _LEFT[np.minimum(self.lengths[of] - done, 8)]

    def same(self, of: np.ndarray, as_: np.ndarray) -> bool:
        """Whether each of the words ``of`` is the one of ``as_`` at its place."""
        lengths = self.lengths[of]
        if (lengths != self.lengths[as_]).any() or (self._begin[of] != self._begin[as_]).any():
            return False
        if not all(self.word(of[k]) == self.word(as_[k]) for k in np.flatnonzero(lengths > _LONG)):
            return False
        more = np.flatnonzero((lengths > 8) & (lengths <= _LONG))
        of, as_, done = of[more], as_[more], 8
        while len(of):
            if (self._eights(of, done) != self._eights(as_, done)).any():
                return False
            done += 8
            more = np.flatnonzero(self.lengths[of] > done)
            of, as_ = of[more], as_[more]
        return True

    def phrases(self, first: np.ndarray, n: int) -> list[bytes]:
        """The sequences of ``n`` words that begin at ``first``, with one blank between words."""
        start, end = self.starts[first], self.ends[first + n - 1]
        found = [self.text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        for k in np.flatnonzero(sum(self.lengths[first + k] for k in range(n)) + n - 1 != end - start):
            found[k] = b" ".join(w for w in found[k].split(b" ") if w)
        return found


def _chunks(batches, most: int):
    """Of batches of (lang, text), yields (lang, words) of whole texts of one lang, in chunks of ``most`` bytes or one text."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] > most or sum(sizes.values()) > 4 * most:
                lang = max(sizes, key=sizes.get)
                yield lang, Words(b"\n".join(held.pop(lang)))
                del sizes[lang]
    for lang, texts in held.items():
        yield lang, Words(b"\n".join(texts))


class Reached:
    """Of the lengths ``of``: what is published of the added sketches, ``1 << bits`` bits a row, those of each of the ``1 << dealt`` slices together."""

    def __init__(self, of: tuple[int, ...], cells: np.ndarray, bits: int, dealt: int):
        self.of, self.cells, self.bits, self.dealt = of, cells, bits, dealt

    def kept(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are not ruled out."""
        at, cells = np.arange(len(hashes)), _place(hashes, self.dealt)
        of = (hashes >> np.uint64(64 - self.dealt)).astype(np.int64) << (self.bits - self.dealt)
        for row in range(DEPTH):
            cell = of[at] | _cell(cells[at], row, self.bits - self.dealt)
            at = at[(self.cells[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0]
        return at


def _place(hashes: np.ndarray, dealt: int) -> np.ndarray:
    """Cells of the sketch: a slice's number and a place in it."""
    return hashes >> np.uint64(64 - _PLACE_BITS - dealt)


def _cell(cells: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((cells * _ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin in an ordered array, and their lengths."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return first, np.diff(np.concatenate([first, [len(ordered)]]))


def _sequences(lang: str, words: Words, known: list[Reached]):
    """For 1 to ``LONGEST`` words: where sequences begin that lie in one piece, and their hashes; what ``known`` rules out, or holds what it rules out, is left out."""
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7))
    alive, mixed = np.ones(len(words.hashes), bool), words.hashes ^ seed
    for n in range(1, LONGEST + 1):
        if n > 1:
            alive = alive[:-1] & alive[1:]
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(31))) * _MIX + words.hashes[n - 1 :]
        if n == 2:
            alive &= words.joined
        at = np.flatnonzero(alive)
        found = (mixed[at] ^ (mixed[at] >> np.uint64(29))) * _MIX
        for reached in known:
            if n in reached.of:
                kept = reached.kept(found)
                at, found = at[kept], found[kept]
                alive = np.zeros(len(alive), bool)
                alive[at] = True
        yield n, at, found
        if len(words.hashes) <= n:
            return


def sketch_cells(sequences: int, max_cells: int = MAX_CELLS) -> int:
    """Bits of the number of bits that are published a row, for about so many sequences."""
    return int(math.log2(min(max(MIN_CELLS, max_cells), max(MIN_CELLS, 1 << math.ceil(math.log2(max(1, sequences) / LOAD + 1))))))


def slice_bits(bits: int, sequences: int = 0) -> int:
    """Bits of a slice's number, for about so many sequences; a slice has whole bytes of what is published."""
    return min(bits - 3, max(_SLICE_BITS, math.ceil(math.log2(max(1, sequences) / _SLICE))))


def _sketches(texts: DataFrame, of: tuple[int, ...], known: Callable[[], list[Reached]], bits: int, threshold: int, sequences: int = 0) -> DataFrame:
    """(slice, places, cells) of the sketches of tasks, of sequences of the lengths ``of``; cells are bytes that stop at the threshold."""
    dealt = slice_bits(bits, sequences)

    def count(batches):
        tested = known()
        waiting: list[np.ndarray] = []

        def added():
            cells = np.concatenate(waiting)
            waiting.clear()
            cells.sort()
            cells = _place(cells, dealt)
            first, times = _runs(cells)
            cells, times = cells[first], np.minimum(times, threshold).astype(np.uint8)
            places = cells.astype(np.uint32)
            ends = np.searchsorted(cells, np.arange((1 << dealt) + 1, dtype=np.uint64) << np.uint64(_PLACE_BITS)).tolist()
            full = [k for k in range(1 << dealt) if ends[k] < ends[k + 1]]
            parts = [pa.array([x[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary()) for x in (places, times)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *parts], ["slice", "places", "cells"])

        for lang, words in _chunks(batches, _CHARS):
            waiting += [h for n, _, h in _sequences(lang, words, tested) if n in of]
            if sum(map(len, waiting)) >= _ADDED:
                yield added()
        if waiting:
            yield added()

    return texts.mapInArrow(count, "slice int, places binary, cells binary")


def _reached(sketches: DataFrame, of: tuple[int, ...], bits: int, threshold: int, sequences: int = 0) -> Reached:
    """Adds up the sketches of all tasks."""
    dealt = slice_bits(bits, sequences)
    own = bits - dealt

    def add(batches):
        at, held = None, []

        def done():
            places, cells = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), (np.uint32, np.uint8), strict=True))
            both = np.sort(places.astype(np.uint64) << np.uint64(8) | cells)
            first, _ = _runs(both >> np.uint64(8))
            sums = np.add.reduceat((both & np.uint64(255)).astype(np.uint32), first)
            frequent = both[first[sums >= threshold]] >> np.uint64(8) | np.uint64(at << _PLACE_BITS)
            published = np.zeros((DEPTH, 1 << own), bool)
            for row in range(DEPTH):
                published[row, _cell(frequent, row, own)] = True
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(published, axis=1).tobytes()], pa.binary())], ["slice", "bits"])

        for batch in batches:
            for k in range(len(batch)):
                if (now := batch.column(0)[k].as_py()) != at:
                    if held:
                        yield done()
                    at, held = now, []
                held.append([batch.column(c)[k].as_buffer().to_pybytes() for c in (1, 2)])
        if held:
            yield done()

    summed = sketches.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, bits binary")
    published = np.zeros((DEPTH, 1 << dealt, (1 << own) // 8), np.uint8)
    for r in summed.collect():  # at most MAX_CELLS bits a row; an iterator would run one task at a time
        published[:, r["slice"]] = np.frombuffer(r["bits"], np.uint8).reshape(DEPTH, -1)
    return Reached(of, published.reshape(DEPTH, -1), bits, dealt)


def _same(ids: np.ndarray, at: np.ndarray, n: int, as_: np.ndarray) -> bool:
    return all((ids[at + k] == ids[as_ + k]).all() for k in range(n))


def _order(hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes in an order of their first bits; the rest of a hash makes room for its place, which sorts faster than places alone."""
    bits = np.uint64(len(hashes).bit_length())
    placed = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)
    placed.sort()
    return (placed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def distinct(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct sequence of ``n`` words begins once (hardly ever twice), and how often it begins there and among those that it stands for."""
    order = _order(hashes)
    first, times = _runs(hashes[order])
    ordered = at[order]
    if _same(ids, ordered, n, np.repeat(ordered[first], times)):
        return ordered[first], times
    _, first, times = np.unique(np.stack([ids[at + k] for k in range(n)], axis=1), axis=0, return_index=True, return_counts=True)  # two sequences of one hash
    return at[first], times


def numbers(words: Words, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the words ``at``, equal for equal words only; -1 for the others."""
    order = _order(hashes)
    first, times = _runs(hashes[order])
    ids, of = np.full(len(words.starts), -1, np.int32), at[order]
    ids[of] = np.repeat(np.arange(len(first), dtype=np.int32), times)
    if words.same(at, of[first][ids[at]]):
        return ids
    known: dict[bytes, int] = {}  # two words of one hash
    ids[at] = [known.setdefault(words.word(k), len(known)) for k in at]
    return ids


def count_sequences(docs: DataFrame, *, threshold: int = 30, max_cells: int = MAX_CELLS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, n: exact counts of all word sequences that reach the threshold; the phrase '' has the number of a lang's words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # For the sketch's size, a word is taken for six characters.
    characters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    sequences = len(LEVELS[0]) * characters // 6
    bits = sketch_cells(sequences, max_cells)
    # Sequences are combined in tasks: no more of them than cores and the text's size call for.
    texts = texts.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-characters // TASK_CHARS)))
    stop, known = min(threshold, 255), []
    for of in LEVELS:
        known.append(_reached(_sketches(texts, of, shipped(spark, known), bits, stop, sequences), of, bits, stop, sequences))
    return _exact(texts, shipped(spark, known), slice_bits(32, 4 * sequences), threshold)


def _exact(texts: DataFrame, known: Callable[[], list[Reached]], dealt: int, threshold: int) -> DataFrame:
    """lang, phrase, n of the sequences that reach the threshold, of those that ``known`` does not rule out, and of the phrase ''."""

    def count(batches):
        published = known()
        for lang, words in _chunks(batches, _COUNTED_CHARS):
            # The phrase '' has the hash 0.
            phrases, times, hashes = [b""], [np.array([len(words.starts)])], [np.zeros(1, np.uint64)]
            for n, at, found in _sequences(lang, words, published):
                if n == 1:
                    ids = numbers(words, at, found)
                first, often = distinct(ids, at, found, n)
                phrases += words.phrases(first, n)
                times.append(often)
                hashes.append(found[np.searchsorted(at, first)])
            hashes, times = np.concatenate(hashes), np.concatenate(times)
            order = _order(hashes)
            phrases, hashes, times = [phrases[k] for k in order.tolist()], hashes[order], times[order].astype(np.uint32)
            lengths = np.fromiter(map(len, phrases), np.uint32, len(phrases))
            slices, of = _runs(hashes >> np.uint64(64 - dealt))
            cut = [(a, a + k) for a, k in zip(slices.tolist(), of.tolist(), strict=True)]
            parts = [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (hashes, times, lengths)]
            said = pa.array([b"".join(phrases[a:b]) for a, b in cut], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((hashes[slices] >> np.uint64(64 - dealt)).astype(np.int32)), pa.array([lang] * len(cut), pa.string()), *parts, said], ["slice", "lang", "hashes", "times", "lengths", "said"])

    def add(batches):
        at, held = None, []

        def done():
            hashes, times, lengths = (np.frombuffer(b"".join(x), t) for x, t in zip(list(zip(*held, strict=True))[:3], (np.uint64, np.uint32, np.uint32), strict=True))
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            said = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(x[3] for x in held))])
            phrases, sums = frequent_phrases(hashes, times, said, threshold)
            return pa.RecordBatch.from_arrays([pa.array([at[1]] * len(phrases), pa.string()), phrases.cast(pa.binary()).cast(pa.string()), pa.array(sums, pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for k in range(len(batch)):
                if (now := (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())) != at:
                    if held:
                        yield done()
                    at, held = now, []
                held.append([batch.column(c)[k].as_buffer().to_pybytes() for c in range(2, 6)])
        if held:
            yield done()

    counted = texts.mapInArrow(count, "slice int, lang string, hashes binary, times binary, lengths binary, said binary")
    return counted.repartition("slice").sortWithinPartitions("slice", "lang").mapInArrow(add, "lang string, phrase string, n long")


def frequent_phrases(hashes: np.ndarray, times: np.ndarray, said: pa.Array, threshold: int) -> tuple[pa.Array, np.ndarray]:
    """Each distinct phrase of ``said`` whose times reach the threshold, and '', with their sums."""
    order = np.argsort(hashes)
    first, of = _runs(hashes[order])
    sums = np.add.reduceat(times[order].astype(np.int64), first)
    whole = (sums >= threshold) | (hashes[order[first]] == 0)  # what has the hash of none of these reaches nothing
    order, first, of, sums = order[np.repeat(whole, of)], order[first[whole]], of[whole], sums[whole]
    found = said.take(pa.array(first))
    if not pc.all(pc.equal(said.take(pa.array(order)), said.take(pa.array(np.repeat(first, of))))).as_py():  # two phrases of one hash
        exact: dict[bytes, int] = {}
        for phrase, n in zip(said.take(pa.array(order)).to_pylist(), times[order].tolist(), strict=True):
            exact[phrase] = exact.get(phrase, 0) + n
        found, sums = pa.array(list(exact), pa.large_binary()), np.fromiter(exact.values(), np.int64, len(exact))
    kept = np.flatnonzero((sums >= threshold) | (pc.binary_length(found).to_numpy() == 0))
    return found.take(pa.array(kept)), sums[kept]


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def score_phrases(counts: DataFrame, *, threshold: int = 30, subsumed: int = 80) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer candidate subsumes.

    A candidate's score is that of its weakest cut; one is dropped if a longer candidate
    that holds its words has ``subsumed`` percent of its occurrences at least.
    """
    frequent = counts.filter((F.col("phrase") != "") & (F.col("n") >= threshold)).select("lang", "phrase", F.col("n").alias("f"))
    total = counts.filter("phrase = ''").select("lang", "n")
    candidates = frequent.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).filter(F.size("w") > 1)
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    for part, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    wide = F.expr("2000000BD * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.withColumn("score", wide).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: joined(i, n))))
    inside = candidates.filter(F.size("w") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * subsumed))
    return kept.join(broadcast_if_small(total, 10_000), "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, *, threshold: int = 30, subsumed: int = 80, top: int = 2000, max_cells: int = MAX_CELLS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    counts = materialize(count_sequences(docs, threshold=threshold, max_cells=max_cells, text_col=text_col, lang_col=lang_col), "collocation-counts")
    scored = score_phrases(counts, threshold=threshold, subsumed=subsumed)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A lang's phrases are ranked in 64 shares first, so that only the best of each meet.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
