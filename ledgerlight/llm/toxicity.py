"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Two interpolated Kneser-Ney models, of toxic and of ordinary texts, predict each
byte of a word from up to ``ORDER`` bytes before it (the word's start included).
The highest order is counted per class. What it has not seen, rare expressions
above all, both models smooth by the same continuation counts of the shorter
contexts, pooled over the classes, so a byte that neither class has met in its
context weighs the same in both and only evidence of a class moves the comparison.

The counts of all labelled words stay distributed. Every (context, byte) is dealt by
the three bytes nearest to it, so all contexts of three bytes and more that share them
meet in one task; the shorter ones are bounded by the alphabet and go through the
driver. Texts are scored where they are read by the exact values of the words that most
texts hold; all other words are looked up in the whole models by a shuffle.

A text is compared by its length-normalised log-likelihoods: the difference per
word over the whole text, the same over its ``TELLING`` most telling words (a few
toxic expressions in a long text count as much as in a short one), and the least of
those. A logistic function, fitted on labelled texts that the models have not
seen, turns these into a score.

Null and empty texts have no words: all differences are 0 and the score is that of
no evidence. Rows are scored one by one, so null ids, repeated rows and an empty
table need no care. With no labelled text of one of the classes every score is 0.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.byte_words import context, grams, key_of, most_held, words_of_texts
from ledgerlight.llm.cluster import broadcast_if_small, free_name, materialize, shipped

ORDER = 7
DISCOUNT = 0.75
#: Words of a text that are compared by themselves, and the bits beyond which a word says no more.
TELLING, CLEAR = 3, 10.0
#: Of each class a sample of at most so many labelled documents (those of the smallest hash), and the share of it that
#: the models do not see: the logistic function is fitted on that share. All other labelled documents are counted.
TRAIN_DOCUMENTS = 6000
CALIBRATION = 0.35
#: Words whose values go to every task, at most: those that most labelled documents hold. All others are looked up by a shuffle.
MODEL_WORDS = 250_000
#: Bytes nearest to a gram by which it is dealt to tasks; contexts of fewer bytes go through the driver.
NEAR = 3
#: Values of words are whole numbers of 1 / UNIT bits, so that sums depend on no order.
UNIT = 1 << 24
#: Rejected rows that are broadcast, at most; more are joined by a shuffle.
REJECTED_ROWS = 200_000
#: Bits of the filter of labelled ids that goes to every task, at most: beyond that it keeps more texts, none wrongly.
FILTER_BITS = 1 << 25
#: Grams that one task of the models holds, about.
TASK_GRAMS = 1_000_000


def discounts(counts: np.ndarray, n: list[float] | None = None) -> np.ndarray:
    """Kneser-Ney discounts of counts: one for counts of 1, of 2 and above, estimated from how many counts there are of 1 to 4 (``n``, if ``counts`` are not all)."""
    n = n or [float((counts == c).sum()) for c in (1, 2, 3, 4)]
    if not all(n):
        return np.minimum(counts, DISCOUNT)
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, *(min(c, max(DISCOUNT, c - (c + 1) * y * n[c] / n[c - 1])) for c in (1, 2, 3))]
    return np.array(d)[np.minimum(counts, 3).astype(int)]


def _raw(words: list[str]) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") + b"\0" for w in words]


class KneserNey:
    """What each (context, byte) of full length adds to log2 P(toxic model) - log2 P(ordinary model)."""

    def __init__(self, words: list[str], counts: np.ndarray, order: int = ORDER):
        """``counts``: for each word, in how many texts of the ordinary and of the toxic class it stands."""
        raw = _raw(words)
        self._fit(*self._distinct(raw, counts, order), order) if raw else self._empty(order)

    @classmethod
    def of_grams(cls, byte: np.ndarray, window: np.ndarray, length: np.ndarray, held: np.ndarray, low: list, totals: dict[int, list[float]], order: int = ORDER) -> KneserNey:
        """The models of all grams that share their nearest bytes: ``low`` and ``totals`` hold what other grams must tell, chances of shorter contexts and counts of counts by level."""
        self = cls.__new__(cls)
        if len(byte):
            self._fit(*cls._together(byte, window, length, held), order, low, totals)
        else:
            self._empty(order)
        return self

    def _empty(self, order: int) -> None:
        self.order = order
        self.keys = self.nodes = np.zeros(0, np.uint64)
        self.gain = self.escape = np.zeros(0)

    def _fit(self, keys, byte, window, length, held, order: int, low: list = (), totals: dict[int, list[float]] = {}) -> None:  # noqa: B006
        self.order, self.keys = order, keys
        shared = self._shared(byte, window, length, order, low, totals)
        self.nodes, node = np.unique(context(window, length), return_inverse=True)
        seen = np.stack([np.bincount(node, held[:, c], len(self.nodes)) for c in (0, 1)], 1)
        taken = np.stack([discounts(held[:, c], totals.get(order + c)) for c in (0, 1)], 1)
        given = np.stack([np.bincount(node, taken[:, c], len(self.nodes)) for c in (0, 1)], 1)
        lower = np.full(len(self.keys), 1 / 257)
        for k in range(order):
            now = np.flatnonzero(length == k + 1)
            lower[now] = self._look(*shared[k], key_of(context(window[now], k), byte[now]))
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(seen > 0, given / seen, 1.0)
            chance = np.where(seen[node] > 0, (held - taken) / seen[node], 0) + rest[node] * lower[:, None]
        self.gain = np.log2(chance[:, 1]) - np.log2(chance[:, 0])
        self.escape = np.log2(rest[:, 1]) - np.log2(rest[:, 0])

    @staticmethod
    def _together(byte, window, length, held) -> tuple[np.ndarray, ...]:
        keys, first, at = np.unique(key_of(context(window, length), byte), return_index=True, return_inverse=True)
        return keys, byte[first], window[first], length[first], np.stack([np.bincount(at, held[:, c], len(first)) for c in (0, 1)], 1)

    @staticmethod
    def _distinct(raw: list[bytes], counts: np.ndarray, order: int, chunk: int = 40_000) -> tuple[np.ndarray, ...]:
        """Of the distinct (context, byte) pairs, sorted keys, bytes, windows, lengths and counts of both classes; equal ones of a chunk of words go together first."""
        parts = []
        for lo in range(0, len(raw), chunk):
            owner, byte, window, length = grams(raw[lo : lo + chunk], order)
            parts.append(KneserNey._together(byte, window, length.astype(np.int8), counts[lo + owner])[1:])
        return KneserNey._together(*(np.concatenate(p) for p in zip(*parts, strict=True)))

    @staticmethod
    def continued(byte: np.ndarray, window: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Keys, bytes and windows of the (context of ``k`` bytes, byte) that follow longer ones, and in how many contexts one byte longer each does."""
        there = np.flatnonzero(length > k)
        # Each distinct (longer context, byte) is one continuation of (context, byte).
        _, one = np.unique(key_of(context(window[there], k + 1), byte[there]), return_index=True)
        there = there[one]
        keys, first, times = np.unique(key_of(context(window[there], k), byte[there]), return_index=True, return_counts=True)
        return keys, byte[there[first]], window[there[first]], times.astype(float)

    @classmethod
    def level(cls, k: int, keys: np.ndarray, byte: np.ndarray, window: np.ndarray, times: np.ndarray, shared: list, n: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and chances of the contexts of ``k`` bytes, from their counts and the chances ``shared`` of the shorter ones."""
        _, node = np.unique(context(window, k), return_inverse=True)
        total, taken = np.bincount(node, times), discounts(times, n)
        rest = np.bincount(node, taken) / np.maximum(total, 1)
        below = np.full(len(keys), 1 / 257) if k == 0 else cls._look(*shared[k - 1], key_of(context(window, k - 1), byte))
        return keys, (times - taken) / total[node] + rest[node] * below if len(keys) else below

    @classmethod
    def _shared(cls, byte: np.ndarray, window: np.ndarray, length: np.ndarray, order: int, low: list, totals: dict[int, list[float]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Continuation probabilities of both classes together: for each context length, sorted keys and chances."""
        shared = list(low)
        for k in range(len(low), order):
            shared.append(cls.level(k, *cls.continued(byte, window, length, k), shared, totals.get(k)))
        return shared

    @staticmethod
    def _look(keys: np.ndarray, chance: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Chances of keys that the table is known to hold."""
        return chance[np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))] if len(keys) else np.full(len(wanted), 1 / 257)

    def differences(self, words: list[str]) -> np.ndarray:
        """log2 P(word | toxic) - log2 P(word | ordinary), one column."""
        raw = _raw(words)
        if not len(self.keys) or not raw:
            return np.zeros((len(raw), 1))
        owner, byte, window, length = grams(raw, self.order)
        return np.bincount(owner, self.bits(byte, window, length), len(raw))[:, None]

    def bits(self, byte: np.ndarray, window: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What each gram adds: 0 where its context is unknown."""
        if not len(self.keys):
            return np.zeros(len(byte))
        full = context(window, length)
        key = key_of(full, byte)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        node = np.minimum(np.searchsorted(self.nodes, full), len(self.nodes) - 1)
        return np.where(self.keys[at] == key, self.gain[at], np.where(self.nodes[node] == full, self.escape[node], 0.0))


def features(bits: np.ndarray) -> tuple[float, float, float]:
    """Of the differences of a text's words: per word of the whole text, per word of the most telling few, and the least of these."""
    n = len(bits)
    if not n:
        return 0.0, 0.0, 0.0
    top = np.sort(np.partition(bits, n - TELLING)[-TELLING:] if n > TELLING else np.r_[np.zeros(TELLING - n), bits])
    top = np.clip(top, 0.0, CLEAR)
    return float(np.clip(bits.mean(), -CLEAR, CLEAR)), float(top.mean()), float(top[0])


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression, by Newton's method."""
    x, w = _scaled(x), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.r_[0.0, np.full(len(w) - 1, ridge)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


_GRAMS = "kind int, window long, code int, n0 long, n1 long"


def _arrow(schema: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def _dealt(rows: DataFrame, about: int) -> DataFrame:
    """Rows with equal nearest bytes in one partition; ``about`` so many rows there are."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-about // TASK_GRAMS))
    return rows.repartition(n, F.col("window").bitwiseAND(F.lit((1 << 8 * NEAR) - 1)))


def _counted_grams(per_word: DataFrame) -> DataFrame:
    """All distinct grams of the words (word, n0, n1) with their counts (kind -1), and what levels tell of themselves beyond their task.

    kind k from NEAR to ORDER - 1, and ORDER and ORDER + 1 for the classes: in n0, how many
    counts are ``code`` (1 to 4) on that level. kind NEAR - 1: contexts of that many bytes, in
    n0 their continuations. Grams of shorter contexts are among those of kind -1.
    """
    types = {"kind": pa.int32(), "window": pa.int64(), "code": pa.int32(), "n0": pa.int64(), "n1": pa.int64()}

    def rows(kind, window, code, n0, n1):
        for a in range(0, len(window), 50_000):
            part = [np.asarray(c[a : a + 50_000]).astype(np.int64) for c in (window, code, n0, n1)]
            yield _arrow(types, np.full(len(part[0]), kind, np.int32), part[0], part[1].astype(np.int32), *part[2:])

    def gram_rows(byte, window, length, held):
        yield from rows(-1, window, length.astype(np.int32) << 8 | byte, held[:, 0], held[:, 1])

    def explode(batches):
        words, counts = [], []

        def told():
            yield from gram_rows(*KneserNey._distinct(_raw(words), np.concatenate(counts), ORDER)[1:])

        for batch in batches:
            words += batch.column(0).to_pylist()
            counts.append(np.stack([batch.column(c).to_numpy().astype(float) for c in (1, 2)], 1))
            if len(words) >= 40_000:
                yield from told()
                words, counts = [], []
        if words:
            yield from told()

    def combine(batches):
        found = _grams_of(batches)
        if not found:
            return
        byte, window, length, held = KneserNey._together(*found)[1:]
        yield from gram_rows(byte, window, length, held)
        levels = {k: KneserNey.continued(byte, window, length, k)[3] for k in range(NEAR, ORDER)} | {ORDER + c: held[:, c] for c in (0, 1)}
        for k, n in levels.items():
            yield from rows(k, np.zeros(4), np.arange(1, 5), [int((n == c).sum()) for c in (1, 2, 3, 4)], np.zeros(4))
        _, byte, window, times = KneserNey.continued(byte, window, length, NEAR - 1)
        yield from rows(NEAR - 1, window & np.uint64((1 << 8 * (NEAR - 1)) - 1), byte, times, np.zeros(len(byte)))

    about = 10 * per_word.count()
    return materialize(_dealt(per_word.select("word", "n0", "n1").mapInArrow(explode, _GRAMS), about).mapInArrow(combine, _GRAMS), "toxicity-grams")


def _grams_of(batches) -> tuple[np.ndarray, ...] | None:
    """byte, window, length and counts of the grams in batches of ``_GRAMS``."""
    parts = [[b.column(i).to_numpy() for i in (1, 2, 3, 4)] for b in batches]
    if not parts:
        return None
    window, code, n0, n1 = (np.concatenate(p) for p in zip(*parts, strict=True))
    return (code & 255).astype(np.uint8), window.astype(np.uint64), (code >> 8).astype(np.int8), np.stack([n0, n1], 1).astype(float)


def _levels(found: DataFrame) -> tuple[list, dict[int, list[float]]]:
    """Chances of the contexts of fewer than NEAR bytes, and counts of counts of the other levels. What the driver gets is bounded by the combinations of NEAR bytes."""
    told = found.filter("kind >= 0").groupBy("kind", "window", "code").agg(F.sum("n0").alias("n")).toArrow()
    kind, window, code, n = (told.column(i).to_numpy() for i in range(4))
    totals = {k: [float(n[(kind == k) & (code == c)].sum()) for c in (1, 2, 3, 4)] for k in range(NEAR, ORDER + 2)}
    first = found.filter(f"kind = -1 and shiftright(code, 8) < {NEAR}").select("window", "code").toArrow()
    starts, start_code = first.column(0).to_numpy().astype(np.uint64), first.column(1).to_numpy()
    last = kind == NEAR - 1
    byte, window, times, tables = code[last].astype(np.uint8), window[last].astype(np.uint64), n[last].astype(float), []
    for k in range(NEAR - 1, -1, -1):
        keys, order = np.unique(key_of(context(window, k), byte), return_index=True)
        byte, window, times = byte[order], window[order], times[order]
        tables.append((k, keys, byte, window, times))
        # One byte shorter: what follows these contexts, and those of their length that begin a word.
        here = (start_code >> 8) == k
        byte, window = np.concatenate([byte, (start_code[here] & 255).astype(np.uint8)]), np.concatenate([window, starts[here]])
        if k:
            _, byte, window, times = KneserNey.continued(byte, window, np.full(len(byte), k), k - 1)
    low: list = []
    for table in reversed(tables):
        low.append(KneserNey.level(*table, low))
    return low, totals


def _starts(found: DataFrame, levels: tuple) -> KneserNey:
    """The models of contexts of NEAR bytes at most, which begin words: bounded as ``_levels``."""
    told = found.filter(f"kind = -1 and shiftright(code, 8) <= {NEAR}").select(*[c.split()[0] for c in _GRAMS.split(", ")]).toArrow().to_batches()
    grams_ = _grams_of(told)
    return KneserNey.of_grams(*(grams_ or (np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros((0, 2)))), *levels)


def word_values(found: DataFrame, levels: tuple, words: DataFrame) -> DataFrame:
    """word, value: what the whole models of the grams ``found`` say of each of the distinct ``words``, in 1 / UNIT bits."""
    types = {"kind": pa.int32(), "window": pa.int64(), "code": pa.int32(), "n0": pa.int64(), "n1": pa.int64()}
    frozen, starts = shipped(words.sparkSession, levels), shipped(words.sparkSession, _starts(found, levels))

    def begin(batches):
        model = starts()
        for batch in batches:
            raw = _raw(batch.column(0).to_pylist())
            owner, byte, window, length = grams(raw, ORDER)
            near = length <= NEAR
            bits = np.rint(model.bits(byte[near], window[near], length[near]) * UNIT) if raw else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(owner[near], bits, len(raw)).astype(np.int64))], ["word", "begun"])

    numbered = materialize(words.select("word").mapInArrow(begin, "word string, begun long").withColumn("id", F.monotonically_increasing_id()), "toxicity-asked")

    def ask(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for a in range(0, len(ids), 5000):
                parts = grams(_raw(batch.column(0).slice(a, 5000).to_pylist()), ORDER)
                owner, byte, window, length = (p[parts[3] > NEAR] for p in parts)
                zero = np.zeros(len(owner), np.int64)
                yield _arrow(types, np.zeros(len(owner), np.int32), window.astype(np.int64), length.astype(np.int32) << 8 | byte, ids[a + owner], zero)

    def answer(batches):
        known, asked = [], []
        for b in batches:
            ours = b.column(0).to_numpy() < 0
            known.append(b.filter(pa.array(ours)))
            asked.append(b.filter(pa.array(~ours)))
        if not sum(b.num_rows for b in asked):
            return
        byte, window, length, held = _grams_of(known)
        model = KneserNey.of_grams(byte, window, length, held, *frozen())
        byte, window, length, held = _grams_of(asked)
        ids = np.concatenate([b.column(3).to_numpy() for b in asked])
        bits = np.rint(model.bits(byte, window, length) * UNIT).astype(np.int64)
        told = np.flatnonzero(bits)
        order = told[np.argsort(ids[told], kind="stable")]
        if not len(order):
            return
        start = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        sums = np.add.reduceat(bits[order], start)
        for a in range(0, len(start), 50_000):
            yield _arrow({"id": pa.int64(), "value": pa.int64()}, ids[order][start[a : a + 50_000]], sums[a : a + 50_000])

    # Counted grams have no kind but -1 here; asked ones carry the word's number in n0.
    both = found.filter(f"kind = -1 and shiftright(code, 8) > {NEAR}").unionByName(numbered.select("word", "id").mapInArrow(ask, _GRAMS))
    # Written between, so that the disk holds what was asked or what is summed, not both.
    told = materialize(_dealt(both, found.count() + 7 * numbered.count()).mapInArrow(answer, "id long, value long"), "toxicity-told")
    values = told.groupBy("id").agg(F.sum("value").alias("value"))
    return numbered.join(values, "id", "left").select("word", (F.col("begun") + F.coalesce("value", F.lit(0).cast("long"))).alias("value"))


class PublishedWords:
    """Values of the words that most texts hold, in 1 / UNIT bits."""

    def __init__(self, words: list[str], values: list[int]):
        self._place = dict(zip(words, range(len(words)), strict=True))
        self._values = np.array([*values, 0], np.int64)

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for words that are not published), and whether each is published."""
        at = np.fromiter(map(self._place.get, words, repeat(-1)), np.int64, len(words))
        return self._values[at], at >= 0

    def differences(self, words: list[str]) -> np.ndarray:
        """log2 P(word | toxic) - log2 P(word | ordinary), one column; 0 for words that are not published."""
        return self.known(words)[0][:, None] / UNIT


class ToxicityModel:
    """The published words, all grams and their levels, and the weights of the logistic function (constant first; None: a class is unknown)."""

    def __init__(self, language: PublishedWords, found: DataFrame, levels: tuple, weights: np.ndarray | None):
        self.language, self.found, self.levels, self.weights = language, found, levels, weights


def _words_in(texts: DataFrame) -> DataFrame:
    """The distinct words of (text)."""

    def run(batches):
        for batch in batches:
            for some in words_of_texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list({w for words in some for w in words}), pa.string())], ["word"])

    return texts.select("text").mapInArrow(run, "word string").distinct()


def _features_of(texts: DataFrame, model: ToxicityModel, values: DataFrame | None = None) -> DataFrame:
    """x (the features) instead of the text of (text, other columns). Texts stay where they are; words that are not published are shuffled by themselves. ``values`` (word, value) of all of them may be known."""
    frozen, kept = shipped(texts.sparkSession, model.language), texts.columns[1:]
    schema = ", ".join([*[f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept], "_row long, _n long, _total long, _top array<long>, _rest array<string>"])

    def run(batches):
        language, row = frozen(), count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            at = 0
            for some in words_of_texts(batch.column(0)):
                n, flat = np.fromiter(map(len, some), np.int64, len(some)), list(chain.from_iterable(some))
                value, known = language.known(flat)
                owner, sums, end = np.repeat(np.arange(len(n)), n), np.r_[0, np.cumsum(value)], np.cumsum(n)
                # Only values above 0 can be among those that tell.
                told = np.flatnonzero(value > 0)
                told = told[np.lexsort((value[told], owner[told]))]
                after = np.searchsorted(owner[told], owner[told], "right") - np.arange(len(told))
                lists = [(told[after <= TELLING], lambda i: pa.array(value[i])), (np.flatnonzero(~known), lambda i: pa.array([flat[k] for k in i], pa.string()))]
                made = [pa.array([next(row) for _ in some], pa.int64()), pa.array(n), pa.array(sums[end] - sums[end - n])]
                for places, held in lists:
                    of = np.r_[0, np.cumsum(np.bincount(owner[places], minlength=len(n)))].astype(np.int32)
                    made.append(pa.ListArray.from_arrays(of, held(places)))
                own = [c.slice(at, len(some)) for c in batch.columns[1:]]
                at += len(some)
                yield pa.RecordBatch.from_arrays([*own, *made], [*kept, "_row", "_n", "_total", "_top", "_rest"])

    read = materialize(texts.mapInArrow(run, schema), "toxicity-texts")
    rest = read.select("_row", F.explode("_rest").alias("word"))
    values = materialize(word_values(model.found, model.levels, rest.select("word").distinct()), "toxicity-values") if values is None else values
    per_row = rest.join(values, "word").groupBy("_row").agg(F.sum("value").alias("_more"), F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, TELLING).alias("_tops"))
    met = read.drop("_rest").join(per_row, "_row", "left")
    bits = lambda c: F.least(F.greatest(c / F.lit(float(UNIT)), F.lit(0.0)), F.lit(CLEAR))
    top = F.sort_array(F.concat("_top", F.coalesce("_tops", F.array().cast("array<long>")), F.array_repeat(F.lit(0).cast("long"), TELLING)), asc=False)
    mean = F.when(F.col("_n") > 0, (F.col("_total") + F.coalesce("_more", F.lit(0))) / F.lit(float(UNIT)) / F.col("_n")).otherwise(0.0)
    most = [bits(F.col("_best")[i]) for i in range(TELLING)]
    x = F.array(F.least(F.greatest(mean, F.lit(-CLEAR)), F.lit(CLEAR)), sum(most[1:], most[0]) / TELLING, most[-1])
    return met.withColumn("_best", top).select(*kept, x.alias("x"))


def _chance(model: ToxicityModel) -> Column:
    z = F.lit(float(model.weights[0]))
    for i, v in enumerate(model.weights[1:]):
        z = z + F.lit(float(v)) * F.col("x")[i]
    return 1 / (1 + F.exp(-z))


def _sampled(labelled: DataFrame, max_documents: int) -> Column:
    """Whether a row is one of about ``max_documents`` rows of its label at most: those of the smallest hash. The cut is found from counts."""
    sizes = {r[0]: r[1] for r in labelled.groupBy("label").agg(F.count(F.lit(1))).collect()}
    share = F.when(F.col("label") == 1, min(1.0, max_documents / max(1, sizes.get(1, 0)))).otherwise(min(1.0, max_documents / max(1, sizes.get(0, 0))))
    return F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 20)) / float(1 << 20) <= share


def _sample(labelled: DataFrame, max_documents: int) -> DataFrame:
    return labelled.filter(_sampled(labelled, max_documents))


def maybe_labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, other columns) whose id is one of ``ids`` (doc_id), and few others: those whose hash falls on a bit that an id sets. Nothing is shuffled but hashes of ids."""
    n = min(FILTER_BITS, 1 << (16 * ids.count() + 64).bit_length())
    hashed = lambda df: df.withColumn("_bit", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    set_ = hashed(ids.filter("doc_id IS NOT NULL").select("doc_id")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")).alias("_bits"))
    met = hashed(docs).join(F.broadcast(set_), F.shiftright("_bit", 6) == F.col("_word"))
    return met.filter("shiftrightunsigned(_bits, CAST(_bit & 63 AS INT)) & 1 = 1").select(*docs.columns)


def with_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, toxic of the documents that ``labels`` (doc_id, toxic) knows. Both sides are shuffled by id, whatever their size; most texts without a label stay where they are."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return maybe_labelled(texts, known).join(known.hint("merge"), "doc_id")


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_documents: int = TRAIN_DOCUMENTS, model_words: int = MODEL_WORDS, max_words: int = 400_000) -> ToxicityModel:
    """Fits the models on ``labelled`` (labels 0 and 1; rows with another or no label, or no text, are left out).

    Tasks count in how many texts of a class each word stands, over all rows but
    those of the bounded calibration sample. Every word is in the models. The driver
    gets the values of about ``model_words`` words at most, those of the most texts,
    what ``_levels`` asks for, and a few numbers per calibration text.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1) & F.col("text").isNotNull())
    apart = F.coalesce(_sampled(rows, max_documents) & (F.pmod(F.xxhash64(F.lit(13), "key"), F.lit(1000)) < int(1000 * CALIBRATION)), F.lit(False))

    def tables(held):
        for label, words in enumerate(held):
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([label] * len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "label", "n"])

    def count(batches):
        held = Counter(), Counter()
        for batch in batches:
            if len(held[0]) + len(held[1]) > max_words // 2:
                yield from tables(held)
                held = Counter(), Counter()
            labels = iter(batch.column(2).to_pylist())
            for texts in words_of_texts(batch.column(1)):
                for words, label in zip(texts, labels, strict=False):
                    held[label].update(set(words))
        yield from tables(held)

    counted = rows.filter(~apart).mapInArrow(count, "word string, label long, n long")
    per_word = counted.groupBy("word").agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    per_word = materialize(per_word, "toxicity-words")
    found = _counted_grams(per_word)
    levels = _levels(found)
    classes = per_word.agg(F.sum("n0"), F.sum("n1")).first()
    # The sample's ids are few: by them it is read without a shuffle of all texts.
    ids = [r[0] for r in rows.filter(apart).select("key").distinct().collect()]
    sample = rows.filter(F.col("key").isin(ids)).filter(apart).select("text", "label")
    most = most_held(per_word, F.col("n0") + F.col("n1"), model_words).select("word")
    values = materialize(word_values(found, levels, most.unionByName(_words_in(sample)).distinct()), "toxicity-values")
    published = values.join(most, "word", "left_semi").toArrow()
    language = PublishedWords(published.column("word").to_pylist(), published.column("value").to_pylist())
    del published
    model = ToxicityModel(language, found, levels, None)
    if not all(classes):
        return model
    seen = _features_of(sample, model, values).toArrow()
    y, x = seen.column("label").to_numpy().astype(float), np.array(seen.column("x").to_pylist(), float).reshape(-1, 3)
    if 0 < y.sum() < len(y):
        order = np.lexsort((*x.T, y))
        model.weights = fit_logistic(x[order], y[order])
    return model


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on), one row per row of ``docs``."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    found = rows.select("doc_id", F.lit(0.0).alias("score")) if model.weights is None else _features_of(rows, model).select("doc_id", _chance(model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a model of the labelled ones does not call toxic, with the same columns.

    Each row is judged by its own text: rejected are pairs of an id and a text's digest, so
    a null id, or one that other rows share, decides about no other text.
    """
    model = train(with_labels(docs, labels, id_col=id_col, text_col=text_col))
    if model.weights is None:
        return docs
    id_, digest = (free_name(n, docs.columns) for n in ("id", "digest"))
    # A null id is told from any other by its prefix.
    keys = {id_: F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), digest: F.md5(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"))}
    keyed = docs.withColumns(keys)
    judged = _features_of(keyed.select(F.col(text_col).alias("text"), id_, digest), model).filter(_chance(model) >= threshold).select(id_, digest)
    rejected = broadcast_if_small(materialize(judged.distinct(), "toxicity-rejected"), REJECTED_ROWS)
    return keyed.join(rejected, [id_, digest], "left_anti").select(*docs.columns)
