"""Hard negatives by bit-sliced integer products.

Components become integers; a row's score for an anchor is their exact inner product.
Rows are taken apart into the bit-planes of their components (two's complement). The
planes are multiplied with an anchor from the most significant one on. After each, a
row's score is known to lie in an interval: what has been added up, plus the least and
the most that the lower planes can add. Rows whose interval cannot reach the anchor's
best so far, or none of its windows, are dropped; for the few that are left the last
planes give the exact score.

Anchors meet rows in tasks of (block of anchors, block of rows): the anchors of a block
are held, rows stream past them, and the best so far tighten what the next must
reach. A task gives a few rows for each anchor; these meet by anchor. Work is anchors
times rows, as asked; what a task holds is bounded by the block of anchors.

First each anchor's positives are found among the rows of its label, which gives the
windows of scores; then the negatives in each window among all others.

Rows with a null label or vector, or with a null or non-finite component, take no
part, nor those without an id. Missing components of shorter vectors count as zero.
Sums are exact: where doubles could not hold them, whole numbers of any size do; scaled
components beyond +-2**53 and scores beyond a long stop there. Of rows that share an id, the one of the smallest label, then the smallest vector, takes part. An empty
table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import materialize

#: Anchors of a block; rows of a block, about.
ANCHORS, ROWS = 512, 50_000
_LIMIT = 1 << 53
#: Rows that are scored at a time.
_ROWS_AT_ONCE = 4096
_PAIRS = "anchor_id long, slot int, other_id long, score long"


def scaled_rows(vectors: DataFrame, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", moved_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, x (array of long): the rows that take part, labels moved where the id is divisible by ``moved_every``."""
    number: Column = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), number.alias("v")).filter("vec_id is not null and label is not null and v is not null")
    rows = rows.filter("not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    moved = F.when(F.col("vec_id") % moved_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    bounded = F.expr(f"transform(v, x -> cast(greatest(-{_LIMIT}D, least({_LIMIT}D, floor({scale}D * x))) as bigint))")
    rows = rows.select("vec_id", moved.alias("label"), bounded.alias("x"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("one")).select("vec_id", "one.label", "one.x")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as a matrix, zeros behind those that are shorter."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class BitSlices:
    """Bit-planes of integer vectors, the most significant first; the first one is the sign's."""

    def __init__(self, x: np.ndarray):
        self.x = x
        most = int(max(np.abs(x).max(initial=0), 1))
        self.bits = most.bit_length() + 1  # with the sign's

    def plane(self, k: int, rows: np.ndarray | slice = slice(None), kind: type = np.float64) -> np.ndarray:
        return ((self.x[rows] >> k) & 1).astype(kind)

    def weight(self, k: int) -> int:
        return -(1 << k) if k == self.bits - 1 else 1 << k


def sliced_scores(rows: BitSlices, anchors: np.ndarray, reach, dense: float = 0.2):
    """(row, anchor, score) of all pairs that ``reach`` does not drop.

    ``reach(low, high, anchor)`` says for arrays of intervals whether the pair can still
    qualify. Planes are products of matrices while many pairs are left, and sums over
    the pairs themselves once less than ``dense`` of them are.
    """
    n, m = rows.x.shape[0], len(anchors)
    most = int(np.abs(anchors).max(initial=0)) * anchors.shape[1] << rows.bits
    kind = np.float64 if most < 1 << 53 else object
    q = anchors.astype(kind)
    lowest, highest = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)
    known = np.zeros((n, m), kind)
    every = np.broadcast_to(np.arange(m), (n, m))
    k = rows.bits - 1
    row = of = None
    while k >= 0:
        known += rows.weight(k) * (rows.plane(k, kind=kind) @ q.T)
        rest = (1 << k) - 1
        kept = reach(known + rest * lowest, known + rest * highest, every)
        k -= 1
        if kept.sum() <= dense * n * m or k < 0:
            row, of = np.nonzero(kept)
            break
    sums = known[row, of]
    while k >= 0:
        for a in range(0, len(row), 1 << 16):
            at = slice(a, a + (1 << 16))
            sums[at] += rows.weight(k) * (rows.plane(k, row[at], kind) * q[of[at]]).sum(axis=1)
        rest = (1 << k) - 1
        kept = reach(sums + rest * lowest[of], sums + rest * highest[of], of)
        row, of, sums = row[kept], of[kept], sums[kept]
        k -= 1
    if kind is object:
        sums = np.minimum(np.maximum(sums, -(1 << 63) + 1), (1 << 63) - 1)
    return row, of, sums.astype(np.int64)


def _best(slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` best of each slot: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, slot))
    held = slot[order]
    first = np.searchsorted(held, held, "left")
    return order[np.arange(len(held)) - first < k]


class _Held:
    """The best ``k`` so far of each slot; a slot is an anchor, or a window of one."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot = self.ids = self.scores = np.zeros(0, np.int64)
        self.least = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        slot, ids, scores = (np.concatenate(c) for c in ((self.slot, slot), (self.ids, ids), (self.scores, scores)))
        best = _best(slot, ids, scores, self.k)
        self.slot, self.ids, self.scores = slot[best], ids[best], scores[best]
        full = np.bincount(self.slot, minlength=len(self.least)) >= self.k
        worst = np.full(len(self.least), np.inf)
        np.minimum.at(worst, self.slot, self.scores)
        self.least = np.where(full, worst, -np.inf)


def _meet(rows: DataFrame, anchors: DataFrame, take, parts: int) -> DataFrame:
    """Deals anchors (vec_id, label, x, low, high: arrays, of windows) and rows to tasks; ``take`` makes the task's function of an anchor block."""
    blocks = max(1, math.ceil(anchors.count() / ANCHORS))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    some = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.array().cast("array<bigint>")
    asked = anchors.select(dealt(blocks, 1).alias("block"), some(parts).alias("part"), F.lit(0).alias("kind"), "vec_id", "label", "x", "low", "high")
    held = rows.select(some(blocks).alias("block"), dealt(parts, 2).alias("part"), F.lit(1).alias("kind"), "vec_id", "label", "x", none.alias("low"), none.alias("high"))
    both = asked.unionByName(held).repartition("block", "part").sortWithinPartitions("block", "part", "kind", "vec_id")

    def run(batches):
        at, waiting, task = None, [], None

        def finish():
            if task is not None and len(task.found.slot):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in task.result()], ["anchor_id", "slot", "other_id", "score"])

        for batch in batches:
            block, part, kind = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if hi <= lo:
                    continue
                if (now := (block[lo], part[lo])) != at:
                    yield from finish()
                    at, waiting, task = now, [], None
                piece = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    waiting.append(piece)
                elif waiting:
                    task = task or take(pa.Table.from_batches(waiting).combine_chunks())
                    task.add(piece)
        yield from finish()

    return both.mapInArrow(run, _PAIRS)


class _Task:
    """Anchors of a block, and the best rows that have passed."""

    def __init__(self, table: pa.Table, k: int):
        self.ids, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        xs = table.column("x").combine_chunks()
        self.width = int(max(xs.value_lengths().to_numpy(zero_copy_only=False).max(initial=0), 1))
        self.q = _matrix(xs, self.width)
        self.k = k

    def rows(self, piece: pa.RecordBatch):
        ids, labels = (piece.column(k).to_numpy() for k in (3, 4))
        xs = piece.column(5)
        width = int(max(xs.value_lengths().to_numpy(zero_copy_only=False).max(initial=0), self.width))
        x = _matrix(xs, width)[:, : self.width]  # what an anchor lacks is zero
        for of in np.split(np.argsort(labels, kind="stable"), np.flatnonzero(np.diff(np.sort(labels))) + 1):
            for a in range(0, len(of), _ROWS_AT_ONCE):
                at = of[a : a + _ROWS_AT_ONCE]
                yield int(labels[at[0]]), ids[at], BitSlices(x[at])


class _Positives(_Task):
    def __init__(self, table: pa.Table, k: int):
        super().__init__(table, k)
        self.found = _Held(len(self.ids), k)

    def add(self, piece: pa.RecordBatch) -> None:
        for label, ids, rows in self.rows(piece):
            mine = np.flatnonzero(self.labels == label)
            if len(mine):
                row, of, scores = sliced_scores(rows, self.q[mine], lambda low, high, a, mine=mine: high >= np.maximum(self.found.least[mine], self.reached(low))[a])
                other = ids[row] != self.ids[mine[of]]
                self.found.add(mine[of[other]], ids[row[other]], scores[other])

    def reached(self, low: np.ndarray) -> np.ndarray | float:
        """What the k best of these rows surely reach, by anchor; one more than k, as the anchor may be among them."""
        return np.partition(low, len(low) - self.k - 1, axis=0)[len(low) - self.k - 1] if low.ndim == 2 and len(low) > self.k else -np.inf

    def result(self):
        f = self.found
        return self.ids[f.slot], np.zeros(len(f.slot), np.int32), f.ids, f.scores


class _Negatives(_Task):
    def __init__(self, table: pa.Table, k: int):
        super().__init__(table, k)
        lows, highs = (table.column(c).combine_chunks() for c in ("low", "high"))
        n = lows.value_lengths().to_numpy(zero_copy_only=False)
        self.windows = int(n.max(initial=0))
        # A window that is not there lies above all scores.
        self.low, self.high = np.full((len(n), self.windows), np.inf), np.full((len(n), self.windows), -np.inf)
        there = np.arange(self.windows) < n[:, None]
        self.low[there], self.high[there] = (c.flatten().to_numpy(zero_copy_only=False) for c in (lows, highs))
        self.found = _Held(len(n) * self.windows, k)

    def add(self, piece: pa.RecordBatch) -> None:
        for label, ids, rows in self.rows(piece):
            mine = np.flatnonzero(self.labels != label)
            if not len(mine):
                continue
            least = self.found.least.reshape(len(self.ids), self.windows)

            def reach(low, high, a, mine=mine, least=least):
                kept = np.zeros(low.shape, bool)
                for w in range(self.windows):
                    # An interval that meets the window, and reaches the worst that the window holds.
                    kept |= (high >= np.maximum(self.low[mine, w], least[mine, w])[a]) & (low <= self.high[mine, w][a])
                return kept

            row, of, scores = sliced_scores(rows, self.q[mine], reach)
            for w in range(self.windows):
                inside = (scores >= self.low[mine[of], w]) & (scores <= self.high[mine[of], w])
                self.found.add(mine[of[inside]] * self.windows + w, ids[row[inside]], scores[inside])

    def result(self):
        f = self.found
        return self.ids[f.slot // self.windows], (f.slot % self.windows).astype(np.int32), f.ids, f.scores


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "other_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows whose id is divisible by ``every``.

    An anchor's positives are its best other rows of the same label. For each, the best
    rows of other labels whose score is ``least_percent`` percent of the positive's at
    least, and not above it.
    """
    rows = materialize(scaled_rows(vectors, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col), "negatives-rows")
    n = rows.count()
    # Never fewer blocks of rows than a few for each core, so that tasks are many and small.
    parts = max(1, math.ceil(n / ROWS), min(64, math.ceil(n / 128)))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    none = F.array().cast("array<bigint>")
    found = _meet(rows, anchors.withColumns({"low": none, "high": none}), lambda table: _Positives(table, positives), parts)
    known = materialize(_ranked(found, positives).select("anchor_id", "rank", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # A window's ends as whole numbers: 100 * s >= least * p, rounded up.
    window = F.struct("rank", F.expr(f"cast(ceil({least_percent}BD * cast(positive_score as decimal(20,0)) / 100BD) as bigint)").alias("low"), F.col("positive_score").alias("high"))
    windows = known.groupBy("anchor_id").agg(F.array_sort(F.collect_list(window)).alias("w"))
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "x", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    near = _ranked(_meet(rows, asked, lambda table: _Negatives(table, negatives), parts), negatives).withColumnRenamed("rank", "place")
    near = near.join(known.withColumn("slot", F.col("rank") - 1).drop("rank"), ["anchor_id", "slot"])
    return near.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
