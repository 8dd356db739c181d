"""Packing documents into sequences of a fixed number of tokens.

The work is split by size. Tasks encode texts and keep one slim row per piece.
The driver sees only the histogram of piece lengths (at most ``capacity`` rows)
and plans on it: a configuration linear program, solved by multiplicative
weights, whose columns a knapsack dynamic program prices. Steps are rounded down to
whole sequences as they are taken; what the last rounds would pack poorly is filled
best-fit, longest first. It never takes more sequences than best-fit alone. The plan
is a list of runs "this configuration, k times". Pieces are then numbered within their length,
over salted groups, and each number looks up its place in the plan.

Documents longer than ``capacity`` are cut so that only their first piece may be
shorter. Null texts are empty: their one piece is the end id. Null ids and
repeated rows are packed like any other row. An empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import materialize
from ledgerlight.llm.subword import UnitEncoder, encode_documents

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. No shuffle."""

    def cut(batches):
        encoder = UnitEncoder(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows = []
            for i, ids in encode_documents(encoder, batch.column(1), end_id):
                raw, n = ids.astype("<u4").tobytes(), len(ids)
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                lo = 0
                for piece, hi in enumerate(ends):
                    rows.append((doc_ids[i], piece, lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi])))
                    lo = hi
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: how often each length stands in the most valuable configuration; of equal ones that of longer pieces.

    ``lengths`` rise. Values are laid out by what a length leaves of the capacity, so
    that the best last piece for a room is one sum of two stretches of memory.
    """
    worth = np.full(capacity + 1, -1.0)
    worth[capacity - lengths] = values
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(int(lengths[0]), capacity + 1):
        gains = best[:room] + worth[capacity - room : capacity]
        before = int(gains.argmax())
        best[room] = best[room - 1]
        if gains[before] > best[room] + 1e-12:
            best[room], last[room] = gains[before], room - before
    times, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        times[np.searchsorted(lengths, last[room])] += last[room] > 0
        room -= int(last[room]) or 1
    return times


def fullest(lengths: np.ndarray, values: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration that pricing finds among the pieces that are left; what a scarce length leaves open is priced again."""
    times, room = np.zeros(len(lengths), np.int64), capacity
    while len(some := np.flatnonzero((left - times >= 1) & (lengths <= room))):
        more = np.minimum(price(lengths[some], values[some], room), (left - times)[some]).astype(np.int64)
        times[some] += more
        room -= int(more @ lengths[some])
    return times


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float = 0.3) -> list[tuple[int, np.ndarray]]:
    """Whole solution of the covering program: (times, configuration) in the order taken; every piece is covered once.

    Each round prices the best configuration under the current weights, and the step is
    as wide as the program's demands allow: until the scarcest length of it is covered,
    rounded down to whole sequences. The weights of what it covers then fall
    exponentially by the share covered, so that pricing turns to what lags behind. Longer
    pieces weigh more at first: they are the hard ones. A round uses up a length or all
    but less than one configuration's worth of it, so rounds follow the number of
    lengths, not of pieces.
    """
    weights = lengths / capacity * (1 + lengths / capacity)
    left, taken = counts.copy(), []
    while left.any():
        times = fullest(lengths, weights, left, capacity)
        held = times > 0
        step = int((left[held] // times[held]).min())
        taken.append((step, times))
        left -= step * times
        weights[held] *= np.exp(-rate * step * times[held] / counts[held])
    return taken


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Best-fit decreasing of pieces by length: (k, configuration) until nothing is left."""
    left, runs = left.copy(), []
    while left.any():
        times, room = np.zeros(len(lengths), np.int64), capacity
        while len(fits := np.flatnonzero((left > times) & (lengths <= room))):
            times[fits[-1]] += 1
            room -= int(lengths[fits[-1]])
        held = times > 0
        k = int((left[held] // times[held]).min())
        runs.append((k, times))
        left -= k * times
    return runs


def plan_packing(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Runs (k, lengths): k sequences, each holding these lengths in this order.

    The last configurations are made of what others left, and may be poor ones. So the
    program's rounds are also cut short at a few places, with the rest packed best-fit:
    of the plans with the fewest sequences the one that keeps most rounds is taken.
    """
    runs: list[tuple[int, list[int]]] = []
    if n := histogram.get(capacity, 0):
        runs.append((n, [capacity]))
    lengths = np.array(sorted(x for x in histogram if x < capacity and histogram[x]), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    if not len(lengths):
        return runs
    solved = solve_configurations(lengths, counts, capacity)
    plans = []
    for twentieths in range(20, -1, -1):
        kept = solved[: len(solved) * twentieths // 20]
        left = counts - sum((k * times for k, times in kept), np.zeros_like(counts))
        plans.append(kept + best_fit(lengths, left, capacity))
    plan = min(plans, key=lambda p: sum(k for k, _ in p))
    return runs + [(k, [int(x) for x, n in zip(lengths[::-1], times[::-1], strict=True) for _ in range(n)]) for k, times in plan]


def _places(runs: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: first number of each slot, its first sequence, its offset."""
    slots: dict[int, list] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for k, held in runs:
        offset = 0
        for length in held:
            slots.setdefault(length, []).append((seen.get(length, 0), sequence, offset))
            seen[length] = seen.get(length, 0) + k
            offset += length
        sequence += k
    return {x: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for x, s in slots.items()}


def number_within(df: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """Adds ``number``: 0, 1, 2, ... within each key, though a key may hold most rows.

    Rows are salted by a hash of ``order``; counts per (key, salt) are added up
    before, and each small group numbers its own rows from its offset on. The
    counts are at most keys x salts rows; callers bound the keys.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_salt").orderBy(*order)
    # Dealt by key and salt, as the last window needs it; else the join would take the first window's dealing by key alone.
    return (
        salted.join(offsets.repartition(key, "_salt").hint("merge"), [key, "_salt"])
        .withColumn("number", F.col("_before") + F.row_number().over(own) - 1)
        .drop("_salt", "_n", "_before")
    )


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with ``sequence_id`` and ``offset`` added to ``cut_pieces``."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan_packing(histogram, capacity))

    def place(batches):
        for batch in batches:
            length, number = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    first, base, off = places[int(length[at[0]])]
                    slot = np.searchsorted(first, number[at], "right") - 1
                    sequence[at], offset[at] = base[slot] + number[at] - first[slot], off[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    salts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = number_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], salts)
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
