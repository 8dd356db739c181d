"""Near-duplicate groups of 64-bit SimHash fingerprints, by pivot distance tables.

Each distinct fingerprint gets a table of Hamming distances to many reference
fingerprints. By the triangle inequality two fingerprints within ``radius`` bits
differ by at most ``radius`` in every coordinate, so pairs beyond that in any
coordinate are discarded and only survivors are compared bit by bit.

Pairs meet in blocks of equal bits: cut in four bands, fingerprints that differ
in two bits agree in two bands at least, so six keys a fingerprint lose no link.
Blocks give a spanning forest, not their pairs. A block of more than
``max_block`` distinct fingerprints goes the exact way around: its members meet
at every value within one bit of them, which at most 65 fingerprints share and
which two fingerprints share if and only if they are within two bits.

Null texts have no words: fingerprint zero, linked like any other. Rows with a
null id are in groups but never name one unless the whole group is null.
Repeated rows give equal rows. An empty input gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import materialize

PIVOTS = 16
_CHUNK = 1 << 16


def simhash(text: str | None) -> int:
    """Unsigned fingerprint of a text's three-word shingles (XXH64, seed 42)."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[2:], strict=False) if len(words) > 2 else [(0, len(joined) + 1)]
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), and the columns ``extra``. No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    names = ["doc_id", "fp", *rows.columns[2:]]

    def run(batches):
        for batch in batches:
            found = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names)

    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{n} {t}" for n, t in rows.dtypes[2:]]]))


def pivot_values(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivot_values()[None, :])


def block_links(fps: np.ndarray, radius: int = 2) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (member, root)."""
    table = pivot_table(fps).astype(np.int8)
    left, right = [], []
    for i in range(len(fps) - 1):
        near = np.abs(table[i + 1 :] - table[i]).max(axis=1) <= radius
        near = i + 1 + np.flatnonzero(near)
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
        left.append(np.full(len(near), i))
        right.append(near)
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    kept = np.flatnonzero(label != np.arange(len(fps)))
    return [(int(fps[i]), int(fps[label[i]])) for i in kept]


def links(distinct: DataFrame, *, radius: int = 2, max_block: int = 1024) -> DataFrame:
    """Links (u, v) among distinct fingerprints (column fp) that connect what is within ``radius`` bits."""
    if radius != 2:
        raise ValueError("four bands of 16 bits find pairs within two bits")
    band = [F.expr(f"shiftright(fp, {16 * i}) & 65535L") for i in range(4)]
    keys = F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(band[i], 16)).bitwiseOR(band[j]) for k, (i, j) in enumerate(combinations(range(4), 2))])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(keyed.join(shared, "key"), "simhash-blocks")

    def compare(batches):
        held_key, held = None, []

        def linked():
            if len(held) > 1:
                yield from block_links(np.array(held, np.int64).view(np.uint64))

        def out(found):
            u, v = (np.array(c, np.uint64).view(np.int64) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            found = []
            for key, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != held_key:
                    found += linked()
                    held_key, held = key, []
                held.append(fp)
            if found:
                yield out(found)
        if found := list(linked()):
            yield out(found)

    small = members.filter(F.col("n") <= max_block).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.expr(f"shiftleft(1L, {i})")) for i in range(64)])
    around = members.filter(F.col("n") > max_block).select("fp").distinct().select("fp", F.explode(ball).alias("z"))
    meets = around.groupBy("z").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    large = meets.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u != v")
    return small.unionByName(large).distinct()


def component_labels(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (u, v): one row per vertex, (vertex, label), label its smallest vertex.

    Labels fall along edges and then jump to their label's label, so long chains
    halve. Each round is written to the shared folder; nothing is collected.
    """
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u != v").distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label")), f"{name}-labels")
    while True:
        heard = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("heard")), "v").groupBy("u").agg(F.min("heard").alias("heard"))
        fallen = labels.join(heard, "u").select("u", F.col("label").alias("old"), F.least("label", "heard").alias("low"))
        jump = labels.select(F.col("u").alias("low"), F.col("label").alias("beyond"))
        new = fallen.join(jump, "low").select("u", "old", F.least("low", "beyond").alias("label"))
        new = materialize(new, f"{name}-labels")
        labels = new.select("u", "label")
        if new.filter("old != label").isEmpty():
            return labels.withColumnRenamed("u", "vertex")


def _classes(own: DataFrame, max_block: int = 1024) -> DataFrame:
    """fp, rep (smallest id), label (of its component), one row per distinct fingerprint of ``own`` (doc_id, fp)."""
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    labels = component_labels(links(distinct.select("fp"), max_block=max_block), "simhash").withColumnRenamed("vertex", "fp")
    return materialize(distinct.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label")), "simhash-classes")


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_block: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), one row per row of ``docs``."""
    own = materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = _classes(own, max_block)
    linked = classes.filter("fp != label").select("label").distinct()
    least = classes.join(linked, "label").groupBy("label").agg(F.min("rep").alias("least"))
    known = classes.join(least, "label", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return own.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``docs``: that of the smallest id (null last), then of the smallest hash of its text.

    A row is known by its id and its text's hash, so rows of other groups that share its id, or have none, stay.
    """
    columns = docs.columns
    plain = {c: f"c{i}" for i, c in enumerate(columns)}  # names that cannot meet those of the key
    docs = docs.toDF(*plain.values())
    id_col, text_col = plain[id_col], plain[text_col]
    names = ["_id", "_hash", "_none"]
    key = [F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).isNull().alias("_none")]
    own = materialize(fingerprints(docs, id_col, text_col, extra=tuple(key[1:])), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("_id"), "_hash", "_none")
    kept = own.join(_classes(own).select("fp", "label"), "fp").groupBy("label").agg(F.min(order).alias("least")).select(*[F.col(f"least.{n}").alias(f"_kept{n}") for n in names])
    same = [k.eqNullSafe(F.col(f"_kept{n}")) for k, n in zip(key, names, strict=True)]
    rows = docs.join(kept, same[0] & same[1] & same[2], "left_semi")
    return rows.withColumns(dict(zip(names, key, strict=True))).dropDuplicates(names).drop(*names).toDF(*columns)
