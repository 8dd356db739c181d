"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves; each half has a codebook of its own, fitted on a
bounded sample, and a pair of centroids names a cell. Every vector is indexed in
its cell. A query goes through the pairs in order of their summed distances, with
a heap over the two sorted lists, until the cells hold a given share of all
vectors; those entries are ranked by their exact distance, in double precision.
The share is measured: it is the least by which queries of the sample find
``recall`` of their true neighbours in the sample, so data without clusters are
searched further than data with them.

Entries and queries meet in blocks of cells with one first centroid; many entries
are dealt out to as many blocks as they need, and a query is sent once to each
block in which it visits cells. Blocks keep their own nearest; only these meet by
query.

Vectors that are null, zero, of another length than the longest, or hold a null or
non-finite component take no part, nor do rows without an id. A row with the
query's own id is no candidate. Repeated ids are one query, and one candidate at
its smallest distance. Without vectors there are no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import materialize

#: Vectors that the codebooks are fitted on, at most (those of the smallest hash).
TRAIN_VECTORS = 20_000
#: Entries of a cell on average, by which the codebooks' size is set, and of a block at most, about.
CELL, BLOCK = 4, 1024
MOST_CENTROIDS = 128
#: Queries of the sample on which the share to search is measured.
TRIALS = 200


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (array of double) of the vectors that take part."""
    v: Column = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).filter("vec_id is not null and vec is not null")
    rows = rows.filter("not exists(vec, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(vec, x -> x != 0)")
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    return rows.filter(F.size("vec") == (longest or 0))


def fit_codebook(x: np.ndarray, k: int, rounds: int = 20, seed: int = 6) -> np.ndarray:
    """Centroids by Lloyd's method; an empty one moves to the point that is worst served."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at, far = nearest_centroid(x, centroids)
        for j in range(len(centroids)):
            mine = x[at == j]
            if len(mine):
                centroids[j] = mine.mean(axis=0)
            else:
                worst = int(np.argmax(far))
                centroids[j], far[worst] = x[worst], 0
    return centroids


def distances_to(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None, :], 0)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances_to(x, centroids)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, candidates: int) -> list[int]:
    """Numbers of the non-empty cells nearest to a query, until they hold ``candidates`` entries.

    ``first`` and ``second``: distances of the query's halves to the centroids;
    ``counts``: entries by pair of centroids. Each pair is pushed once: by the pair
    to its left, or from above in the first column.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(float(first[a[0]] + second[b[0]]), 0, 0)]
    found, held = [], 0
    while heap and held < candidates:
        _, i, j = heapq.heappop(heap)
        if n := int(counts[a[i], b[j]]):
            found.append(int(a[i]) * len(b) + int(b[j]))
            held += n
        if j + 1 < len(b):
            heapq.heappush(heap, (float(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (float(first[a[i + 1]] + second[b[0]]), i + 1, 0))
    return found


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def share_to_search(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], recall: float, k: int = 10) -> float:
    """Share of a sample's vectors, in order of their cells, that holds ``recall`` of the ``k`` nearest of its queries."""
    if len(x) <= k + 1:
        return 1.0
    half = books[0].shape[1]
    cells = [nearest_centroid(x[:, :half], books[0])[0], nearest_centroid(x[:, half:], books[1])[0]]
    ranks = []
    for i in range(0, len(x), max(1, len(x) // TRIALS)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argpartition(d, k)[:k]
        by_cell = distances_to(x[i : i + 1, :half], books[0])[0][cells[0]] + distances_to(x[i : i + 1, half:], books[1])[0][cells[1]]
        ranks += [int((by_cell <= by_cell[j]).sum()) for j in near]
    return float(np.quantile(ranks, recall)) / len(x)


class Index:
    """Codebooks, entries (vec_id, vec, cell) in the shared folder, entries by pair of centroids, and how many of them to search."""

    def __init__(self, entries: DataFrame, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, candidates: int):
        self.entries, self.books, self.counts, self.candidates = entries, books, counts, candidates


def build(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", train_vectors: int = TRAIN_VECTORS, recall: float = 0.96) -> Index | None:
    """Indexes every valid vector; None if there is none."""
    rows = materialize(valid(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = _matrix(rows.filter(place <= train_vectors / n).select("vec_id", "vec").toArrow().sort_by("vec_id").column("vec"))
    if not len(sample):
        sample = _matrix(rows.limit(train_vectors).toArrow().column("vec"))
    half = sample.shape[1] // 2
    k = max(2, min(MOST_CENTROIDS, math.isqrt(n // CELL)))
    books = (fit_codebook(sample[:, :half], k), fit_codebook(sample[:, half:], k))

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            if len(x):
                cell = nearest_centroid(x[:, :half], books[0])[0] * len(books[1]) + nearest_centroid(x[:, half:], books[1])[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["vec_id", "vec", "cell"])

    entries = materialize(rows.mapInArrow(assign, "vec_id long, vec array<double>, cell int"), "index-entries")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a cell, at most MOST_CENTROIDS squared
        counts[r["cell"] // len(books[1]), r["cell"] % len(books[1])] = r["n"]
    return Index(entries, books, counts, math.ceil(share_to_search(sample, books, recall) * n))


def search(index: Index, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of the entries that each query (vec_id, vec) visits."""
    books, counts, candidates = index.books, index.counts, max(index.candidates, k + 1)
    half, width = books[0].shape[1], len(books[1])
    blocks = np.maximum(1, -(-counts.sum(axis=1) // BLOCK))
    # seconds: the second centroid of an entry; those of all cells that a query visits.
    met = "first int, block int, is_query boolean, vec_id long, vec array<double>, seconds array<int>"
    names = ["first", "block", "is_query", "vec_id", "vec", "seconds"]

    def deal(batches):
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            first = cell // width
            block = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[first]
            seconds = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1), pa.int32()), pa.array(cell % width, pa.int32()))
            columns = [pa.array(first, pa.int32()), pa.array(block, pa.int32()), pa.array(np.zeros(len(ids), bool)), batch.column(0), batch.column(1), seconds]
            yield pa.RecordBatch.from_arrays(columns, names)

    def send(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            near = distances_to(x[:, :half], books[0]), distances_to(x[:, half:], books[1])
            row, first, block, seconds = [], [], [], []
            for i in range(len(x)):
                cells = np.array(visit(near[0][i], near[1][i], counts, candidates))
                for f in np.unique(cells // width):
                    of = cells[cells // width == f] % width
                    for b in range(blocks[f]):
                        row.append(i)
                        first.append(f)
                        block.append(b)
                        seconds.append(of)
            at = pa.array(row, pa.int64())
            columns = [pa.array(first, pa.int32()), pa.array(block, pa.int32()), pa.array([True] * len(row)), batch.column(0).take(at), batch.column(1).take(at), pa.array(seconds, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    def rank(batches):
        at, held = None, []  # the entries of the block that the stream is in: (id, vector, second centroid)

        def nearest(query_ids, q, seconds):
            if not held:
                return
            ids, x, second = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(ids, kind="stable")
            ids, x, second = ids[order], x[order], second[order]
            for i, own in enumerate(query_ids):
                visited = np.zeros(width, bool)
                visited[seconds[i]] = True
                mine = np.flatnonzero(visited[second] & (ids != own))
                d = np.sqrt(((x[mine] - q[i]) ** 2).sum(axis=1))
                for c in np.argsort(d, kind="stable")[:k]:
                    yield int(own), int(ids[mine[c]]), float(d[c])

        for batch in batches:
            first, parts, asked, vec_ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x, seconds = _matrix(batch.column(4)), batch.column(5).to_pylist()
            cuts = np.flatnonzero((np.diff(first) != 0) | (np.diff(parts) != 0) | (np.diff(asked.astype(int)) != 0)) + 1
            found: list = []
            for lo, hi in zip([0, *cuts], [*cuts, len(x)], strict=True):
                if hi <= lo:
                    continue
                if (now := (first[lo], parts[lo])) != at:
                    at, held = now, []
                if asked[lo]:
                    found += nearest(vec_ids[lo:hi], x[lo:hi], seconds[lo:hi])
                else:
                    held.append((vec_ids[lo:hi], x[lo:hi], np.array([s[0] for s in seconds[lo:hi]])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    both = index.entries.mapInArrow(deal, met).unionByName(queries.select("vec_id", "vec").mapInArrow(send, met))
    near = both.repartition("first", "block").sortWithinPartitions("first", "block", "is_query").mapInArrow(rank, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, *, every: int = 100, k: int = 10, recall: float = 0.96, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Searches the rows whose id is divisible by ``every`` against all rows."""
    index = build(vectors, id_col=id_col, vector_col=vector_col, recall=recall)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.entries.filter(F.col("vec_id") % every == 0), k=k)
