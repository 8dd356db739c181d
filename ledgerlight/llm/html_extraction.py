"""Main text of web pages, by differencing pages of near URLs.

What a page's markup names as no text of the article is left out when it is read
(``page_blocks``). Of the blocks that are left, those that a site repeats are found by
comparing pages: the pages of a host stand in order of their URL paths, each is paired
with the nearest on both sides, and the blocks of a pair are aligned by their longest
common subsequence. A pair that differs in next to nothing is two copies of a page
and says nothing; the next page takes its place. A block is deleted if most of the
pairs share it. In an article that the page itself declares, all pairs must share
it, three at least: common lines of articles are text.

Only hashes of blocks are sorted and compared, in bounded runs of the order, however
many pages a host holds; pages near the end of a run are seen by the next one, too,
so the result does not depend on how Spark deals the rows. Texts stay where they were
read; the numbers of deleted blocks are joined to them.

Null html is empty, and empty pages have an empty text. A null url has an empty host;
null and repeated ids are pages like others, ties in the order go by id and hash of
the blocks. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import broadcast_if_small, materialize
from ledgerlight.llm.page_blocks import blocks

#: Pages to pair with on each side, and how far to look for pages that are no copies.
PAIRS, REACH = 4, 16
#: Pages of a run of the order.
RUN = 512
#: Two pages are copies if less than this share of either's characters is its own.
OWN = 0.1
_BITS = 1 << 27


def read_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """row (a number of the row), page_id, url, declared, lines: the blocks of each page."""

    def read(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                read = [blocks(html or "") for html in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([d for _, d in read], pa.bool_()), pa.array([lines for lines, _ in read], pa.list_(pa.string()))], ["row", "page_id", "url", "declared", "lines"])

    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(read, f"row long, page_id {kind}, url string, declared boolean, lines array<string>")


def _common(a: list[int], b: list[int]) -> int:
    """Bits of ``b`` (0 where the longest common subsequence grows) after all of ``a``."""
    return _rows(a, b)[-1]


def _rows(a: list[int], b: list[int]) -> list[int]:
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    v, rows = whole, [whole]
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & whole
        rows.append(v)
    return rows


def _grown(v: int, n: int) -> np.ndarray:
    """Lengths of the longest common subsequence with the first 0, 1, ..., n of ``b``."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence: pairs of places. Bits of whole numbers hold a row of the table; long lists are halved, so memory stays bounded."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    found = [(i, i) for i in range(lo)]
    if x and y and len(x) > 1 and len(x) * len(y) > _BITS:
        half = len(x) // 2
        left = _grown(_common(x[:half], y), len(y))
        right = _grown(_common(x[half:][::-1], y[::-1]), len(y))[::-1]
        cut = int(np.argmax(left + right))
        found += [(lo + i, lo + j) for i, j in align(x[:half], y[:cut])]
        found += [(lo + half + i, lo + cut + j) for i, j in align(x[half:], y[cut:])]
    elif x and y:
        rows, i, j, back = _rows(x, y), len(x), len(y), []
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                back.append((lo + i, lo + j))
        found += back[::-1]
    return found + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


class _Page:
    __slots__ = ("declared", "hashes", "host", "lengths", "place", "row", "total")

    def __init__(self, row, place, host, declared, hashes, lengths):
        self.row, self.place, self.host, self.declared, self.hashes, self.lengths = row, place, host, declared, hashes, lengths
        self.total = sum(lengths)


def _pair(a: _Page, b: _Page) -> tuple[list[int], list[int]] | None:
    """Places of the blocks that two pages share; None for copies."""
    if a.hashes == b.hashes:
        return None
    same = align(a.hashes, b.hashes)
    shared = sum(a.lengths[i] for i, _ in same)
    if min(a.total - shared, b.total - shared) < OWN * min(a.total, b.total):
        return None
    return [i for i, _ in same], [j for _, j in same]


def deleted_blocks(run: list[_Page], first: int, last: int) -> list[tuple[int, list[int]]]:
    """(row, places of deleted blocks) of the pages of a run from ``first`` up to ``last``; the others are neighbours only."""
    known: dict[tuple[int, int], tuple[list[int], list[int]] | None] = {}

    def shared(i: int, j: int) -> list[int] | None:
        low, high = min(i, j), max(i, j)
        if (low, high) not in known:
            known[low, high] = _pair(run[low], run[high])
        pair = known[low, high]
        return None if pair is None else pair[i > j]

    found = []
    for i in range(first, last):
        page, votes, pairs = run[i], [0] * len(run[i].hashes), 0
        if not votes:
            continue
        for step in (-1, 1):
            mine = 0
            for j in range(i + step, i + step * (REACH + 1), step):
                if mine == PAIRS or not 0 <= j < len(run) or run[j].host != page.host:
                    break
                if run[j].hashes and (places := shared(i, j)) is not None:
                    mine += 1
                    for p in places:
                        votes[p] += 1
            pairs += mine
        enough = max(pairs, 3) if page.declared else pairs // 2 + 1
        if gone := [p for p, v in enumerate(votes) if v >= enough]:
            found.append((page.row, gone))
        for key in [k for k in known if k[0] < i - REACH]:
            del known[key]
    return found


def _host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)


def shared_blocks(read: DataFrame) -> DataFrame:
    """row, gone: the places of the blocks that differencing deletes, of pages that have any."""
    host, path = _host_and_path(F.col("url"))
    hashes = F.transform("lines", lambda x: F.xxhash64(x))
    slim = read.select("row", host.alias("host"), path.alias("path"), "page_id", "declared", hashes.alias("hashes"), F.transform("lines", lambda x: F.length(x)).alias("lengths"))
    order = ["host", "path", "page_id", "hashes", "row"]
    ranges = max(1, math.ceil(read.count() / (16 * RUN)))
    ranged = slim.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranged = ranged.select("row", "host", "declared", "hashes", "lengths", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("own"))
    ranged = materialize(ranged, "pages-order")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ranged.join(broadcast_if_small(offsets, 100_000), "range").withColumn("place", F.col("before") + F.col("own"))
    run, inside = F.floor(F.col("place") / RUN).cast("long"), F.col("place") % RUN
    seen = F.array_compact(F.array(run, F.when((inside < REACH) & (run > 0), run - 1), F.when(inside >= RUN - REACH, run + 1)))
    dealt = placed.select(F.explode(seen).alias("run"), "place", "row", "host", "declared", "hashes", "lengths")

    def compare(batches):
        at, held = None, []

        def done():
            mine = [k for k, p in enumerate(held) if p.place // RUN == at]
            if mine and (found := deleted_blocks(held, mine[0], mine[-1] + 1)):
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([g for _, g in found], pa.list_(pa.int32()))], ["row", "gone"])

        for batch in batches:
            for run, place, row, host, declared, hashes, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run != at:
                    yield from done()
                    at, held = run, []
                held.append(_Page(row, place, host, declared, hashes, lengths))
        yield from done()

    return dealt.repartition("run").sortWithinPartitions("run", "place").mapInArrow(compare, "row long, gone array<int>")


def extract_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by a line end), n_chars."""
    read = materialize(read_pages(pages, id_col=id_col, url_col=url_col, html_col=html_col), "pages-read")
    gone = materialize(shared_blocks(read), "pages-gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    text = F.array_join(kept, "\n")
    return read.join(gone, "row", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
