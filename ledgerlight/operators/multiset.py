"""Comparing tables as bags of rows by a tree of sums of hashes.

A row's hashes are added up, so a bucket's sums do not depend on the order of rows and
are combined before anything is shuffled. Buckets are prefixes of a row's hash. Two
tables agree where their buckets do; only rows of buckets that differ are looked at
again, by longer prefixes, and at last row by row. The root of the tree, the sums of
all buckets hashed, names a table's contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a level of the tree adds to the prefix, and how many differing buckets are broadcast at most.
BITS = 12
MOST_BUCKETS = 1_000_000
_SEEDS = (11, 12, 13)


def _hashes(columns: list[str]) -> list[Column]:
    """Three hashes of a row: which columns are null counts, too."""
    nulls = F.concat_ws("", *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]) if columns else F.lit("")
    return [F.xxhash64(F.lit(seed), nulls, *[F.col(c) for c in columns]) for seed in _SEEDS]


def _prefix(level: int) -> Column:
    return F.shiftrightunsigned("_h0", 64 - BITS * level)


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"_h{k}": h for k, h in enumerate(_hashes(rows.columns))})


def _sums(hashed: DataFrame, level: int) -> DataFrame:
    """bucket, n, s0, s1, s2: rows of each bucket and the sums of their hashes."""
    sums = [F.sum(F.col(f"_h{k}").cast("decimal(20,0)")).alias(f"s{k}") for k in range(len(_SEEDS))]
    return hashed.groupBy(_prefix(level).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *sums)


def buckets(rows: DataFrame) -> DataFrame:
    """The first level of a table's tree, at most 2 ** ``BITS`` rows."""
    return _sums(_hashed(rows), 1)


def root(rows: DataFrame, strategy: str = "") -> str:
    """A hash of a table's rows, with their repeats, in whatever order."""
    line = F.concat_ws(":", "bucket", "n", "s0", "s1", "s2")
    found = buckets(rows).agg(F.sha2(F.concat_ws("\n", F.lit(strategy), F.array_sort(F.collect_list(line))), 256).alias("root"))
    return found.first()["root"]


def _differing(a: DataFrame, b: DataFrame, level: int) -> DataFrame:
    """Buckets of hashed tables whose sums are not the same."""
    sides = [_sums(side, level) for side in (a, b)]
    same = sides[0].columns[1:]
    both = sides[0].select("bucket", F.struct(*same).alias("a")).join(sides[1].select("bucket", F.struct(*same).alias("b")), "bucket", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def candidates(before: DataFrame, after: DataFrame, levels: int = 2) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that stand in buckets which differ; all others are in both, with their repeats."""
    sides = [_hashed(before), _hashed(after.select(*before.columns))]
    for level in range(1, levels + 1):
        found = _differing(*sides, level)
        # Rows stay where they are while the differing buckets are few enough to go to them; those of the first level are.
        if level == 1 or found.limit(MOST_BUCKETS + 1).count() <= MOST_BUCKETS:
            found = F.broadcast(found)
        sides = [side.join(found, _prefix(level) == found["bucket"], "left_semi") for side in sides]
    return tuple(side.select(*before.columns) for side in sides)


def difference(before: DataFrame, after: DataFrame, levels: int = 2) -> DataFrame:
    """Rows, with repeats, that stand in one table only, and in which (``side``: before, after).

    As ``EXCEPT ALL`` both ways, but only rows of differing buckets are shuffled. Both
    tables have the same columns, of types that can be compared.
    """
    a, b = candidates(before, after, levels)
    # One shuffle for both ways: a row counts +1 on one side and -1 on the other.
    signed = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    left = signed.groupBy(*before.columns).agg(F.sum("_n").alias("_n")).filter("_n != 0")
    repeated = left.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n"))))
    return repeated.withColumn("side", F.when(F.col("_n") > 0, "before").otherwise("after")).drop("_n", "_k")
