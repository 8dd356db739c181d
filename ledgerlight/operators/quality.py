"""Checks of a snapshot: each is one pass that returns its findings as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.multiset import difference


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once; nulls are equal to each other."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def column_checks(rows: DataFrame, required: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row of counts: rows, nulls per required column, and rows that break each rule (a null breaks it)."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"broken_{name}") for name, rule in rules.items()]
    return rows.agg(F.count(F.lit(1)).alias("rows"), *nulls, *broken)


def any_null(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def replay_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, with repeats, that stand in one snapshot only, and on which side; equal buckets of rows are never shuffled."""
    return difference(before, after)


def provenance_mismatches(published: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys on both sides whose provenance columns differ (null-safe)."""
    a, b = published.select(*key, *[F.col(c).alias(f"published_{c}") for c in columns]), source.select(*key, *[F.col(c).alias(f"source_{c}") for c in columns])
    same = reduce(lambda x, y: x & y, [F.col(f"published_{c}").eqNullSafe(F.col(f"source_{c}")) for c in columns])
    return a.join(b, key).filter(~same)


def scope_difference(found: DataFrame, configured: DataFrame, key: str) -> DataFrame:
    """Entities on one side only: unexpected or missing."""
    f, c = found.select(key).distinct(), configured.select(key).distinct()
    return f.join(c, key, "left_anti").withColumn("problem", F.lit("unexpected")).unionByName(c.join(f, key, "left_anti").withColumn("problem", F.lit("missing")))


def short_texts(rows: DataFrame, text_col: str, least: int = 500) -> DataFrame:
    """Rows whose text is missing or has fewer characters than ``least``."""
    return rows.filter(F.coalesce(F.length(text_col) < least, F.lit(True)))


def outside_universe(rows: DataFrame, symbols_col: str, universe: list[str]) -> DataFrame:
    """Rows with a symbol outside the universe, or with none."""
    listed = F.array(*[F.lit(s) for s in universe])
    return rows.filter(F.coalesce((F.size(F.array_except(symbols_col, listed)) > 0) | (F.size(symbols_col) == 0), F.lit(True)))


def unsorted_sets(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose array is not sorted and free of repeats, as documents want it."""
    return rows.filter(~F.coalesce(F.array_sort(F.array_distinct(column)) == F.col(column), F.lit(False)))
