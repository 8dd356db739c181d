"""As-of joins: each row with the nearest row of the same keys before it, or after it.

No pairs are formed. Both sides become one table, dealt by key and cell of the ordered
value, and within a cell the last value seen is carried on. What a cell starts with,
the last value of the cells before it, comes from one row per key and cell, which are
aggregated before they move. A key with a third of all rows is thus as many groups as
its values have cells.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task sorts at once, about: what is dealt by key and cell goes to as many tasks as this calls for.
TASK_ROWS = 200_000


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: those that the session sets at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def carried(rows: DataFrame, values: DataFrame, keys: list[str], cell: str, order: list[Column], value: str, *, at: str, parts: int, forward: bool = False) -> DataFrame:
    """Adds ``value`` to each row of ``rows`` and ``values`` (which hold it) as the last one at or before it, in ``order``, over all cells of its keys.

    ``at`` is what cells are cut from: rows with a value differ in it. ``cell`` (long) follows
    it upwards; ``forward`` reads it downwards, and ``order`` must, too. Rows are dealt to
    ``parts`` tasks, and ``values`` come dealt by keys and cell.
    """
    pick = F.min_by if forward else F.max_by
    last = values.groupBy(*keys, cell).agg(pick(value, at).alias(value)).unionByName(rows.select(*keys, cell).distinct(), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(F.col(cell).desc() if forward else F.col(cell)).rangeBetween(Window.unboundedPreceding, -1)
    start = last.withColumn(value, F.last(value, ignorenulls=True).over(before)).filter(F.col(value).isNotNull()).withColumn("_row", F.lit(False))
    both = rows.unionByName(values, allowMissingColumns=True).withColumn("_row", F.lit(True)).unionByName(start, allowMissingColumns=True).repartition(parts, *keys, cell)
    seen = Window.partitionBy(*keys, cell).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(seen)).filter("_row").drop("_row")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], *, at: str, by: str, cell: Callable[[Column], Column], forward: bool = False, exact: bool = True) -> DataFrame:
    """Every row of ``left``, and ``match``: of the rows of ``right`` with equal keys the one whose ``by`` is the last up to ``at`` (``forward``: the first from it on).

    ``match`` is a struct of the right's columns that are no keys, null where there is
    none. ``exact`` says whether an equal value counts. Of right rows at one value the
    smallest by their other columns, in order, stands for all. ``cell`` numbers the cells
    of a value, rising with it. A null key or value matches nothing; its row is kept.
    Both sides are counted first, so that tasks grow in number and not in size.
    """
    parts = tasks(left.sparkSession, left.count() + right.count())
    rest = [c for c in right.columns if c not in keys and c != by]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, by)])
    ids = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)]
    one = right.filter(known).select(*named, F.col(by).alias("_at"), cell(F.col(by)).cast("long").alias("_cell"), F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    # Dealt by cell first: a minimum of structs is found by sorting, and so is sorted only what a task holds.
    one = one.repartition(parts, *ids, "_cell").groupBy(*ids, "_cell", "_at").agg(F.min("_rest").alias("_rest"))
    match = F.struct(F.col("_at").alias(by), *[F.col("_rest")[c].alias(c) for c in rest])
    # At equal values the side that sorts first is seen by the other only if it is the right one.
    b = one.select(*ids, "_at", F.lit(0 if exact else 2).alias("_side"), match.alias("_match"), "_cell")
    held = F.struct(*left.columns)
    # Rows without a value see nothing: they are spread, as there may be many.
    place = F.coalesce(cell(F.col(at)).cast("long"), F.pmod(F.xxhash64(held), F.lit(1024)))
    a = left.select(*named, F.col(at).alias("_at"), F.lit(1).alias("_side"), held.alias("_left"), place.alias("_cell"))
    order = [F.col("_at").desc() if forward else F.col("_at"), F.col("_side")]
    met = carried(a, b, ids, "_cell", order, "_match", at="_at", parts=parts, forward=forward)
    return met.filter("_side = 1").select("_left.*", F.when(F.col("_at").isNotNull(), F.col("_match")).alias("match"))
