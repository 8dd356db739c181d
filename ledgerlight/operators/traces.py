"""Traces of spans: trees over parent ids, summed upwards, and the time a span spent itself.

A span has span_id (unique), parent_id (null or unknown: a root), start and end in
microseconds. Trees are walked by pointer doubling: a tree of depth d takes log2(d)
joins, whatever its shape. Times of children are united in cells of time with what
earlier cells left open, so a span with a third of all spans as its children is many
groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.operators.asof import tasks
from ledgerlight.sinks import work_folder


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, from which later rounds start."""
    path = f"{work_folder(df.sparkSession, 'traces')}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rolled_up(spans: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per span: root_id, depth (of a root 0), spans, and the sum of each of ``values`` (whole numbers), of it and all below it.

    After k rounds a span knows its ancestor 2**k above and the sums of all less than 2**k
    below; each round adds the sums of those exactly 2**k below. Parents that form a
    circle are a ValueError.
    """
    sums = ["spans", *values]
    rows = spans.select("span_id", "parent_id", F.lit(1).cast("long").alias("spans"), *[F.coalesce(v.cast("long"), F.lit(0).cast("long")).alias(n) for n, v in values.items()])
    known = spans.select(F.col("span_id").alias("up"))
    rows = rows.join(known, F.col("parent_id") == F.col("up"), "left").drop("parent_id")
    rows = _written(rows.withColumns({"root_id": F.coalesce("up", "span_id"), "depth": F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")}))
    n, reach = rows.count(), 1
    while not rows.filter("up IS NOT NULL").isEmpty():
        if reach > n:
            raise ValueError("parents of spans form a circle")
        below = rows.filter("up IS NOT NULL").groupBy(F.col("up").alias("span_id")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        above = rows.select(F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"))
        met = rows.join(below, "span_id", "left").join(above, "up", "left")
        rows = _written(
            met.select(
                "span_id",
                *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums],
                F.col("_up").alias("up"),
                F.coalesce("_root", "root_id").alias("root_id"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            )
        )
        reach *= 2
    return rows.drop("up")


def united(intervals: DataFrame, keys: list[str], cell: int, parts: int) -> DataFrame:
    """Per key, ``covered``: the length of the union of its intervals (start, end, end exclusive; empty ones cover nothing).

    An interval adds what lies beyond all that began before it. Those of one cell of
    ``cell`` units are ordered by a window; the furthest end of earlier cells comes from
    one row per key and cell. Cells are dealt to ``parts`` tasks.
    """
    rows = intervals.filter("end > start").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    rows = rows.withColumn("_cell", F.floor(F.col("start") / cell))
    cells = rows.groupBy(*keys, "_cell").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    open_ = cells.select(*keys, "_cell", F.max("end").over(before).alias("_open"))
    # The open end joins its cell as a row before all others: no join, and null keys meet.
    both = rows.unionByName(open_.filter("_open IS NOT NULL").select(*keys, "_cell", F.lit(None).cast("long").alias("start"), F.col("_open").alias("end"))).repartition(parts, *keys, "_cell")
    own = Window.partitionBy(*keys, "_cell").orderBy(F.col("start").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(own), F.col("start"))), F.lit(0))
    return both.withColumn("_new", new).filter("start IS NOT NULL").groupBy(*keys).agg(F.sum("_new").alias("covered"))


def self_times(spans: DataFrame, cell: int = 60_000_000) -> DataFrame:
    """Per span: span_id, total (its length) and own (what no child of it covers)."""
    spans = _written(spans.select("span_id", "parent_id", "start", "end"))
    parts = tasks(spans.sparkSession, 4 * spans.count())  # a span is sorted as a child, as a parent, in its cell and by itself
    parents = spans.select(F.col("span_id").alias("parent_id"), F.col("start").alias("_from"), F.col("end").alias("_to")).repartition(parts, "parent_id")
    inside = spans.filter("parent_id IS NOT NULL").repartition(parts, "parent_id").join(parents, "parent_id").select("parent_id", F.greatest("start", "_from").alias("start"), F.least("end", "_to").alias("end"))
    covered = united(inside, ["parent_id"], cell, parts).withColumnRenamed("parent_id", "span_id")
    total = F.col("end") - F.col("start")
    return spans.repartition(parts, "span_id").join(covered.repartition(parts, "span_id"), "span_id", "left").select("span_id", total.alias("total"), (total - F.coalesce("covered", F.lit(0))).alias("own"))


def span_summaries(spans: DataFrame, prefixes: list[str], attributes: list[str]) -> DataFrame:
    """Spans whose name begins with one of ``prefixes``: name and the named entries of the map ``attributes``, null where a span lacks one; nothing else of a span leaves."""
    ours = F.lit(False)
    for prefix in prefixes:
        ours = ours | F.coalesce(F.startswith("name", F.lit(prefix)), F.lit(False))
    return spans.filter(ours).select("span_id", "name", *[F.try_element_at("attributes", F.lit(a)).alias(a.rsplit(".", 1)[-1]) for a in attributes])
