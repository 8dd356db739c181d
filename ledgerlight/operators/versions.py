"""Version selection and deduplication: which of many observations of a key is current.

Both policies report conflicts as rows instead of stopping; a publisher refuses a
snapshot that has any. One shuffle by key: the counts per (key, version) are
partial aggregates, so a key with a third of all rows is combined before it moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_sign(content: list[str], sets: list[str] = ()) -> Column:
    """A hash of the content columns with their nulls; the arrays ``sets`` count as sets."""
    parts = [F.array_sort(F.array_distinct(c)).alias(c) if c in sets else F.col(c) for c in content]
    return F.xxhash64(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def _observed(rows: DataFrame, key: list[str], version: str, sign: Column, tie: str) -> DataFrame:
    """Per (key, version): rows, whether contents differ, the row of the smallest tie."""
    rest = [c for c in rows.columns if c not in (*key, version)]
    return rows.groupBy(*key, version).agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(sign) != F.max(sign)).alias("conflict"),
        F.min_by(F.struct(*rest), F.struct(tie)).alias("row"),
        F.min_by(sign, F.struct(tie)).alias("sign"),
    )


def current_versions(rows: DataFrame, key: list[str], version: str, content: list[str], tie: str, sets: list[str] = ()) -> DataFrame:
    """The current row of each key with observations, duplicates, superseded and conflicts.

    A repeat of a version is a duplicate if its content is the same and a conflict if
    not, at whatever time; an older version is a duplicate if its content is the
    current one's and superseded if not. Of equal versions the smallest ``tie`` stays.
    """
    seen = _observed(rows, key, version, content_sign(content, sets), tie)
    # Joined back to its versions by key, not by a window over a key's whole history: such a join can be split.
    last = seen.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.max(version).alias("latest"), F.max_by("sign", version).alias("_sign"))
    seen = seen.join(last, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])).withColumn("same", F.col("sign") == F.col("_sign"))
    older = F.col(version) < F.col("latest")
    out = seen.groupBy(*key).agg(
        F.max(version).alias(version),
        F.max_by("row", version).alias("row"),
        F.sum("n").alias("observations"),
        F.sum(F.col("n") - 1 + F.when(older & F.col("same"), 1).otherwise(0)).alias("duplicates"),
        F.count_if(older & ~F.col("same")).alias("superseded"),
        F.count_if("conflict").alias("conflicts"),
    )
    return out.select(*key, version, "row.*", "observations", "duplicates", "superseded", "conflicts")


def earliest_of_latest(rows: DataFrame, key: list[str], version: str, content: list[str], arrival: list[str], sets: list[str] = ()) -> DataFrame:
    """The first arrival of each key's latest version; contents are compared at that version only.

    Summed up by (key, version) first, in tasks before anything moves; a key's versions
    then combine as such sums do, and no task or window sees all rows of a key.
    """
    sign = content_sign(content, sets)
    kept = [c for c in rows.columns if c not in key]
    seen = rows.groupBy(*key, version).agg(
        F.min_by(F.struct(*kept), F.struct(*arrival)).alias("row"),
        F.count(F.lit(1)).alias("n"),
        F.min(sign).alias("least"),
        F.max(sign).alias("most"),
    )
    of_last = F.max_by(F.struct("row", "n", "least", "most"), version).alias("last")
    out = seen.groupBy(*key).agg(of_last, F.sum("n").alias("all"))
    return out.select(*key, "last.row.*", (F.col("all") - F.col("last.n")).alias("superseded"), (F.col("last.n") - 1).alias("repeats"), (F.col("last.least") != F.col("last.most")).alias("conflict"))


def latest_one(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that leaves no ties; tasks keep their own first before anything is shuffled."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_responses(responses: DataFrame, entity: str, configured: DataFrame | None = None) -> DataFrame:
    """The latest response of each entity, with superseded, tie_repeats and faults.

    ``responses``: entity, source_response_id, fetched_at, response_sha256. Of those
    fetched last the smallest id stays; ``tie_conflict`` if they hold different
    payloads, ``repeated_id`` if one of the entity's ids stands more than once in all
    responses. ``in_scope``: the entity is configured. Responses are summed up by
    (entity, time of retrieval) before an entity's meet.
    """
    rest = [c for c in responses.columns if c != entity]
    hashes = F.col("response_sha256")
    seen = responses.groupBy(entity, "fetched_at").agg(F.min_by(F.struct(*rest), "source_response_id").alias("row"), F.count(F.lit(1)).alias("n"), F.min(hashes).alias("least"), F.max(hashes).alias("most"))
    out = seen.groupBy(entity).agg(F.max_by(F.struct("row", "n", "least", "most"), "fetched_at").alias("last"), F.sum("n").alias("all"))
    pairs = responses.groupBy("source_response_id", entity).agg(F.count(F.lit(1)).alias("_n"))
    repeated = pairs.groupBy("source_response_id").agg(F.sum("_n").alias("_n")).filter("_n > 1")
    ids = pairs.join(repeated, "source_response_id", "left_semi").select(entity).distinct()
    out = out.join(ids.withColumn("repeated_id", F.lit(True)), entity, "left")
    last = F.col("last")
    out = out.select(entity, "last.row.*", (F.col("all") - last["n"]).alias("superseded"), (last["n"] - 1).alias("tie_repeats"), F.coalesce(last["least"] != last["most"], F.lit(False)).alias("tie_conflict"), F.coalesce("repeated_id", F.lit(False)).alias("repeated_id"))
    if configured is None:
        return out
    return out.join(configured.select(entity).distinct().withColumn("in_scope", F.lit(True)), entity, "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def collapse_repeats(rows: DataFrame, key: list[str], content: list[str], order: list[str], sets: list[str] = ()) -> DataFrame:
    """One row per key, the first by ``order``, with repeats (equal ones collapsed) and conflict (contents differ: the snapshot must be refused)."""
    sign = content_sign(content, sets)
    rest = [c for c in rows.columns if c not in key]
    out = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"), (F.count(F.lit(1)) - 1).alias("repeats"), (F.min(sign) != F.max(sign)).alias("conflict"))
    return out.select(*key, "row.*", "repeats", "conflict")
