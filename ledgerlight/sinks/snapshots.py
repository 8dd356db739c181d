"""Snapshots of several tables, published at once.

Tables are written under the snapshot's own id; then one small manifest row names
them all. Readers follow the newest committed manifest, so a failure before that
leaves the previous snapshot in place, and all tables change together.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators import multiset
from ledgerlight.operators.quality import orphans
from ledgerlight.operators.serving import check_identifier

_MANIFEST = "number long, snapshot_id string, table string, path string, rows long"


def snapshot_id(rows: DataFrame, id_col: str, strategy: str) -> str:
    """A hash of the strategy and of all ids, whatever their order: the root of their tree of sums."""
    return multiset.root(rows.select(id_col), strategy)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).json(f"{root}/_manifests/*/")
    except AnalysisException:
        return spark.createDataFrame([], _MANIFEST)


def publish(spark: SparkSession, root: str, snapshot: str, tables: dict[str, DataFrame], faults: DataFrame | None = None) -> int:
    """Publishes ``tables``; refuses if ``faults`` has rows. Returns the manifest's number."""
    if faults is not None and not faults.isEmpty():
        raise ValueError("the snapshot has faults and is not published")
    number = (manifests(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    rows = []
    for name, table in tables.items():
        path = f"{root}/{name}/{number:08d}-{snapshot[:16]}"
        table.write.mode("overwrite").parquet(path)
        rows.append((number, snapshot, name, path, spark.read.parquet(path).count()))
    # A second publisher of the same number fails here, before its manifest is seen.
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root}/_manifests/{number:08d}")
    return number


def read_current(spark: SparkSession, root: str, table: str, number: int | None = None) -> DataFrame:
    """The table of the newest snapshot, or of the one with this number."""
    known = manifests(spark, root).filter(F.col("table") == table)
    wanted = known.filter(F.col("number") == number) if number else known.orderBy(F.col("number").desc())
    found = wanted.select("path").first()
    if found is None:
        raise LookupError(f"no snapshot of {table}")
    return spark.read.parquet(found["path"])


def changes(spark: SparkSession, root: str, table: str, before: int, after: int) -> DataFrame:
    """Rows, with repeats, that a snapshot added or removed."""
    old, new = read_current(spark, root, table, before), read_current(spark, root, table, after)
    found = multiset.difference(old, new)
    return found.withColumn("change", F.when(F.col("side") == "after", "added").otherwise("removed")).drop("side")


def changed_ids(spark: SparkSession, root: str, table: str, before: int, after: int, id_col: str) -> DataFrame:
    """Ids that a snapshot has and the one before had not: what an index has still to embed."""
    old, new = read_current(spark, root, table, before), read_current(spark, root, table, after)
    return new.select(id_col).distinct().join(old.select(id_col), id_col, "left_anti")


def create_if_absent(spark: SparkSession, name: str, schema: str, form: str = "parquet") -> None:
    """An empty table of this schema (column definitions, NOT NULL where it says so), unless there is one already."""
    for part in name.split("."):
        check_identifier(part)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING {form}")


def orphans_after(spark: SparkSession, root: str, children: str, parents: str, keys: list[str]) -> DataFrame:
    """Rows of a published table whose parents the same snapshot lacks: none, if it was published whole."""
    return orphans(read_current(spark, root, children), read_current(spark, root, parents), keys)


def append_run(rows: DataFrame, path: str, run_id: str) -> int:
    """Appends one run of raw rows and returns how many of it can be read back."""
    rows.withColumn("ingestion_run_id", F.lit(run_id)).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path).filter(F.col("ingestion_run_id") == run_id).count()
