"""A word index that follows a published table by its changes.

The index is kept in segments that are never rewritten. A change set makes one more
segment: the words of the texts that are new, and the ids that it touched. What older
segments say of a touched id is dead from then on (the ids are their tombstones). A
version is one small file that names the live segments in order; readers follow the
newest, so a failure on the way leaves the index as it was. ``merge`` folds all
segments into one.

Rows of words are sorted by word within a segment, so a search reads the parts that
hold its words. Only segments after the one that holds a row can have killed it: their
ids are what a search compares, and those follow the changes, not the table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.operators.embedding import words_of
from ledgerlight.sinks import snapshots

_VERSION = "version long, segments array<long>, texts long, source_number long"


class SegmentIndex:
    """Options: ``root``, a folder that all executors see; ids and texts of the indexed table are ``id_col`` and ``text_col``."""

    def __init__(self, spark: SparkSession, root: str, *, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.root, self.id_col, self.text_col = spark, root, id_col, text_col

    def version(self) -> dict:
        try:
            found = self.spark.read.schema(_VERSION).json(f"{self.root}/_versions/*/").orderBy(F.col("version").desc()).first()
        except AnalysisException:
            found = None
        return found.asDict() if found else {"version": 0, "segments": [], "texts": 0, "source_number": 0}

    def _commit(self, now: dict, segments: list[int], texts: int, source_number: int) -> None:
        row = (now["version"] + 1, segments, texts, source_number)
        # A second writer of the same version fails here, before its segments are seen.
        self.spark.createDataFrame([row], _VERSION).coalesce(1).write.mode("errorifexists").json(f"{self.root}/_versions/{row[0]:08d}")

    def _read(self, segments: list[int], what: str) -> DataFrame:
        """Rows of several segments as one scan; each row says of which segment it is."""
        return self.spark.read.parquet(*[f"{self.root}/segments/{s:08d}/{what}" for s in segments])

    def _postings(self, segments: list[int]) -> DataFrame:
        return self._read(segments, "words")

    def _dead(self, segments: list[int]) -> DataFrame | None:
        """id, killed_by: the last segment but the first that touched an id."""
        if len(segments) < 2:
            return None
        return self._read(segments[1:], "touched").groupBy("id").agg(F.max("segment").alias("killed_by"))

    def _live(self, postings: DataFrame, segments: list[int]) -> DataFrame:
        dead = self._dead(segments)
        if dead is None:
            return postings
        return postings.join(dead, (postings["id"] == dead["id"]) & (postings["segment"] < dead["killed_by"]), "left_anti")

    def _write(self, segment: int, words: DataFrame, touched: DataFrame | None) -> None:
        path = f"{self.root}/segments/{segment:08d}"
        # Words are dealt by range once, and an id's repeated words end where they meet.
        dealt = words.select("word", "id").repartitionByRange("word").dropDuplicates(["word", "id"]).sortWithinPartitions("word", "id")
        dealt.select("word", "id", F.lit(segment).cast("bigint").alias("segment")).write.mode("overwrite").parquet(f"{path}/words")
        if touched is not None:
            touched.select("id", F.lit(segment).cast("bigint").alias("segment")).write.mode("overwrite").parquet(f"{path}/touched")

    def apply(self, changes: DataFrame, source_number: int = 0) -> int:
        """Adds a change set (id_col, text_col, change: added or removed) as a segment; an id that is removed and added is replaced. Returns the segment."""
        now = self.version()
        segment = max(now["segments"], default=0) + 1
        rows = changes.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text"), F.when(F.col("change") == "added", 1).otherwise(-1).alias("sign"))
        words = rows.filter("sign = 1").select("id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
        self._write(segment, words, rows.select("id").distinct())
        grown = rows.groupBy("id", "sign").agg(F.lit(1).alias("one")).agg(F.sum("sign")).first()[0] or 0
        self._commit(now, [*now["segments"], segment], now["texts"] + grown, source_number)
        return segment

    def sync(self, published: str, table: str) -> int | None:
        """Brings the index up to the newest snapshot of a published table: what differs from the snapshot it holds is one change set, all else is not read again but to be compared. None if it is up to date."""
        newest = snapshots.manifests(self.spark, published).filter(F.col("table") == table).agg(F.max("number")).first()[0]
        held = self.version()["source_number"]
        if newest is None or newest == held:
            return None
        if held:
            found = snapshots.changes(self.spark, published, table, held, newest)
        else:
            found = snapshots.read_current(self.spark, published, table, newest).withColumn("change", F.lit("added"))
        return self.apply(found, newest)

    def merge(self) -> int:
        """Folds all segments into one, without what is dead. Older versions can still be read."""
        now = self.version()
        segment = max(now["segments"], default=0) + 1
        self._write(segment, self._live(self._postings(now["segments"]), now["segments"]), None)
        self._commit(now, [segment], now["texts"], now["source_number"])
        return segment

    def search(self, queries: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
        """query_id, rank, id, score: texts by the summed rarity of the query's words they hold (``queries``: query_id, query_text)."""
        now = self.version()
        if not now["segments"]:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, score double")
        asked = queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("query_text")))).alias("word"))
        held = self._live(self._postings(now["segments"]).join(asked.select("word").distinct(), "word", "left_semi"), now["segments"]).select("word", "id")
        rarity = held.groupBy("word").agg(F.log(1 + F.lit(float(now["texts"])) / F.count(F.lit(1))).alias("weight"))
        scored = held.join(rarity, "word").join(asked, "word").groupBy("query_id", "id").agg(F.round(F.sum("weight"), digits).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
