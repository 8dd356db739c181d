"""Similarity search over vectors and the measures of ranked results."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.operators.claims import is_noise
from ledgerlight.operators.embedding import embed_text

#: Rows of vectors and of queries that meet in one block, about.
VECTOR_BLOCK, QUERY_BLOCK = 20_000, 512


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", query_id_col: str | None = None, digits: int | None = None) -> DataFrame:
    """query_id, rank, id, score: the ``k`` most similar vectors of each stated query; ties to the smaller id.

    Queries come from the vectors themselves, and none finds itself, unless
    ``query_id_col`` says that their ids are of another kind. ``digits``: scores are
    rounded before they are ranked. Zero vectors are never found and find nothing.

    Both sides are dealt to blocks by a hash of the id, and each block of queries meets
    each block of vectors in one group of bounded size, which keeps its best ``k`` of
    every query; only those meet by query. Nothing passes through the driver but two counts.
    """
    slim = lambda df, c: df.select(F.col(c).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null")
    rows, asked = slim(vectors, id_col), slim(queries, query_id_col or id_col)
    apart = query_id_col is not None
    row_blocks, query_blocks = max(1, -(-vectors.count() // VECTOR_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.select(mine(row_blocks).alias("r"), every(query_blocks).alias("q"), F.lit(False).alias("is_query"), "id", "v")
    right = asked.select(every(row_blocks).alias("r"), mine(query_blocks).alias("q"), F.lit(True).alias("is_query"), "id", "v")
    near = left.unionByName(right).groupBy("r", "q").applyInArrow(lambda block: _nearest(block, k, apart, digits), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _nearest(block: pa.Table, k: int, apart: bool = False, digits: int | None = None, at_once: int = 32) -> pa.Table:
    """Of one block: the best ``k`` vectors of each of its queries. Scores of ``at_once`` queries are held at a time, and only what reaches a query's k-th score is sorted."""

    def side(is_query: bool) -> tuple[np.ndarray, np.ndarray]:
        rows = block.filter(pc.equal(block.column("is_query"), is_query))
        if pc.count_distinct(pc.list_value_length(rows.column("v"))).as_py() > 1:
            raise ValueError("vectors of several lengths")
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return rows.column("id").to_numpy().astype(np.int64), flat.astype(np.float64, copy=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))

    (ids, q), (own, x) = side(True), side(False)
    found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    sizes = np.linalg.norm(x, axis=1)
    for at in range(0, len(ids) if len(own) else 0, at_once):
        asked, v = ids[at : at + at_once], q[at : at + at_once]
        with np.errstate(invalid="ignore", divide="ignore"):
            s = v @ x.T
            s /= np.linalg.norm(v, axis=1)[:, None] * sizes[None, :]
        s[~np.isfinite(s) if apart else (asked[:, None] == own[None, :]) | ~np.isfinite(s)] = -np.inf
        s = s if digits is None else np.round(s, digits)
        last = np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0)]
        query, row = np.nonzero((s >= last[:, None]) & np.isfinite(s))
        score = s[query, row]
        order = np.lexsort((own[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k
        found.append((asked[query[best]], own[row[best]], score[best]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "id", "score"])


def fuse_ranks(*rankings: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) tables."""
    every = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "id", "rank"))
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def in_scope(chunks: DataFrame, symbols: list[str], source_type: str | None = None, section_code: str | None = None) -> DataFrame:
    """Chunks about any of the symbols, of one type of source and, for filings only, of one section."""
    if section_code is not None and source_type != "filing":
        raise ValueError("only filings have sections")
    rows = chunks.filter(F.arrays_overlap("configured_symbols", F.array(*[F.lit(s) for s in symbols])))
    if source_type is not None:
        rows = rows.filter(F.col("source_type") == source_type)
    return rows if section_code is None else rows.filter(F.col("section_code") == section_code)


def lexical_top_k(chunks: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "chunk_id", text_col: str = "chunk_text", digits: int = 9) -> DataFrame:
    """query_id, rank, id, score: chunks by the summed rarity of the query's words they hold (``queries``: query_id, query_text); scores are rounded before they are ranked.

    Words of the queries alone are matched and counted, so a word that most chunks hold moves no text.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    asked = queries.select("query_id", F.explode(words(F.col("query_text"))).alias("word"))
    wanted = asked.select("word").distinct()
    held = chunks.select(F.col(id_col).alias("id"), F.explode(words(F.col(text_col))).alias("word")).join(wanted, "word", "left_semi")
    size = chunks.agg(F.count(F.lit(1)).alias("_chunks"))  # one row
    rarity = held.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).crossJoin(size).select("word", F.log(1 + F.col("_chunks") / F.col("_n")).alias("_weight"))
    scored = held.join(rarity, "word").join(asked, "word").groupBy("query_id", "id").agg(F.round(F.sum("_weight"), digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def embedding_top_k(chunks: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "chunk_id", text_col: str = "chunk_text", dims: int = 64) -> DataFrame:
    """query_id, rank, id, score: chunks by the cosine of their text's embedding with the query's (``queries``: query_id, query_text)."""
    held = embed_text(chunks, id_col=id_col, text_col=text_col, dims=dims)
    asked = embed_text(queries, id_col="query_id", text_col="query_text", dims=dims)
    return cosine_top_k(held, asked, k, id_col=id_col, query_id_col="query_id", digits=9)


def hybrid_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "chunk_id", text_col: str = "chunk_text", dims: int = 64) -> DataFrame:
    """The fused ranking of a search by embeddings and one by words, each of twice as many candidates."""
    sides = [search(chunks, queries, 2 * k, id_col=id_col, text_col=text_col) for search in (partial(embedding_top_k, dims=dims), lexical_top_k)]
    return fuse_ranks(*sides, k=k)


def candidates_for(k: int, comparison: bool, topic: str, most: int = 10) -> int:
    """How many rows to ask for: twice as many where some will be left out as no developments."""
    if not 1 <= k <= most:
        raise ValueError(f"1 to {most} results")
    return min(most, 2 * k) if comparison and topic == "recent_developments" else k


def without_noise(ranked: DataFrame, k: int, *, title_col: str = "title", text_col: str = "chunk_text") -> DataFrame:
    """Ranked rows (query_id, rank, title, text) that are developments, renumbered from 1, ``k`` at most."""
    kept = ranked.filter(~F.coalesce(is_noise(F.col(title_col), F.col(text_col)), F.lit(False)))
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def match_measures(ranking: DataFrame, top: int = 5) -> DataFrame:
    """Per case the shares of its top rows that are of the expected symbol, source and section (null where no section is expected).

    ``ranking``: case_id, rank (null: nothing was found), configured_symbols, source_type, section_code, expected_symbol, expected_source_type, expected_section_code.
    """
    in_top = F.col("rank") <= top
    share = lambda hit: F.coalesce(F.avg(F.when(in_top, F.coalesce(hit, F.lit(False)).cast("double"))), F.lit(0.0))
    section = share(F.col("section_code") == F.col("expected_section_code"))
    return ranking.groupBy("case_id").agg(
        share(F.array_contains("configured_symbols", F.col("expected_symbol"))).alias(f"symbol_match_at_{top}"),
        share(F.col("source_type") == F.col("expected_source_type")).alias(f"source_match_at_{top}"),
        F.when(F.max("expected_section_code").isNotNull(), section).alias(f"section_match_at_{top}"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Judged cases from one JSON document (label_status, cases): a row per case that is labelled."""
    schema = "label_status string, cases array<struct<case_id: string, query: string, expected_symbol: string, expected_source_type: string, expected_section_code: string, relevant_chunk_ids: array<string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("label_status", F.inline("cases"))


def judged_ranking(cases: DataFrame, ranking: DataFrame) -> DataFrame:
    """Ranked rows (case_id, rank, chunk_id, ...) with ``relevant``; a case that found nothing keeps one row without a rank."""
    return cases.join(ranking, "case_id", "left").withColumn("relevant", F.coalesce(F.array_contains("relevant_chunk_ids", F.col("chunk_id")), F.lit(False)))


def case_measures(ranking: DataFrame, ks: tuple[int, ...] = (1, 3, 5), top: int = 5) -> DataFrame:
    """Per case: hit@k, reciprocal rank, share of relevant rows and of repeated documents in the top.

    ``ranking``: case_id, rank (null: nothing was found), relevant boolean, document_id.
    """
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    in_top = F.col("rank") <= top
    n = F.count_if(in_top)
    return ranking.groupBy("case_id").agg(
        *[F.max(F.when((F.col("rank") <= k) & F.col("relevant"), 1).otherwise(0)).cast("double").alias(f"hit_at_{k}") for k in ks],
        F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"),
        F.avg(F.when(in_top, F.col("relevant").cast("double"))).alias(f"match_at_{top}"),
        F.when(n > 0, (n - F.count_distinct(F.when(in_top, F.col("document_id")))) / n).alias(f"duplicate_rate_at_{top}"),
    )


def suite_measures(cases: DataFrame) -> DataFrame:
    """Means over cases, nulls left out."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), *[F.avg(c).alias(c) for c in cases.columns if c != "case_id"])
