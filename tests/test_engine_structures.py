"""Embeddings, trees of sums, the segment index, series summaries, versions and bands, against plain Python."""

import hashlib
import random
import re
import tracemalloc
import weakref
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import bands, claims, corpus, embedding, market, multiset, reports, retrieval, versions
from ledgerlight.sinks import snapshots
from ledgerlight.sinks.search_index import SegmentIndex


def vector_of(text, dims=64):
    v = [0] * dims
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        h = hashlib.md5(word.encode()).hexdigest()
        for k in range(4):
            v[int(h[8 * k : 8 * k + 7], 16) % dims] += -1 if int(h[8 * k + 7], 16) % 2 else 1
    return v


def test_embeddings_are_sums_over_words(spark):
    texts = [(1, "The fox, the FOX and 7 foxes"), (2, None), (3, ""), (4, "éa ß " * 3000), (5, "?!")]
    found = {r["doc_id"]: r["embedding"] for r in embedding.embed_text(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == {i: vector_of(t) for i, t in texts}


def test_near_texts_have_near_embeddings(spark):
    words = [f"w{i}" for i in range(200)]
    rng = random.Random(1)
    base = [rng.choice(words) for _ in range(80)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:70] + ["x"] * 10)), *[(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(3, 40)]]
    chunks = spark.createDataFrame(texts, "chunk_id long, chunk_text string")
    asked = spark.createDataFrame([(1, " ".join(base)), (7, "")], "query_id long, query_text string")
    found = retrieval.embedding_top_k(chunks, asked, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(1, 1), (1, 2)] and found[0]["score"] == 1.0


def test_trees_of_sums_equal_except_all(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", ""]), rng.choice([None, 0.5, 2.0])) for _ in range(400)]
    other = rows[5:] + [(None, "a", None), ("x" and 3, None, 0.5), (1, "new", 9.0)] + rows[:2]
    a, b = (spark.createDataFrame(r, "n int, s string, v double") for r in (rows, other))
    found = Counter(tuple(r) for r in multiset.difference(a, b.select("v", "s", "n").select("n", "s", "v")).collect())
    x, y = Counter(rows), Counter(other)
    assert found == Counter({(*k, "before"): n for k, n in (x - y).items()} | {(*k, "after"): n for k, n in (y - x).items()})
    assert multiset.difference(a, a.repartition(7)).isEmpty() and multiset.difference(a.limit(0), b.limit(0)).isEmpty()
    assert multiset.root(a) == multiset.root(a.orderBy("v")) != multiset.root(b) and multiset.root(a, "x") != multiset.root(a)


def test_only_differing_buckets_are_compared_row_by_row(spark):
    a = spark.range(20_000).withColumn("v", F.col("id") * 3)
    b = a.withColumn("v", F.when(F.col("id") == 77, 1).otherwise(F.col("v")))
    left, right = multiset.candidates(a, b)
    assert left.count() <= 3 and right.count() <= 3
    assert sorted(map(tuple, multiset.difference(a, b).collect())) == [(77, 1, "after"), (77, 231, "before")]


def test_an_index_follows_its_table(spark, tmp_path):
    table, index = f"file://{tmp_path}/t", SegmentIndex(spark, f"file://{tmp_path}/i")
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    held = {i: " ".join(rng.choice(words) for _ in range(8)) for i in range(60)}
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w39 nothing"), (3, "")], "query_id long, query_text string")
    assert index.search(asked).isEmpty() and index.sync(table, "docs") is None
    for change in range(4):
        for i in rng.sample(sorted(held), 5) if change else []:
            if rng.random() < 0.4:
                del held[i]
            else:
                held[i] = " ".join(rng.choice(words) for _ in range(8))
        if change == 3:
            held |= {i: "w1 w2 again" for i in (100, 101)}
        rows = spark.createDataFrame(sorted(held.items()), "doc_id long, text string")
        snapshots.publish(spark, table, f"snapshot{change:016d}", {"docs": rows})
        segment = index.sync(table, "docs")
        assert index.sync(table, "docs") is None  # nothing new
        rebuilt = retrieval.lexical_top_k(rows, asked, 10, id_col="doc_id", text_col="text")
        wanted = {tuple(r) for r in rebuilt.collect()}
        assert index.version()["texts"] == len(held)
        assert {tuple(r) for r in index.search(asked, 10).collect()} == wanted and len(wanted) >= 10
        # What a change set writes follows the change, not the table.
        read = spark.read.parquet(f"file://{tmp_path}/i/segments/{segment:08d}/words").select("id").distinct().count()
        assert read == len(held) if change == 0 else read <= 7
    index.merge()
    assert len(index.version()["segments"]) == 1 and {tuple(r) for r in index.search(asked, 10).collect()} == wanted


def test_series_are_summed_up_by_blocks(spark):
    rng = random.Random(4)
    rows = [(s, date(2020, 1, 1) + timedelta(days=d), Decimal(rng.randint(1, 10_000)) / 7) for s, n in (("HOT", 900), ("B", 3), ("C", 61)) for d in range(n)]
    rows = [(s, d, c.quantize(Decimal("1E-8"))) for s, d, c in rows]
    bars = spark.createDataFrame(rows, "symbol string, trading_date date, close decimal(20,8)").withColumn("bar_timestamp", F.col("trading_date").cast("timestamp"))
    for r in market.series_summary(bars, days=50).collect():
        closes = [c for s, _, c in rows if s == r["symbol"]]
        peak, worst = Decimal(0), Decimal(0)
        for c in closes:
            peak = max(peak, c)
            worst = min(worst, ((c - peak) / peak).quantize(Decimal("1E-10")))
        assert (r["bars"], r["high"], r["low"], r["worst_fall"]) == (len(closes), max(closes), min(closes), worst)
    last = market.last_sessions(bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("observations_available").alias("of"), F.min("trading_date").alias("d")).collect()
    assert {(r["symbol"], r["n"], r["of"], r["d"]) for r in last} == {("HOT", 61, 900, date(2020, 1, 1) + timedelta(days=839)), ("B", 3, 3, date(2020, 1, 1)), ("C", 61, 61, date(2020, 1, 1))}


def test_a_series_is_cut_in_tasks_before_it_moves(spark):
    bars = spark.range(1000).select(F.lit("S").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("trading_date"), F.col("id").cast("decimal(20,8)").alias("close"), F.lit(None).cast("timestamp").alias("bar_timestamp"))
    plan = market.newest(bars, ["symbol"], [F.col("trading_date").desc()], 61, date="trading_date")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_versions_combine_before_their_key_meets(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "k", "k", "j"]), rng.randint(1, 4), i, rng.choice("ab")) for i in range(200)]
    table = spark.createDataFrame(rows, "key string, version int, id long, content string")
    for r in versions.earliest_of_latest(table, ["key"], "version", ["content"], ["id"]).collect():
        mine = [x for x in rows if x[0] == r["key"]]
        last = [x for x in mine if x[1] == max(x[1] for x in mine)]
        assert (r["version"], r["id"], r["superseded"], r["repeats"], r["conflict"]) == (last[0][1], min(x[2] for x in last), len(mine) - len(last), len(last) - 1, len({x[3] for x in last}) > 1)
    assert {r["key"] for r in versions.current_versions(table, ["key"], "version", ["content"], "id").collect()} == {None, "k", "j"}


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_bands_equal_all_pairs(spark, how):
    rng = random.Random(6)
    left = [(i, rng.choice(["hot", "hot", None, "b"]), rng.choice([None, rng.randint(-500, 500)])) for i in range(300)]
    right = [(i, rng.choice(["hot", "hot", None, "c"]), rng.choice([None, rng.randint(-500, 500)])) for i in range(300)]
    a, b = spark.createDataFrame(left, "i int, k string, v int"), spark.createDataFrame(right, "j int, k string, w int")
    found = bands.band_join(a, b, ["k"], low=F.col("v") - 3, high=F.col("v") + 4, low_cell=F.floor((F.col("v") - 3) / 7), value="w", value_cell=F.floor(F.col("w") / 7), how=how)
    pairs = {(i, j) for i, k, v in left for j, m, w in right if k == m and v is not None and w is not None and v - 3 <= w <= v + 4}
    ids = {i for i, _ in pairs}
    got = [(r["i"], r["j"]) if how == "inner" else r["i"] for r in found.collect()]
    assert sorted(got) == sorted(pairs if how == "inner" else ids if how == "left_semi" else {i for i, _, _ in left} - ids)


def test_comparisons_cite_the_eligible_findings_and_no_others(spark):
    findings = spark.createDataFrame([(1, "a", "market", "X"), (1, "b", "market", "Y"), (1, "c", "risks", "X"), (1, "d", "news", "X"), (1, "e", "news", "Z"), (2, "a", "market", "X")], "request_id int, finding_id string, dimension string, symbol string")
    requests = spark.createDataFrame([(1, ["X", "Y"]), (2, ["X", "Y"])], "request_id int, symbols array<string>")
    section = "request_id int, section string, status string, source_finding_ids array<string>"
    faults = lambda *rows: sorted(map(tuple, reports.comparison_faults(spark.createDataFrame([(r, "comparative_assessment", s, c) for r, s, c in rows], section), findings, requests).collect()))
    assert faults((1, "available", ["a", "b"]), (2, "unavailable", [])) == []
    assert faults((1, "degraded", ["b", "c"]), (2, "available", ["a"])) == [(1, "a", "left_out"), (1, "c", "not_eligible"), (2, "a", "not_eligible")]


def test_a_block_of_vectors_is_searched_a_few_queries_at_a_time():
    rng = np.random.default_rng(3)
    n, asked = 8000, 256
    v = np.round(rng.normal(size=(n + asked, 4)), 1)  # many ties
    block = pa.table({"is_query": [False] * n + [True] * asked, "id": [*range(n), *range(asked)], "v": pa.array(list(v), pa.list_(pa.float64()))})
    tracemalloc.start()
    found = retrieval._nearest(block, 5, digits=6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * asked  # one matrix of all scores is as large
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.round((v[n:] @ v[:n].T) / (np.linalg.norm(v[n:], axis=1)[:, None] * np.linalg.norm(v[:n], axis=1)[None, :]), 6)
    wanted = [(q, i) for q in range(asked) for i in sorted((i for i in range(n) if i != q and np.isfinite(s[q, i])), key=lambda i: (-s[q, i], i))[:5]]
    assert list(zip(found["query_id"].to_pylist(), found["id"].to_pylist(), strict=True)) == wanted


def test_words_are_summed_where_their_text_is_read(spark):
    texts = spark.createDataFrame([(1, "one two one"), (2, None), (3, "…"), (1, "three"), (4, "Ünï ½ 日本")], "doc_id long, text string")
    found = embedding.embed_text(texts, dims=8)
    assert "Generate" not in found._jdf.queryExecution().toString()
    said = {1: ["one", "two", "one", "three"], 2: [], 3: [], 4: ["ünï", "½", "日本"]}
    placed = spark.createDataFrame([(w,) for w in sorted({w for ws in said.values() for w in ws})], "word string")
    places = {r[0]: r[1] for r in placed.select("word", embedding.signed_places(F.col("word"), 8, 4)).collect()}
    for row in found.collect():
        wanted = [0] * 8
        for p in (p for w in said[row["doc_id"]] for p in places[w]):
            wanted[abs(p) - 1] += 1 if p > 0 else -1
        assert row["embedding"] == wanted


def test_a_few_texts_at_a_time_are_python_objects():
    lists = []

    class Counted(str):
        pass

    def one(text):
        lists.append(weakref.ref(kept := Counted(text)))
        alive.append(sum(r() is not None for r in lists))
        return kept

    alive = []
    made = corpus.in_slices(pa.array(["a", None, "c"] * 200), one, pa.string(), rows=16)
    assert made.to_pylist() == ["a", None, "c"] * 200 and max(alive) <= 16
    assert corpus.in_slices(pa.array([], pa.string()), one, pa.string()).to_pylist() == []


def test_parts_of_a_claim_are_computed_once(spark):
    plan = claims.claims_in(spark.createDataFrame([("a 5%",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 4 and plan.count("regexp_extract_all(") <= 4


def test_repeated_ids_of_a_change_are_indexed_once(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path))
    index.apply(spark.createDataFrame([(1, "same words", "added"), (1, "same again", "added"), (2, "words", "added")], "doc_id long, text string, change string"))
    held = index._postings([1])
    assert sorted(tuple(r) for r in held.select("word", "id").collect()) == [("again", 1), ("same", 1), ("words", 1), ("words", 2)]
