"""Golden cases of the engine's operators, and every query against DuckDB."""

import datetime as dt
import os
import random
import re
import tempfile
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.functions.decimals import exact
from ledgerlight.functions.times import document_date, instant
from ledgerlight.operators import claims, corpus, fundamentals, market, retrieval, serving, validate, versions
from ledgerlight.plans import reference_queries, snapshot_queries, trace_queries
from ledgerlight.sinks import snapshots
from ledgerlight.sources import envelopes, requests
from ledgerlight.streaming import incremental

DATA = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return f"{value:.13g}"
    if isinstance(value, Decimal):
        return f"{float(value):.13g}"
    return str(value)


EVERY = reference_queries.ALL | snapshot_queries.ALL | trace_queries.ALL


@pytest.mark.parametrize("name", [n for n, (_, sql) in EVERY.items() if sql])
def test_queries_equal_duckdb(spark, name):
    query, sql = EVERY[name]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    found = query(spark, DATA)
    columns = sorted(found.columns)
    wanted = con.execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(names) == columns
    rows = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in wanted.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in found.collect()) == rows


def _series(spark, n=70):
    rows = [(s, dt.date(2026, 1, 1) + dt.timedelta(days=i), Decimal(base + i)) for s, base in (("A", 100), ("B", 200)) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, trading_date date, close decimal(20,8)").withColumn("bar_timestamp", F.col("trading_date").cast("timestamp"))


def test_market_metrics_of_a_rising_series(spark):
    bars = _series(spark)
    a = {r["symbol"]: r for r in market.market_metrics(bars).collect()}["A"]
    assert (a["close"], a["sma_20"], a["observations_available"]) == (169, Decimal("159.5"), 70)
    assert a["return_60d"] == Decimal("0.5504587156") and a["max_drawdown_60d"] == 0 == a["current_drawdown_60d"]
    again = market.market_metrics(bars.orderBy(F.desc("close")).repartition(3))
    assert again.exceptAll(market.market_metrics(bars)).isEmpty()


def test_short_series_have_no_long_metrics(spark):
    a = market.market_metrics(_series(spark, 30)).first()
    assert a["return_60d"] is None and a["sma_60"] is None and a["sma_20"] is not None
    assert not market.coverage_gate(_series(spark, 30)).first()["enough"]


def test_versions_count_repeats_conflicts_and_older_contents(spark):
    rows = spark.createDataFrame([("k", 1, "x", 1), ("k", 2, "y", 2), ("k", 2, "y", 3), ("k", 0, "y", 4), ("c", 1, "x", 5), ("c", 1, "z", 6), (None, 1, "x", 7)], "key string, v int, content string, id int")
    found = {r["key"]: r for r in versions.current_versions(rows, ["key"], "v", ["content"], "id").collect()}
    assert (found["k"]["id"], found["k"]["duplicates"], found["k"]["superseded"], found["k"]["conflicts"]) == (2, 2, 1, 0)
    assert found["c"]["conflicts"] == 1 and found[None]["id"] == 7


def test_bars_are_validated_by_kind_of_number(spark):
    good = '{"t": "2026-01-05T05:00:00Z", "o": 10, "h": 11.5, "l": 9, "c": 10.25, "v": 100}'
    cases = [good, good.replace("10.25", '"10.25"'), good.replace("10.25", "true"), good.replace("10.25", "10.123456789"), good.replace("100}", "0}"), good.replace("05:00:00Z", "05:00:00"), good.replace('"h": 11.5', '"h": 10.1'), '{"t": "2026-01-05T05:00:00Z"}']
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, j string").select("i", F.lit("A").alias("symbol"), F.parse_json("j").alias("bar"), F.lit("2026-01-09 00:00:00").cast("timestamp").alias("fetched_at"))
    issues = {r["i"]: [i["code"] for i in r["issues"]] for r in validate.validate_bars(rows).collect()}
    assert issues[0] == [] and issues[1] == issues[2] == ["numeric_type"] and issues[3] == ["decimal_20_8"] and issues[4] == ["not_positive"]
    assert issues[5][0] == "invalid_timestamp" and issues[6] == ["outside_low_high"] and issues[7] == ["required_field"] * 5


def test_envelopes_open_into_bars_articles_facts(spark):
    payload = '{"bars": {"A": [{"t": "2026-01-05T05:00:00Z", "o": 1, "h": 1, "l": 1, "c": 1, "v": 1}]}, "news": [{"id": 1}], "cik": 320193, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"val": 5}]}}}}}'
    e = spark.createDataFrame([("r1", 200, payload, len(payload))], "source_response_id string, http_status int, response_payload_json string, response_bytes long")
    e = e.withColumns({"response_sha256": T.sha256(F.col("response_payload_json")), "source_system": F.lit("s"), "ingestion_run_id": F.lit("x"), "fetched_at": F.current_timestamp()})
    assert envelopes.envelope_faults(e).isEmpty() and envelopes.envelope_faults(e.withColumn("http_status", F.lit(500))).count() == 1
    assert envelopes.bars_of(e).first()["symbol"] == "A" and envelopes.articles_of(e).count() == 1
    assert envelopes.facts_of(e, ["Revenues", "Assets"]).select("cik", "concept").collect() == [("0000320193", "Revenues")]


def test_articles_and_facts_report_their_issues(spark):
    a = '{"id": 7, "headline": " H ", "source": "s", "url": "https://x.org/a", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-02T00:00:00Z", "symbols": ["B", "A"]}'
    bad = a.replace("https://x", "https://user:pw@x").replace("7", "true")
    rows = spark.createDataFrame([(1, a), (2, bad)], "i int, j string").select("i", F.parse_json("j").alias("article"), F.lit("2026-02-01 00:00:00").cast("timestamp").alias("fetched_at"))
    found = {r["i"]: r for r in validate.validate_articles(rows, ["A", "B"]).collect()}
    assert found[1]["issues"] == [] and found[1]["configured_symbols"] == ["A", "B"] and [tuple(i) for i in found[2]["issues"]] == [("invalid_article_id", "id"), ("invalid_citation_url", "url")]
    f = '{"start": "2025-01-01", "end": "2025-12-31", "val": -5, "accn": "0000000001-26-000001", "fy": 2025, "form": "10-K", "filed": "2026-02-01"}'
    rows = spark.createDataFrame([(1, "Revenues", f), (2, "Assets", f), (3, "Revenues", f.replace("2025,", "true,"))], "i int, concept string, j string").select("i", "concept", F.parse_json("j").alias("observation"))
    found = {r["i"]: [tuple(i) for i in r["issues"]] for r in validate.validate_facts(rows, ["Assets"]).collect()}
    assert found == {1: [], 2: [("unexpected_start_for_instant_fact", "start")], 3: [("invalid_optional_integer", "fy")]}
    odd = [f.replace("-5", "1.123456789"), f.replace("-5", "123456789012345678901"), f.replace("-5", '"5"'), f.replace('"2025-01-01"', '"2026-01-01"'), "[1]", f.replace('"10-K"', '" "').replace("0000000001-26-000001", "1")]
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(odd)], "i int, j string").select("i", F.lit("Revenues").alias("concept"), F.parse_json("j").alias("observation"))
    found = {r["i"]: [i["code"] for i in r["issues"]] for r in validate.validate_facts(rows, ["Assets"]).collect()}
    assert found == {0: ["fact_value_exceeds_scale"], 1: ["fact_value_out_of_range"], 2: ["invalid_fact_value"], 3: ["period_start_after_end"], 4: ["observation_not_object"], 5: ["invalid_accession_number", "missing_or_invalid_required_string"]}


def test_articles_say_what_is_wrong_where(spark):
    a = '{"id": 7, "headline": "H", "source": "s", "url": "https://x.org/a", "summary": null, "content": " ", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-02T00:00:00Z", "symbols": []}'
    odd = [a, a.replace("01T00:00:00Z", "01T00:00:00"), a.replace("2026-01-01", "2026-01-03"), a.replace("2026-01-02", "2027-01-02"), a.replace('"H"', "3").replace("null", "5"), a.replace("[]", '["A", " "]'), a.replace("[]", "3"), a.replace("2026-01-02T", "soon")]
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(odd)], "i int, j string").select("i", F.parse_json("j").alias("article"), F.lit("2026-02-01 00:00:00").cast("timestamp").alias("fetched_at"))
    found = {r["i"]: [i["code"] for i in r["issues"]] for r in validate.validate_articles(rows, ["A"]).collect()}
    assert found == {0: [], 1: ["timezone_required"], 2: ["created_after_updated"], 3: ["updated_after_fetched"], 4: ["invalid_required_string", "invalid_optional_string"], 5: ["invalid_symbol_tag"], 6: ["invalid_symbols"], 7: ["invalid_timestamp"]}


def test_numbers_that_json_cannot_say_are_not_finite(spark):
    payload = '{"bars": {"A": [{"t": "2026-01-05T05:00:00Z", "o": NaN, "h": 1, "l": 1, "c": -Infinity, "v": 1}]}}'
    e = spark.createDataFrame([("r1", payload, "x")], "source_response_id string, response_payload_json string, ingestion_run_id string").withColumn("fetched_at", F.lit("2026-02-01 00:00:00").cast("timestamp"))
    assert [tuple(i) for i in validate.validate_bars(envelopes.bars_of(e)).first()["issues"]] == [("nonfinite", "open"), ("nonfinite", "close")]
    assert validate.issue_counts(validate.validate_bars(envelopes.bars_of(e))).count() == 2


def test_trailing_months_bridge(spark):
    d = dt.date
    rows = []
    for concept, k in (("revenue", 1), ("net_income", 10)):
        rows += [("e", concept, d(2024, 1, 1), d(2024, 12, 31), Decimal(100 * k), "10-K", d(2025, 2, 1), "a"), ("e", concept, d(2024, 1, 1), d(2024, 3, 31), Decimal(20 * k), "10-Q", d(2024, 5, 1), "b"), ("e", concept, d(2025, 1, 1), d(2025, 3, 31), Decimal(30 * k), "10-Q", d(2025, 5, 1), "c")]
    facts = spark.createDataFrame(rows, "entity string, concept string, period_start date, period_end date, fact_value decimal(28,8), filing_form string, filing_date date, accession_number string")
    found = {r["concept"]: r["ttm"] for r in fundamentals.year_to_date_bridge(facts).collect()}
    assert found == {"revenue": 110, "net_income": 1100}
    gone = facts.filter("accession_number != 'b'")
    assert fundamentals.year_to_date_bridge(gone).first()["ttm"] is None


def test_chunks_cover_the_text(spark):
    text = ("One sentence here. " * 40 + "\n\n") * 12
    docs = spark.createDataFrame([("d", text), ("e", ""), ("n", None), ("s", "short")], "document_id string, document_text string")
    found = corpus.chunks(docs, id_col="document_id", target=400, most=600, overlap=50)
    assert found.filter("document_id in ('e', 'n')").isEmpty() and found.filter("document_id = 's'").count() == 1
    faults = corpus.chunk_faults(found, docs, id_col="document_id").filter("document_id = 'd'").first()
    assert (faults["index_faults"], faults["gaps"], faults["slice_faults"], faults["uncovered"]) == (0, 0, 0, False)
    plain = corpus.chunks(spark.createDataFrame([("d", "a" * 25)], "document_id string, document_text string"), id_col="document_id", target=10, most=10, overlap=0)
    assert sorted((r["character_start"], r["character_end"], r["chunk_text"]) for r in plain.collect()) == [(0, 10, "a" * 10), (10, 20, "a" * 10), (20, 25, "a" * 5)]


def plain_spans(text, target, most, overlap):
    """Chunks by a loop over boundaries, each found by a plain scan of the stretch that it is looked for in."""
    forms = [re.compile(p) for p in (r"\n[ \t]*\n+", r"[.!?][\"')\]]*[ \t\n]+", r"\s+")]

    def ends(form, lo, hi, upto):
        return [m.end() for m in forms[form].finditer(text, lo, hi) if m.end() <= upto]

    start, found = 0, []
    while len(text) - start > most:
        goal, limit = start + target, start + most
        ahead = [ends(k, goal, limit + 1, limit) for k in (0, 1)]
        behind = [ends(k, start, upto + 1, upto) for k, upto in ((0, goal), (1, goal), (2, limit))]
        end = next((e[0] for e in ahead if e), None) or next((e[-1] for e in behind if e), limit)
        found.append((start, end))
        back = max(start + 1, end - overlap) if overlap else end
        start = next((e[0] for e in (ends(k, back, end, end - 1) for k in (0, 1, 2)) if e), back)
    return [*found, (start, len(text))] if text else found


@pytest.mark.parametrize("sizes", [(40, 60, 10), (10, 10, 0), (30, 50, 29)])
def test_chunks_end_where_a_plain_scan_says(spark, sizes):
    rng = random.Random(1)
    parts = ["a", "bc ", "d. ", 'e?") ', "\n\n", "\n \n\n", " ", "\xa0", "\n\n \n", "!", "\n", "\t", "öß", "😀 "]
    texts = ["".join(rng.choice([*parts, "xyz" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", corpus.chunk_spans("t", *sizes).alias("s")).collect():
        text = texts[r["i"]]
        assert [(x["character_start"], x["character_end"]) for x in r["s"]] == plain_spans(text, *sizes)
        assert all(x["chunk_text"] == text[x["character_start"] : x["character_end"]] for x in r["s"])


def test_long_texts_are_cut_in_one_fold(spark):
    rows = spark.sql("SELECT repeat('word. another word ', 60000) AS t")
    (row,) = rows.select(F.size(corpus.chunk_spans("t")).alias("n"), F.length("t").alias("c")).collect()
    assert row["n"] > row["c"] / 3200


def test_references_that_are_cut_off_stay_in_page_texts(spark, tmp_path):
    odd = ("&quot", "&quo", "&q", "&", "&copy", "&middot", "&amp", "&am", "&amp;quot", "&amp;quot;", "&amp&quot", "&amp_", "&ampé", "&ampx", "&quot;", "&copy;2", "&copy2", "&middot;", "&quot_;", "&#34")
    html = [f"<head><title>{x}</title></head><h1>a {x}</h1><p title='{x}'>{x} b{x}</p>c {x}" for x in odd]
    spark.createDataFrame([*enumerate(html), (len(html), "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = reference_queries.html_text(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(reference_queries.HTML_SQL).fetchall())
    assert ("a &quot &quot b&quot c &quot", "a & & b& c &") == tuple(r["page_text"] for r in sorted(found) if r["page_id"] in (0, 6))


def test_html_keeps_visible_text_only(spark):
    rows = spark.createDataFrame([("<head><title>t</title></head><p> a <b>b</b>&amp;c</p><script>x</script>",), (None,)], "h string")
    assert [r[0] for r in rows.select(corpus.visible_text("h")).collect()] == ["a b &c", None]


def test_text_and_number_expressions(spark):
    row = spark.range(1).select(T.strip(F.lit("\t a  ")).alias("s"), T.cik10(F.lit("320193")).alias("c"), T.unique_list(F.lit("a, b,a")).alias("u"), exact(F.lit("1.123456789"), 20, 8).alias("x"), exact(F.lit("1e3"), 20, 8).alias("y"), instant(F.lit("2026-01-01T00:00:00")).alias("t"), document_date(F.lit("September 27, 2025")).alias("d"), T.money_words(F.lit(Decimal("1234500000"))).alias("m")).first()
    assert row["s"] == "a" and row["c"] == "0000320193" and row["u"] is None and row["x"] is None and row["y"] == 1000
    assert row["t"] is None and row["d"] == dt.date(2025, 9, 27) and row["m"] == "1.23B"


def test_ranked_results_are_measured(spark):
    rows = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, True, "x"), ("b", 1, False, "y"), ("c", None, False, None)], "case_id string, rank int, relevant boolean, document_id string")
    found = {r["case_id"]: r for r in retrieval.case_measures(rows).collect()}
    assert (found["a"]["hit_at_1"], found["a"]["hit_at_3"], found["a"]["reciprocal_rank"], found["a"]["duplicate_rate_at_5"]) == (0, 1, 0.5, 0.5)
    assert found["b"]["reciprocal_rank"] == 0 and found["c"]["hit_at_5"] == 0


def test_claims_need_their_sources(spark):
    said = claims.claims_in(spark.createDataFrame([("k", "Up 12.5% to $1,200.50 on 2026-01-02, 3 times in 2025.")], "key string, text string"))
    assert {(r["kind"], r["raw"]) for r in said.collect()} == {("percent", "12.5%"), ("number", "$1,200.50"), ("date", "2026-01-02"), ("year", "2025")}
    source = claims.claims_in(spark.createDataFrame([("k", "12.5% and 2026-01-02")], "key string, text string"))
    assert {r["raw"] for r in claims.unsupported_claims(said, source, "key").collect()} == {"$1,200.50", "2025"}
    expected = spark.createDataFrame([("k", "number", 1200.504, None), ("k", "percent", 0.125, None), ("k", "date", None, dt.date(2026, 1, 2))], "key string, kind string, expected double, expected_day date")
    assert {r["raw"] for r in claims.off_expected(said, expected, "key").collect()} == {"2025"}


def test_snapshots_change_together_or_not_at_all(spark):
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    one, two = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, x string")
    assert snapshots.publish(spark, root, "s1", {"docs": one}) == 1
    with pytest.raises(ValueError):
        snapshots.publish(spark, root, "s2", {"docs": two}, faults=one)
    assert snapshots.read_current(spark, root, "docs").collect() == one.collect()
    assert snapshots.publish(spark, root, "s2", {"docs": two}) == 2
    assert snapshots.changes(spark, root, "docs", 1, 2).groupBy("change").count().collect() == [("added", 2), ("removed", 1)] or snapshots.read_current(spark, root, "docs").count() == 2
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert snapshots.snapshot_id(ids, "id", "v1") == snapshots.snapshot_id(ids.orderBy(F.desc("id")), "id", "v1") != snapshots.snapshot_id(ids, "id", "v2")


def test_a_stream_keeps_the_current_versions(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "key int, v int, id string").write.parquet(f"{root}/in/p1")
    stream = spark.readStream.schema("key int, v int, id string").option("recursiveFileLookup", "true").parquet(f"{root}/in")
    incremental.keep_current(stream, f"{root}/out", f"{root}/cp", ["key"], "v", "id").awaitTermination()
    spark.createDataFrame([(1, 3, "c"), (2, 1, "d")], "key int, v int, id string").write.parquet(f"{root}/in/p2")
    incremental.keep_current(stream, f"{root}/out", f"{root}/cp", ["key"], "v", "id").awaitTermination()
    assert sorted(incremental.read_kept(spark, f"{root}/out", 1).collect()) == [(1, 3, "c"), (2, 1, "d")]


def test_readiness_and_status(spark):
    asked, have = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"), spark.createDataFrame([("A", dt.date(2026, 1, 9)), ("B", dt.date(2026, 1, 1))], "symbol string, d date")
    found = {r["symbol"]: (r["status"], r["reason"]) for r in serving.readiness(asked, have, "symbol", "d", F.lit("2026-01-10").cast("date")).collect()}
    assert found == {"A": ("ready", None), "B": ("unavailable", "stale"), "C": ("unavailable", "missing")}


def test_requests():
    now = dt.datetime(2026, 3, 10, 12, tzinfo=dt.UTC)
    start, end = requests.bar_window("incremental", lookback_days=2, now=now)
    assert (start.isoformat(), end.isoformat()) == ("2026-03-08T05:00:00+00:00", "2026-03-10T03:59:59+00:00")
    assert requests.retry_delay(3) == 4 and requests.retry_delay(9, 50) == 30 and abs(requests.spacing_delay(0.05) - 0.15) < 1e-9
    cursor = requests.Cursor().advance("a")
    with pytest.raises(ValueError):
        cursor.advance("a")
    assert cursor.advance(None).done and requests.filing_path("0000320193", "0000320193-25-000001", "x.htm") == "/Archives/edgar/data/320193/000032019325000001/x.htm"
