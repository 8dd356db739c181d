"""Golden cases of filings, claims, snapshots, answers of services, reports and retrieval."""

import datetime as dt
import hashlib
import json
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.functions.decimals import half_even_ratio
from ledgerlight.operators import boundary, claims, corpus, filings, market, quality, reports, retrieval, serving, sessions, snapshots, versions
from ledgerlight.plans import snapshot_queries
from ledgerlight.sources import envelopes, replay


def test_ratios_are_rounded_once(spark):
    rows = [("1", "3"), ("2", "3"), ("-2", "3"), ("1", "0"), ("102.00000001", "60"), ("0.00000001", "200"), ("0.00000003", "200"), ("987654321098765.12345678", "0.00000007"), ("7", "-8")]
    frame = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in rows], "a decimal(30,8), b decimal(30,8)")
    with localcontext() as c:
        c.prec = 60
        wanted = [None if not Decimal(b) else (Decimal(a) / Decimal(b)).quantize(Decimal("1E-10"), rounding=ROUND_HALF_EVEN) for a, b in rows]
    found = [r["r"] for r in frame.select(half_even_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert found[:7] + found[8:] == wanted[:7] + wanted[8:]


def test_moving_averages_keep_their_digits(spark):
    closes = [Decimal(100) + Decimal(i % 7) / 3 for i in range(61)]
    rows = [("A", dt.date(2026, 1, 1) + dt.timedelta(days=i), c.quantize(Decimal("1E-8"))) for i, c in enumerate(closes)]
    frame = spark.createDataFrame(rows, "symbol string, trading_date date, close decimal(20,8)").withColumn("bar_timestamp", F.col("trading_date").cast("timestamp"))
    found = market.market_metrics(frame).first()
    exact = sum(r[2] for r in rows[1:]) / 60
    assert found["sma_60"] == exact.quantize(Decimal("1E-10"), rounding=ROUND_HALF_EVEN)
    assert found["close_vs_sma_60"] == (rows[-1][2] / exact - 1).quantize(Decimal("1E-10"), rounding=ROUND_HALF_EVEN)


def _claims(spark, text):
    return [(r["kind"], r["value"], r["precision"], r["scale"], r["day"]) for r in claims.claims_in(spark.createDataFrame([(text,)], "text string")).collect()]


def test_claims_as_written(spark):
    day = dt.date(2026, 9, 4)
    assert _claims(spark, "On 2026‑09‑04 the return was –2.5% and net income was $128.9 billion.") == [("date", None, None, None, day), ("percent", Decimal("-2.5"), 1, None, None), ("scaled", Decimal("128.9"), 1, "billion", None)]
    assert _claims(spark, "The 20-day return and 60-day volatility, 1,200 units") == []
    assert _claims(spark, "12.5 percent") == [("percent", Decimal("12.5"), 1, None, None)] and _claims(spark, "−5.5%") == [("percent", Decimal("-5.5"), 1, None, None)]
    assert _claims(spark, "2,000") == [("year", Decimal(2000), 0, None, None)] and _claims(spark, "1.2  billion") == [("scaled", Decimal("1.2"), 1, "billion", None)]
    assert [c[0] for c in _claims(spark, "2026-13-45")] == ["year"] and _claims(spark, "５％") == [("percent", Decimal(5), 0, None, None)]


def test_claims_within_half_a_unit(spark):
    def borne(text, kind, value, day=None):
        said = claims.claims_in(spark.createDataFrame([("k", text)], "key string, text string"))
        expected = spark.createDataFrame([("k", kind, None if value is None else Decimal(value), day)], "key string, kind string, expected decimal(28,10), expected_day date")
        return claims.off_expected(said, expected, "key").isEmpty()

    assert borne("The return was 2.2%.", "percent", "0.0218") and not borne("The return was 0.02%.", "percent", "0.0212")
    assert borne("Net income was $128.9 billion.", "scaled", "128900000000") and not borne("Net income was $12.89 billion.", "scaled", "128900000000")
    assert borne("As of 2026-09-04.", "date", None, dt.date(2026, 9, 4)) and borne("In 2026.", "date", None, dt.date(2026, 9, 4))
    said = claims.claims_in(spark.createDataFrame([("k", "Volatility was 31.71%.")], "key string, text string"))
    source = claims.claims_in(spark.createDataFrame([("k", "Volatility was 31.7%.")], "key string, text string"))
    assert [r["raw"] for r in claims.unsupported_claims(said, source, "key").collect()] == ["31.71%"]


CONTEXT = '<xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="{scheme}">{cik}</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:endDate>{end}</xbrli:endDate></xbrli:period></xbrli:context>'


def _filing(spark, *, one=None, two=None, end="Item 1B. Unresolved Staff Comments", toc=True, spaced=False, cik="0000320193", form="10-K", day="September 27 , 2025", context=None, extra="", before="", **other):
    one = one if one is not None else "Our business sells things. " * 30
    two = two if two is not None else "We face many risks here. " * 30
    index = "<table><tr><td>Item 1. Business</td><td>1</td></tr><tr><td>Item 1A. Risk Factors</td></tr><tr><td>Item 1B. Unresolved Staff Comments</td></tr></table>" if toc else ""
    heads = ("Item 1. B usiness", "Item 1A. Ris k Factors") if spaced else ("Item 1. Business", "Item 1A. Risk Factors")
    fact = lambda n, v: f'<ix:nonNumeric name="dei:{n}" contextref="c1">{v}</ix:nonNumeric>'
    facts = fact("EntityCentralIndexKey", cik) + fact("DocumentType", form) + fact("DocumentPeriodEndDate", day) + extra
    context = context or CONTEXT.format(scheme="http://www.sec.gov/CIK", cik="0000320193", end="2025-09-27")
    html = f"<html><head><style>x</style><script>Item 1. Business fake</script></head><body><ix:header>{context}</ix:header>{facts}{index}{before}<h2>{heads[0]}</h2><p>{one}</p><h2>{heads[1]}</h2><p>{two}</p><h2>{end}</h2><p>None.</p></body></html>"
    row = {"cik": "0000320193", "accession_number": "0000320193-25-000079", "primary_document": "aapl.htm", "filing_form": "10-K", "filing_date": dt.date(2025, 10, 31), "report_date": dt.date(2025, 9, 27), "http_status": 200, "response_payload_html": html, "response_bytes": len(html.encode()), "response_sha256": hashlib.sha256(html.encode()).hexdigest(), "source_url": "https://www.sec.gov/Archives/edgar/data/320193/000032019325000079/aapl.htm"} | other
    kinds = {"filing_date": "date", "report_date": "date", "http_status": "int", "response_bytes": "long"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))


def _cut(spark, **case):
    found = filings.filing_sections(_filing(spark, **case)).first()
    return found["issues"], [s["section_text"] for s in found["sections"] or []]


def test_sections_of_a_filing(spark):
    one, two = ("Our business sells things. " * 30).strip(), ("We face many risks here. " * 30).strip()
    for case in ({}, {"toc": False}, {"spaced": True}, {"end": "Item 1C. Cybersecurity"}, {"end": "Item 2. Properties"}, {"day": "2025-09-27"}, {"before": "<p>See Item 1A of this report and Part I, Item 1.</p>"}, {"two": two + " 21 PART I ITEM 1A"}, {"two": two + " 21 PART I Item 1A, 1B"}):
        assert _cut(spark, **case) == ([], [one, two]), case
    plain = "risk " * 150 + "ends."
    assert _cut(spark, two=plain + " Acme Inc. | 2025 Form 10-K | 17") == ([], [one, plain])


@pytest.mark.parametrize(
    ("case", "issues"),
    [
        ({"one": "short"}, ["no_body"]),
        ({"two": "short"}, ["short_section"]),
        ({"end": "Item 9. Other"}, ["no_end"]),
        ({"form": "10-Q"}, ["other_document_type"]),
        ({"day": "September 28, 2025"}, ["other_period_end"]),
        ({"cik": "0000000001"}, ["other_cik"]),
        ({"extra": '<ix:nonNumeric name="dei:DocumentType" contextref="c1">10-Q</ix:nonNumeric>'}, ["conflicting_document_type"]),
        ({"context": CONTEXT.format(scheme="http://x.org", cik="0000320193", end="2025-09-27")}, ["context"]),
        ({"context": CONTEXT.format(scheme="http://www.sec.gov/CIK", cik="0000000001", end="2025-09-27")}, ["context"]),
        ({"context": CONTEXT.format(scheme="http://www.sec.gov/CIK", cik="0000320193", end="2025-09-28")}, ["context"]),
        ({"response_sha256": "0" * 64}, ["response_sha256"]),
        ({"report_date": dt.date(2026, 1, 1)}, ["report_after_filing", "other_period_end", "context"]),
        ({"source_url": "https://x.org/a"}, ["source_url"]),
        ({"before": "<h2>Item 1. Business</h2><p>" + "Other words of a body. " * 40 + "</p>"}, ["ambiguous_body"]),
    ],
)
def test_filings_with_issues_have_no_sections(spark, case, issues):
    if "before" in case:  # a first item 1 whose next item 1A is the body's own
        case = case | {"toc": False}
    assert _cut(spark, **case) == (issues, [])


def test_the_latest_filing_counts(spark):
    schema = "cik string, accession_number string, filing_date date, report_date date, filing_form string, primary_document string, fetched_at int, source_response_id string, response_sha256 string"
    day = lambda d: dt.date(2025, 1, d)
    rows = [("a", "1", day(1), day(1), "10-K", "d", 9, "r0", "h0"), ("a", "2", day(2), day(1), "10-K", "d", 1, "r1", "h1"), ("a", "2", day(2), day(1), "10-K", "d", 2, "r3", "h2"), ("a", "2", day(2), day(1), "10-K", "d", 2, "r2", "h2"), ("b", "1", day(1), day(1), "10-K", "d", 1, "r4", "h"), ("b", "2", day(1), day(1), "10-K", "d", 1, "r5", "i")]
    found = {r["cik"]: r for r in filings.latest_documents(spark.createDataFrame(rows, schema)).collect()}
    assert (found["a"]["source_response_id"], found["a"]["superseded"], found["a"]["faults"]) == ("r2", 3, [])
    assert found["b"]["faults"] == ["several_filings", "payload_differs"]


def test_conflicts_that_move_a_null_are_conflicts(spark):
    rows = spark.createDataFrame([("k", 1, None, "a", "i1"), ("k", 1, "a", None, "i2")], "key string, v int, x string, y string, id string")
    assert versions.current_versions(rows, ["key"], "v", ["x", "y"], "id").first()["conflicts"] == 1
    tags = spark.createDataFrame([("k", 1, ["a", "b"], "i1"), ("k", 1, ["b", "a"], "i2")], "key string, v int, x array<string>, id string")
    assert not versions.earliest_of_latest(tags, ["key"], "v", ["x"], ["id"], sets=["x"]).first()["conflict"]
    assert versions.collapse_repeats(tags, ["key"], ["x"], ["id"]).first()["conflict"]


def test_latest_responses_and_their_ties(spark):
    rows = [("a", "r1", 1, "h"), ("a", "r3", 2, "h"), ("a", "r2", 2, "h"), ("b", "r4", 1, "h"), ("b", "r5", 1, "i"), ("c", "r6", 1, "h"), ("c", "r6", 2, "h")]
    found = {r["cik"]: r for r in versions.latest_responses(spark.createDataFrame(rows, "cik string, source_response_id string, fetched_at int, response_sha256 string"), "cik", spark.createDataFrame([("a",)], "cik string")).collect()}
    assert (found["a"]["source_response_id"], found["a"]["superseded"], found["a"]["tie_repeats"], found["a"]["in_scope"]) == ("r2", 1, 1, True)
    assert found["b"]["tie_conflict"] and not found["a"]["tie_conflict"] and found["c"]["repeated_id"] and not found["c"]["in_scope"]


def _bars(rows, feed="sip"):
    payload = {"bars": {"A": rows}, "next_page_token": None}
    request = {"symbols": "A", "feed": feed, "adjustment": "split", "timeframe": "1Day", "currency": "USD"}
    return json.dumps(payload), json.dumps(request)


def test_a_price_snapshot_counts_every_bar(spark):
    bar = lambda day, c, v=1: {"t": f"2026-01-{day:02d}T05:00:00Z", "o": c, "h": c, "l": c, "c": c, "v": v}
    pages = [("r1", 1, *_bars([bar(2, 10), bar(3, 11), bar(4, 12, 0)])), ("r2", 2, *_bars([bar(2, 10), bar(3, 99)])), ("r3", 3, *_bars([bar(5, 1)], "iex"))]
    rows = [(r, "alpaca", q, p, dt.datetime(2026, 2, d), "run") for r, d, p, q in pages]
    frame = spark.createDataFrame(rows, "source_response_id string, source_system string, request_parameters_json string, response_payload_json string, fetched_at timestamp, ingestion_run_id string")
    current, counters = snapshots.price_snapshot(frame, ["A"])
    assert counters.first().asDict() == {"responses": 3, "accepted": 4, "rejected": 1, "out_of_scope": 1, "current": 2, "duplicates": 1, "superseded": 1, "conflicts": 0}
    assert {r["trading_date"].day: r["close"] for r in current.collect()} == {2: 10, 3: 99}
    assert frame.select(snapshots.request_issues(F.lit('{"feed": "sip", "symbols": "A,A"}')).alias("i")).first()["i"] == ["request_adjustment", "request_timeframe", "request_currency", "request_symbols"]


def test_a_revision_without_symbols_takes_its_article_out(spark):
    article = lambda i, day, tags: {"id": i, "headline": "h", "source": "s", "url": "https://x.org/1", "created_at": "2026-01-01T00:00:00Z", "updated_at": f"2026-01-0{day}T00:00:00Z", "symbols": tags}
    pages = [("r1", [article(1, 1, ["A"]), article(2, 1, ["A", "B"])]), ("r2", [article(1, 2, ["C"]), article(2, 1, ["B", "A"])])]
    rows = [(r, "alpaca", json.dumps({"news": a}), dt.datetime(2026, 2, 1), "run") for r, a in pages]
    frame = spark.createDataFrame(rows, "source_response_id string, source_system string, response_payload_json string, fetched_at timestamp, ingestion_run_id string")
    kept, counters = snapshots.news_snapshot(frame, ["B", "A"])
    assert [(r["article_id"], r["source_response_id"]) for r in kept.collect()] == [(2, "r1")]
    assert {k: counters.first()[k] for k in ("current", "out_of_scope", "duplicates", "superseded", "conflicts")} == {"current": 1, "out_of_scope": 1, "duplicates": 1, "superseded": 1, "conflicts": 0}


def test_concepts_are_available_or_not(spark):
    payload = json.dumps({"facts": {"us-gaap": {"A": {"units": {"USD": [1]}}, "B": {"units": {"USD": 3}}}}})
    frame = spark.createDataFrame([("r", payload)], "source_response_id string, response_payload_json string")
    assert {r["concept"]: r["state"] for r in snapshots.concept_availability(frame, ["A", "B", "C"]).collect()} == {"A": "available", "B": "wrong_type", "C": "unavailable"}


def test_submissions_pages_keep_their_promise(spark):
    page = lambda **other: json.dumps({"cik": "320193", "filings": {"recent": {"accessionNumber": ["0000320193-25-000001"], "form": [" 10-K"], "filingDate": ["2025-10-31"], "reportDate": ["2025-09-27"], "primaryDocument": ["a.htm"]} | other}})
    rows = [("0000320193", page()), ("0000000001", page()), ("0000320193", page(form=["10-K", "10-Q"])), ("0000320193", page(form="10-K")), ("0000320193", page(form=[" "]))]
    frame = spark.createDataFrame(rows, "cik string, payload string")
    assert sorted(r["faults"] for r in envelopes.submissions_faults(frame).collect()) == [["blank_form"], ["not_arrays"], ["other_cik"], ["unequal_lengths"]]
    sound = envelopes.recent_filings(frame.limit(1)).first()
    assert sound["filing_form"] == "10-K" and sound["issues"] == []
    odd = envelopes.recent_filings(spark.createDataFrame([("0000320193", page(primaryDocument=["../a"], filingDate=["soon"]))], "cik string, payload string")).first()
    assert odd["issues"] == ["date", "document"]


def test_pages_and_universe_rules(spark):
    page = lambda p, n: ("r", json.dumps(p), n)
    pages = [page({"bars": {"A": [1]}, "next_page_token": None}, 1), page({"bars": {"A": [1], "A ": []}}, 1), page({"bars": {"A": [1]}, "next_page_token": " "}, 2), page({"bars": 3}, 0)]
    found = envelopes.page_faults(spark.createDataFrame(pages, "source_response_id string, response_payload_json string, records_received long"), "bars")
    assert sorted(r["faults"] for r in found.collect()) == [["page_token", "records_received"], ["shape"], ["symbols"]]
    rows = [("A", "Alpha", "A", "0000000001"), ("B", " ", "B", "2"), ("C", "See", "D", "0000000003"), ("D", "Dee", "D", "0000000004")]
    faults = {r["symbol"]: r["faults"] for r in envelopes.universe_faults(spark.createDataFrame(rows, "symbol string, display_name string, alpaca_symbol string, sec_cik string")).collect()}
    assert faults == {"B": ["display_name", "sec_cik"], "C": ["repeated"], "D": ["repeated"]}


def test_statements_are_whole_or_refused(spark):
    sound = {"status": {"state": "SUCCEEDED"}, "manifest": {"format": "JSON_ARRAY", "schema": {"columns": [{"name": "a"}, {"name": "b"}]}}, "result": {"data_array": [["1", None]]}}
    broken = [sound | {"status": {"state": "FAILED"}}, sound | {"result": {"data_array": [["1"]]}}, sound | {"result": {"data_array": [], "next_chunk_index": 1}}, sound | {"manifest": sound["manifest"] | {"truncated": True}}, sound | {"manifest": {"format": "JSON_ARRAY", "schema": {"columns": [{"name": "b"}, {"name": "a"}]}}}]
    frame = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate([sound, *broken])], "i int, answer string")
    faults = {r["i"]: r["f"] for r in frame.select("i", boundary.statement_faults(F.col("answer"), ["a", "b"]).alias("f")).collect()}
    assert faults == {0: [], 1: ["not_succeeded"], 2: ["row_width"], 3: ["several_chunks"], 4: ["truncated"], 5: ["columns"]}
    assert [tuple(r) for r in boundary.statement_rows(frame, {"a": "int", "b": "string"}).collect()] == [(0, 1, None)]


def test_history_must_agree_with_its_metrics(spark):
    days = [dt.date(2026, 1, d) for d in (1, 2, 3)]
    points = [(s, d, Decimal(5), "USD") for s in "AB" for d in days] + [("C", days[0], Decimal(-1), "EUR"), ("C", days[0], Decimal(1), "USD"), ("Z", days[0], Decimal(1), "USD")]
    frame = spark.createDataFrame(points, "symbol string, trading_date date, close decimal(20,8), currency string")
    metrics = lambda ready: spark.createDataFrame([(s, days[2], ready) for s in "ABC"], "symbol string, as_of_date date, ready boolean")
    found = {r["symbol"]: r["faults"] for r in boundary.series_faults(frame, metrics(True), 2).collect()}
    assert found == {"A": [], "B": [], "C": ["points", "repeated_dates", "currency", "close", "last_date", "not_aligned"]}
    assert {tuple(r["faults"]) for r in boundary.series_faults(frame, metrics(False), 2).collect()} == {("unavailable",)}
    assert [r["symbol"] for r in boundary.out_of_scope(frame, metrics(True)).collect()] == ["Z"]


def test_citations_keep_their_order(spark):
    cited = spark.createDataFrame([(1, "e3"), (2, "e1"), (3, "e3"), (4, "e9")], "position int, evidence_id string")
    assert [tuple(r) for r in boundary.cited_captured(cited, spark.createDataFrame([("e1",), ("e3",)], "evidence_id string")).collect()] == [(1, "e3"), (2, "e1")]


def test_merged_findings_and_their_evidence(spark):
    rows = spark.createDataFrame([("q", "A", "principal_risks", ["A"], "f1"), ("q", "B", "principal_risks", ["B"], "f1"), ("q", "B", "news", ["B"], "f2")], "request_id string, symbol string, topic string, symbols array<string>, finding_id string")
    merged, faults = reports.merge_results(rows, "principal_risks")
    assert {r["finding_id"] for r in merged.collect()} == {"A:f1", "B:f1", "B:f2"} and [tuple(r) for r in faults.collect()] == [("q", "B:f2", "topic_or_scope")]
    findings = spark.createDataFrame([("f1", "principal_risks", ["A"], ["e1"]), ("f2", "recent_developments", ["A"], ["e1", "e9"]), ("f3", "gossip", ["B"], [])], "finding_id string, topic string, symbols array<string>, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "filing", ["A"])], "evidence_id string, source_type string, symbols array<string>")
    assert sorted(tuple(r) for r in reports.research_faults(findings, evidence).collect()) == [("f2", "evidence_type"), ("f2", "unknown_evidence"), ("f3", "no_evidence"), ("f3", "topic")]


def test_sources_of_an_answer(spark):
    findings = spark.createDataFrame([("f1", "said", ["e1", "e1"])], "finding_id string, statement string, evidence_ids array<string>")
    metrics = spark.createDataFrame([("A", "market", 1, "60-session return", "2%", dt.date(2026, 1, 2)), ("A", "market", 2, "60-session return", "3%", None)], "symbol string, dataset string, position int, label string, value string, as_of date")
    sections = spark.createDataFrame([("principal_risks", "text", None)], "section string, text string, evidence_ids array<string>")
    notes = spark.createDataFrame([(1, "none")], "position int, text string")
    found = {r["source_id"]: (r["text"], r["evidence_ids"]) for r in reports.answer_sources(findings, metrics, sections, notes).collect()}
    assert found == {"f1": ("said", ["e1"]), "structured:A:market:60-session-return": ("A 60-session return: 2% (as of 2026-01-02)", []), "report:principal_risks": ("text", []), "limitation:1": ("none", [])}


def test_scores_of_rejections(spark):
    row = ("c", "rejected", "unsupported", ["X"], ["X"], ["A"], {"a": 0, "b": 0, "c": 0}, "unsupported", ["X"], ["X"], ["A"])
    names = "case_id string, outcome string, reason_code string, requested_symbols array<string>, unsupported_symbols array<string>, supported_symbols array<string>, downstream_calls map<string,int>, expected_reason string, expected_symbols array<string>, expected_unsupported array<string>, expected_supported array<string>"
    worse = ("d", *row[1:5], ["B"], {"a": 1, "b": 0, "c": 0}, *row[7:])
    assert [tuple(r)[1:] for r in reports.rejection_scores(spark.createDataFrame([row, worse], names)).orderBy("case_id").collect()] == [(True, True, True), (True, False, False)]


def test_the_better_return_and_the_selector(spark):
    rows = spark.createDataFrame([("q", "A", 0.1), ("q", "B", 0.2), ("r", "A", 0.1), ("r", "B", 0.1)], "request_id string, symbol string, return_20d double")
    assert {r["request_id"]: (r["symbol"], r["tied"]) for r in reports.better_return(rows, 20).collect()} == {"q": ("B", False), "r": ("B", True)}
    with pytest.raises(ValueError):
        reports.better_return(rows, 7)
    universe = spark.createDataFrame([("B", "apple"), ("A", "Zeta"), ("C", "Beta")], "symbol string, display_name string")
    assert [r["label"] for r in reports.selector_options(universe).orderBy("position").collect()] == ["apple (B)", "Beta (C)", "Zeta (A)"]
    plan = reports.route_plan(spark.createDataFrame([("q", ["A", "B"])], "request_id string, symbols array<string>"))
    assert [(r["route_id"], r["mode"]) for r in plan.orderBy("position").collect()] == [(r, "comparison") for r in reports.ROUTES]


def test_scoped_chunks_candidates_and_noise(spark):
    chunks = spark.createDataFrame([("c1", ["A"], "news", None), ("c2", ["A", "B"], "filing", "item_1"), ("c3", ["C"], "filing", "item_1")], "chunk_id string, configured_symbols array<string>, source_type string, section_code string")
    assert {r["chunk_id"] for r in retrieval.in_scope(chunks, ["A"]).collect()} == {"c1", "c2"} and [r["chunk_id"] for r in retrieval.in_scope(chunks, ["B", "C"], "filing", "item_1").filter("chunk_id != 'c3'").collect()] == ["c2"]
    with pytest.raises(ValueError):
        retrieval.in_scope(chunks, ["A"], "news", "item_1")
    assert (retrieval.candidates_for(5, True, "recent_developments"), retrieval.candidates_for(6, True, "recent_developments"), retrieval.candidates_for(5, False, "recent_developments")) == (10, 10, 5)
    ranked = spark.createDataFrame([("q", 1, "t", "A golden cross"), ("q", 2, "t", "sales grew"), ("q", 3, "Insider sold", "shares"), ("q", 4, "t", "profit")], "query_id string, rank int, title string, chunk_text string")
    assert [(r["rank"], r["chunk_text"]) for r in retrieval.without_noise(ranked, 5).orderBy("rank").collect()] == [(1, "sales grew"), (2, "profit")]


def test_cases_come_from_one_document(spark, tmp_path):
    case = {"case_id": "a", "query": "q", "expected_symbol": "A", "expected_source_type": "news", "expected_section_code": None, "relevant_chunk_ids": ["c1"]}
    (tmp_path / "cases.json").write_text(json.dumps({"label_status": "frozen", "cases": [case, case | {"case_id": "b"}]}))
    cases = retrieval.read_cases(spark, f"file://{tmp_path}/cases.json")
    ranking = spark.createDataFrame([("a", 1, "c9"), ("a", 2, "c1")], "case_id string, rank int, chunk_id string")
    assert sorted((r["case_id"], r["rank"], r["relevant"]) for r in retrieval.judged_ranking(cases, ranking).filter("rank is not null").collect()) == [("a", 1, False), ("a", 2, True)]
    assert retrieval.judged_ranking(cases, ranking).filter("rank is null").count() == 1


def test_whole_rows_or_an_error(spark):
    spark.range(3).selectExpr("concat('S', id) as symbol").createOrReplaceTempView("served")
    assert len(serving.whole_rows(serving.rows_for(spark, "served", ["S0", "S1"], 2), 2)) == 2
    with pytest.raises(ValueError):
        serving.whole_rows(serving.rows_for(spark, "served", ["S0", "S1"], 1), 1)
    with pytest.raises(ValueError):
        serving.rows_for(spark, "served; drop", ["S0"])
    ages = spark.createDataFrame([("10-K", 400), ("10-Q", 181), ("10-Q", -1), ("10-K", 451)], "form string, days int").select(serving.filing_age_issue(F.col("form"), F.date_sub(F.lit("2026-01-01").cast("date"), F.col("days")), F.lit("2026-01-01").cast("date")).alias("i"))
    assert [r["i"] for r in ages.collect()] == [None, "stale", "ahead", "stale"]


def test_small_checks_of_arrays_and_texts(spark):
    rows = spark.createDataFrame([(1, ["A", "B"], "x" * 600), (2, ["B", "A"], "x"), (3, [], None), (4, ["Z"], "y" * 500)], "i int, s array<string>, t string")
    assert sorted(r["i"] for r in quality.outside_universe(rows, "s", ["A", "B"]).collect()) == [3, 4]
    assert [r["i"] for r in quality.unsorted_sets(rows, "s").collect()] == [2] and sorted(r["i"] for r in quality.short_texts(rows, "t").collect()) == [2, 3]
    said = spark.createDataFrame([(" aapl\t", "https://x.org:8/a", Decimal("-1234567.885"))], "s string, u string, v decimal(20,3)").select(T.symbol(F.col("s")), T.authority(F.col("u")), T.grouped_money(F.col("v")), T.short_money(F.col("v"))).first()
    assert tuple(said) == ("AAPL", "x.org:8", "-1,234,567.88", "USD -1.23M")


def test_sessions_come_back_as_they_were_sealed():
    key = b"0123456789abcdef"
    sealed = sessions.seal({"b": 1, "a": "ü"}, key)
    assert sessions.opened(json.loads(json.dumps(sealed)), key) == {"a": "ü", "b": 1}
    for broken in (sealed | {"payload": {"a": "u", "b": 1}}, sealed | {"signature": "0" * 64}, {}):
        with pytest.raises(ValueError):
            sessions.opened(broken, key)


def test_pages_are_followed_to_their_end(spark, tmp_path):
    pages = {"r1/first": {"bars": {"A": [1, 2]}, "next_page_token": "p2"}, "r1/p2": {"bars": {"A": [3]}, "next_page_token": None}, "r2/first": {"bars": {}}}
    for name, page in pages.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(json.dumps(page))
    replay.register(spark)
    read = lambda: spark.read.format("paged_replay").option("path", str(tmp_path)).load()
    assert sorted((r["request"], r["page_number"], r["response_page_token"], r["records_received"]) for r in read().collect()) == [("r1", 1, None, 2), ("r1", 2, "p2", 1), ("r2", 1, None, 0)]
    (tmp_path / "r1/p2.json").write_text(json.dumps({"bars": {}, "next_page_token": "p2"}))
    with pytest.raises(Exception, match="names no new page"):
        read().collect()


def test_documents_of_both_sources_are_one_table(spark):
    news = spark.createDataFrame([(7, "H", "<p>a <b>b</b></p><script>x</script>", "s", dt.datetime(2026, 1, 2)), (8, "I", " ", "sum", dt.datetime(2026, 1, 2)), (9, "J", None, "", dt.datetime(2026, 1, 2))], "article_id long, headline string, content string, summary string, created_at timestamp")
    section = spark.createDataFrame([("A", "0000000001-25-000001", "10-K", dt.date(2025, 1, 2), "item_1", "Business", "text")], "project_symbol string, accession_number string, filing_form string, filing_date date, section_code string, section_title string, section_text string")
    found = corpus.all_documents(corpus.news_documents(news), filings.filing_documents(section))
    rows = {r["document_id"]: (r["title"], r["document_text"], r["evidence_date"], r["section_code"]) for r in found.collect()}
    assert rows == {"alpaca:news:7": ("H", "a b", dt.date(2026, 1, 2), None), "alpaca:news:8": ("I", "sum", dt.date(2026, 1, 2), None), "sec:filing:0000000001-25-000001:item_1": ("10-K - Business", "text", dt.date(2025, 1, 2), "item_1")}


def test_companies_need_two_sections_of_one_response(spark):
    rows = spark.createDataFrame([("a", "r1"), ("a", "r1"), ("b", "r2"), ("c", "r3"), ("c", "r4")], "cik string, source_response_id string")
    assert sorted((r["cik"], r["sections"], r["responses"]) for r in filings.section_coverage(rows).collect()) == [("b", 1, 1), ("c", 2, 2)]


def test_tables_snapshots_and_what_is_new_in_them(spark, tmp_path):
    from ledgerlight.sinks import snapshots as sink

    spark.sql(f"CREATE DATABASE IF NOT EXISTS made LOCATION 'file://{tmp_path}/db'")
    for _ in range(2):
        sink.create_if_absent(spark, "made.rows_of_a_run", "id BIGINT NOT NULL, ingestion_run_id STRING")
    assert spark.table("made.rows_of_a_run").columns == ["id", "ingestion_run_id"]
    with pytest.raises(ValueError):
        sink.create_if_absent(spark, "made.x; DROP", "id INT")
    root = f"file://{tmp_path}/root"
    docs, chunks = (lambda ids: spark.createDataFrame([(i,) for i in ids], "document_id int")), (lambda ids: spark.createDataFrame([(f"c{i}", i) for i in ids], "chunk_id string, document_id int"))
    sink.publish(spark, root, "s1", {"docs": docs([1, 2]), "chunks": chunks([1, 2])})
    sink.publish(spark, root, "s2", {"docs": docs([2, 3]), "chunks": chunks([2, 3, 9])})
    assert sorted(r["chunk_id"] for r in sink.changed_ids(spark, root, "chunks", 1, 2, "chunk_id").collect()) == ["c3", "c9"]
    assert [r["document_id"] for r in sink.orphans_after(spark, root, "chunks", "docs", ["document_id"]).collect()] == [9]


def test_facts_belong_to_their_configured_company(spark):
    facts = spark.createDataFrame([("1", "A"), ("2", "X"), ("3", "C")], "cik string, project_symbol string")
    known = spark.createDataFrame([("A", "1"), ("B", "2")], "project_symbol string, cik string")
    assert {r["cik"]: r["fault"] for r in snapshots.facts_in_config(facts, known).collect()} == {"1": None, "2": "other_symbol", "3": "unknown_cik"}


def test_rates_and_amounts_are_rounded_once(spark, tmp_path):
    rows = [(Decimal("0.2375499950000000"), "23.75%"), (Decimal("0.2375500000000000"), "23.76%"), (Decimal("-0.0001499999999999"), "-0.01%")]
    frame = spark.createDataFrame(rows, "v decimal(38,16), said string")
    assert all(r[0] == r[1] for r in frame.select(reports.rate_words(F.col("v")), "said").collect())
    spark.createDataFrame([(1259, 475099.99)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert snapshot_queries.amounts(spark, str(tmp_path)).first()["rate"] == "23.75%"


def test_amounts_below_a_thousand_are_borne_by_their_value(spark):
    day = dt.date(2026, 9, 4)
    market = spark.createDataFrame([], "symbol string, as_of_date date, status string, return_60d decimal(20,10), annualized_volatility_60d decimal(20,10)")
    earned = spark.createDataFrame([("A", day, "ready", Decimal(0), Decimal(0)), ("B", day, "ready", Decimal("999.99"), Decimal("0.5")), ("C", day, "ready", Decimal(10_000), Decimal("0.5"))], "symbol string, as_of_date date, status string, revenue_ttm decimal(28,2), net_margin_ttm decimal(20,10)")
    ready = earned.select(F.lit("fundamental").alias("dimension"), "symbol", "as_of_date", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f).cast("decimal(28,10)").alias("value")) for f, k in (("revenue_ttm", "scaled"), ("net_margin_ttm", "percent"))])))
    found = reports.market_findings(market, earned)
    assert reports.finding_faults(found, ready).isEmpty()
    other = found.withColumn("statement", F.replace("statement", F.lit("999.99"), F.lit("998.99")))
    assert [tuple(r) for r in reports.finding_faults(other, ready).collect()] == [("F-B", "numeric_claim")]


def test_comparisons_meet_in_one_grouping(spark):
    from ledgerlight.operators import reports

    findings = spark.createDataFrame([(1, 1, "m", "A"), (1, 2, "m", "B"), (1, 3, "f", "A"), (1, None, "m", "A")], "request_id int, finding_id int, dimension string, symbol string")
    requests = spark.createDataFrame([(1, ["A", "B", "B"])], "request_id int, symbols array<string>")
    sections = spark.createDataFrame([(1, "comparative_assessment", "available", [1, 3, None])], "request_id int, section string, status string, source_finding_ids array<int>")
    found = reports.comparison_faults(sections, findings, requests)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 2, "left_out"), (1, 3, "not_eligible"), (1, None, "left_out"), (1, None, "not_eligible")], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6
