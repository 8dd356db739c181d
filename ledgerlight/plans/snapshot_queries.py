"""Queries of the operators between raw answers and what is shown, each with its DuckDB SQL.

No raw responses are supplied, so the driver's tables are first written out as the JSON or
HTML that a service would send; orders stand in for bars, documents for articles, pages for
filings. What the operators read back is compared with SQL over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.operators import boundary, claims, embedding, filings, quality, reports, retrieval, snapshots, versions
from ledgerlight.plans.reference_queries import BARS, FACTS, bars, facts, table
from ledgerlight.sinks import search_index, work_folder
from ledgerlight.sinks import snapshots as snapshots_sink
from ledgerlight.sources import envelopes


def _json(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- filings -------------------------------------------------------------------------------


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing documents made of pages; every seventh has no business section to speak of, every fifth a context of another company."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("word"))
    cik = F.lpad(F.col("page_id").cast("string"), 10, "0")
    rows = rows.withColumns({"cik": cik, "accession_number": F.concat_ws("-", cik, F.lit("25"), F.lpad((F.col("page_id") % 1_000_000).cast("string"), 6, "0")), "primary_document": F.concat(F.lit("d"), F.col("page_id").cast("string"), F.lit(".htm"))})
    fact = lambda name, value: _json(f'<ix:nonNumeric name="dei:{name}" contextRef="c1">', value, "</ix:nonNumeric>")
    other = F.when(F.col("page_id") % 5 == 0, F.lit("0000000001")).otherwise(F.col("cik"))
    context = _json('<xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="http://www.sec.gov/CIK">', other, "</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:endDate>2025-09-27</xbrli:endDate></xbrli:period></xbrli:context>")
    html = F.concat(
        F.lit("<html><head><script>Item 1. Business</script></head><body><ix:header>"), context, F.lit("</ix:header><div>"),
        fact("EntityCentralIndexKey", F.col("cik")), fact("DocumentType", F.lit("10-K")), fact("DocumentPeriodEndDate", F.lit("<b>September 27</b>, 2025")),
        F.lit("</div><table><tr><td>Item 1. Business</td><td>1</td></tr><tr><td>Item 1A. Risk Factors</td></tr></table><h2>Item 1. B usiness</h2><p>"),
        F.expr("repeat(concat('We sell ', word, '. '), if(page_id % 7 = 0, 3, 8))"), F.lit("</p><h2>Item 1A. Ris k Factors</h2><p>"),
        F.repeat(F.concat(F.lit("We risk "), "word", F.lit(". ")), F.lit(9)), F.lit("</p><p>Acme Inc. | 2025 Form 10-K | 17</p><h2>Item 1C. Cybersecurity</h2><p>None.</p></body></html>"),
    )
    rows = rows.withColumn("response_payload_html", html)
    return rows.withColumns(
        {
            "project_symbol": F.concat(F.lit("P"), F.col("page_id").cast("string")),
            "filing_form": F.lit("10-K"),
            "filing_date": F.lit("2025-10-31").cast("date"),
            "report_date": F.lit("2025-09-27").cast("date"),
            "http_status": F.lit(200),
            "response_bytes": F.octet_length("response_payload_html").cast("long"),
            "response_sha256": T.sha256(F.col("response_payload_html")),
            "source_url": filings.archive_url(F.col("cik"), F.col("accession_number"), F.col("primary_document")),
            "source_response_id": F.concat(F.lit("r"), F.col("page_id").cast("string")),
        }
    )


def filing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sections of every filing without issues, as research documents."""
    cut = filings.filing_sections(_filings(spark, sf_dir)).filter("sections is not null")
    rows = filings.filing_documents(cut.select("page_id", "project_symbol", "accession_number", "filing_form", "filing_date", F.inline("sections")))
    return rows.select("page_id", "document_id", "title", "section_code", F.length("section_text").alias("n_chars"), "section_text_sha256")


SECTIONS_SQL = """WITH p AS (SELECT page_id, sha256(url) AS w, lpad(page_id::VARCHAR, 10, '0') AS cik FROM pages WHERE page_id % 7 != 0 AND page_id % 5 != 0),
s AS (SELECT *, 'item_1' AS section_code, 'Business' AS t, rtrim(repeat('We sell ' || w || '. ', 8)) AS x FROM p UNION ALL SELECT *, 'item_1a', 'Risk Factors', rtrim(repeat('We risk ' || w || '. ', 9)) FROM p)
SELECT page_id, 'sec:filing:' || cik || '-25-' || lpad((page_id % 1000000)::VARCHAR, 6, '0') || ':' || section_code AS document_id, '10-K - ' || t AS title, section_code, length(x)::INT AS n_chars, sha256(x) AS section_text_sha256 FROM s"""


def filing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.filing_sections(_filings(spark, sf_dir)).filter(F.size("issues") > 0).select("page_id", F.array_join("issues", ",").alias("issues"))


FILING_ISSUES_SQL = "SELECT page_id, concat_ws(',', CASE WHEN page_id % 5 = 0 AND page_id != 1 THEN 'context' END, CASE WHEN page_id % 7 = 0 THEN 'no_body' END) AS issues FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0"


def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages as filings of fifty companies on three days each: the one that counts."""
    p = table(spark, sf_dir, "pages")
    rows = p.select(
        (F.col("page_id") % 50).alias("cik"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("page_id") % 3).cast("int")).alias("filing_date"), (F.col("page_id") % 3).cast("string").alias("accession_number"),
        F.lit("10-K").alias("filing_form"), F.lit("2024-12-31").cast("date").alias("report_date"), F.lit("a.htm").alias("primary_document"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("source_response_id"),
        F.floor(F.col("page_id") / 400).alias("fetched_at"), F.sha2("url", 256).alias("response_sha256"),
    )
    found = filings.latest_documents(rows)
    return found.select("cik", "filing_date", "source_response_id", "superseded", F.array_join("faults", ",").alias("faults"))


LATEST_SQL = """WITH r AS (SELECT page_id % 50 AS cik, DATE '2025-01-01' + (page_id % 3)::INT AS filing_date, page_id, page_id // 400 AS f, sha256(url) AS h FROM pages),
m AS (SELECT *, max(filing_date) OVER (PARTITION BY cik) AS d FROM r), n AS (SELECT *, max(f) FILTER (filing_date = d) OVER (PARTITION BY cik) AS l FROM m)
SELECT cik, max(d) AS filing_date, lpad((min(page_id) FILTER (filing_date = d AND f = l))::VARCHAR, 9, '0') AS source_response_id, count(*) - 1 AS superseded,
  CASE WHEN count(DISTINCT h) FILTER (filing_date = d AND f = l) > 1 THEN 'payload_differs' ELSE '' END AS faults FROM n GROUP BY cik"""


def latest_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 10-K of every supplier's submissions page, and whether several share its date."""
    s = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), "s_suppkey")
    many = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(i.alias("i"), F.when(i == 6, "10-Q").otherwise("10-K").alias("form"), F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("s_suppkey") * i) % 4).cast("int")).alias("d")))
    listed = lambda f: _json("[", F.array_join(F.transform(many, lambda x: F.concat(F.lit('"'), f(x), F.lit('"'))), ","), "]")
    number = lambda x: F.concat(F.col("cik"), F.lit("-20-00000"), x["i"].cast("string"))
    payload = _json('{"cik":"', F.col("cik"), '","filings":{"recent":{"accessionNumber":', listed(number), ',"form":', listed(lambda x: x["form"]), ',"filingDate":', listed(lambda x: x["d"].cast("string")), ',"reportDate":', listed(lambda x: F.lit("2019-12-31")), ',"primaryDocument":', listed(lambda x: F.lit("a.htm")), "}}}")
    pages = s.select("cik", payload.alias("payload"))
    sound = pages.join(envelopes.submissions_faults(pages), "cik", "left_anti")
    found = envelopes.latest_filings(envelopes.recent_filings(sound))
    return found.select("cik", "accession_number", "filing_date", F.size("issues").alias("issues"), "ambiguous")


LATEST_FILINGS_SQL = """WITH f AS (SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS cik, i, DATE '2020-01-01' + ((s_suppkey * i) % 4)::INT AS d FROM supplier, range(1, 6) t(i)), m AS (SELECT *, max(d) OVER (PARTITION BY cik) AS l FROM f)
SELECT cik, cik || '-20-00000' || min(i) AS accession_number, max(d) AS filing_date, 0 AS issues, count(*) > 1 AS ambiguous FROM m WHERE d = l GROUP BY cik"""


# --- snapshots -----------------------------------------------------------------------------

CONFIGURED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def _price_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per symbol and month, asked for twice; December was asked of another feed, no volume traded on a 13th."""
    b = bars(spark, sf_dir)
    volume = F.when(F.dayofmonth("trading_date") == 13, "0").otherwise("100")
    price = F.col("close").cast("string")
    bar = _json('{"t":"', F.col("trading_date"), 'T05:00:00Z","o":', price, ',"h":', price, ',"l":', price, ',"c":', price, ',"v":', volume, "}")
    month = F.date_format("trading_date", "yyyy-MM")
    feed = F.when(F.col("month").endswith("-12"), "iex").otherwise("sip")
    each = b.withColumn("month", month).groupBy("symbol", "month").agg(F.collect_list(bar).alias("bars"))
    payload = _json('{"bars":{"', F.col("symbol"), '":[', F.array_join("bars", ","), ']},"next_page_token":null}')
    request = _json('{"symbols":"', F.col("symbol"), '","feed":"', feed, '","adjustment":"split","timeframe":"1Day","currency":"USD"}')
    twice = F.explode(F.sequence(F.lit(1), F.lit(2)))
    rows = each.select(F.size("bars").cast("long").alias("records_received"), payload.alias("response_payload_json"), request.alias("request_parameters_json"), F.concat_ws("/", "symbol", "month").alias("at"), twice.alias("turn"))
    return rows.select(F.concat_ws("/", "at", "turn").alias("source_response_id"), F.lit("alpaca").alias("source_system"), "request_parameters_json", "response_payload_json", "records_received", F.make_timestamp(F.lit(2030), F.lit(1), F.col("turn"), F.lit(0), F.lit(0), F.lit(0)).alias("fetched_at"), F.lit("run").alias("ingestion_run_id"))


def price_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the snapshot of prices."""
    return snapshots.price_snapshot(_price_responses(spark, sf_dir), CONFIGURED)[1]


PRICE_SQL = f"""WITH {BARS}, b AS (SELECT *, symbol != '5-LOW' AND month(trading_date) != 12 AS scoped, day(trading_date) = 13 AS bad FROM bars)
SELECT 2 * count(DISTINCT (symbol, strftime(trading_date, '%Y-%m'))) AS responses, 2 * count(*) FILTER (scoped AND NOT bad) AS accepted, 2 * count(*) FILTER (scoped AND bad) AS rejected, 2 * count(*) FILTER (NOT scoped) AS out_of_scope,
  count(*) FILTER (scoped AND NOT bad) AS current, count(*) FILTER (scoped AND NOT bad) AS duplicates, 0::BIGINT AS superseded, 0::BIGINT AS conflicts FROM b"""


def page_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price pages whose count of records is not the envelope's, once one is taken off every March."""
    rows = _price_responses(spark, sf_dir)
    march = F.col("source_response_id").contains("-03/")
    rows = rows.withColumn("records_received", F.col("records_received") - march.cast("long"))
    return envelopes.page_faults(rows, "bars").select("source_response_id", F.array_join("faults", ",").alias("faults"))


PAGE_SQL = f"WITH {BARS}, m AS (SELECT DISTINCT symbol || '/' || strftime(trading_date, '%Y-%m') AS a FROM bars WHERE month(trading_date) = 3) SELECT a || '/' || turn AS source_response_id, 'records_received' AS faults FROM m, range(1, 3) t(turn)"


def news_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles made of documents, twice retrieved; a revision of every third names no symbol, and every eleventh has a URL with credentials."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    host = F.when(F.col("doc_id") % 11 == 0, "user:pw@x.org").otherwise("x.org")

    def page(turn: int) -> DataFrame:
        revised = (F.col("doc_id") % 3 == 0) & F.lit(turn == 2)
        tags = F.when(revised, "[]").otherwise(F.concat(F.lit('["'), "source", F.lit('"]')))
        article = _json('{"id":', F.col("doc_id") + 1, ',"headline":"h', F.col("doc_id"), '","source":"s","url":"https://', host, "/", F.col("doc_id"), '","summary":"","content":"c","created_at":"2026-01-01T00:00:00Z","updated_at":"2026-01-0', F.when(revised, "2").otherwise("1"), 'T00:00:00Z","symbols":', tags, "}")
        groups = d.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(16))).groupBy("g").agg(F.array_join(F.collect_list(article), ",").alias("a"))
        return groups.select(F.concat(F.lit(f"{turn}/"), F.col("g").cast("string")).alias("source_response_id"), F.lit("alpaca").alias("source_system"), _json('{"news":[', F.col("a"), '],"next_page_token":null}').alias("response_payload_json"), F.lit(f"2026-02-0{turn} 00:00:00").cast("timestamp").alias("fetched_at"), F.lit("run").alias("ingestion_run_id"))

    configured = [f"src{i}" for i in range(10)]
    counters = snapshots.news_snapshot(page(1).unionByName(page(2)), configured)[1]
    return counters.select("accepted", "rejected", "current", "out_of_scope", "duplicates", "superseded", "conflicts")


NEWS_SQL = """WITH d AS (SELECT doc_id % 11 = 0 AS bad, doc_id % 3 = 0 AS revised, source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') AS scoped FROM documents)
SELECT 2 * count(*) FILTER (NOT bad) AS accepted, 2 * count(*) FILTER (bad) AS rejected, count(*) FILTER (NOT bad AND NOT revised AND scoped) AS current, count(*) FILTER (NOT bad AND (revised OR NOT scoped)) AS out_of_scope,
  count(*) FILTER (NOT bad AND NOT revised) AS duplicates, count(*) FILTER (NOT bad AND revised) AS superseded, 0::BIGINT AS conflicts FROM d"""


def facts_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company facts of every nation, retrieved twice, each fact stated twice; nation 24 is not configured."""
    f = facts(spark, sf_dir)
    cik = F.lpad("entity", 10, "0")
    seen = _json('{"start":"', F.col("period_start"), '","end":"', F.col("period_end"), '","val":', F.col("fact_value"), ',"accn":"', cik, "-00-", F.lpad(F.dayofyear("filing_date").cast("string"), 6, "0"), '","fy":', F.year("period_end"), ',"form":"', F.col("filing_form"), '","filed":"', F.col("filing_date"), '"}')
    by = f.groupBy("entity", "concept").agg(F.array_join(F.concat(F.collect_list(seen), F.collect_list(seen)), ",").alias("o"))
    each = by.groupBy("entity").agg(*[F.max(F.when(F.col("concept") == c, F.col("o"))).alias(c) for c in ("revenue", "net_income")])
    payload = _json('{"cik":', F.col("entity").cast("int"), ',"facts":{"us-gaap":{"Revenues":{"units":{"USD":[', F.col("revenue"), ']}},"NetIncomeLoss":{"units":{"USD":[', F.col("net_income"), "]}}}}}")
    rows = each.select(payload.alias("response_payload_json"), F.col("entity").alias("e"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("turn"))
    rows = rows.select(F.concat_ws("/", "e", "turn").alias("source_response_id"), "response_payload_json", T.sha256(F.col("response_payload_json")).alias("response_sha256"), F.make_timestamp(F.lit(2030), F.lit(1), F.col("turn"), F.lit(0), F.lit(0), F.lit(0)).alias("fetched_at"))
    configured = table(spark, sf_dir, "nation").filter("n_nationkey < 24").select(F.lpad(F.col("n_nationkey").cast("string"), 10, "0").alias("cik"))
    return snapshots.facts_snapshot(rows, ["Revenues", "NetIncomeLoss", "Assets"], ["Assets"], configured)[1]


FACTS_SNAPSHOT_SQL = f"""WITH {FACTS}, f AS (SELECT entity, y, 'a' AS k FROM annual UNION ALL SELECT entity, y, 'q' FROM part), n AS (SELECT 2 * count(*) FILTER (entity != '24') AS facts, count(DISTINCT entity) AS entities, count(DISTINCT entity) FILTER (entity = '24') AS other FROM f)
SELECT entities::BIGINT AS superseded, 0::BIGINT AS tie_repeats, other AS out_of_scope, 0::BIGINT AS response_faults, 2 * facts AS accepted, 0::BIGINT AS rejected, facts AS current, facts AS duplicates, 0::BIGINT AS conflicts FROM n"""


def collapsed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by order and part: repeats that say the same collapse, others conflict."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_linenumber", "l_orderkey")
    found = versions.collapse_repeats(rows, ["l_suppkey", "l_shipdate"], ["l_returnflag"], ["l_orderkey", "l_linenumber"])
    return found.select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", "repeats", "conflict")


COLLAPSED_SQL = "SELECT l_suppkey, l_shipdate::DATE AS day, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey, count(*) - 1 AS repeats, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY l_suppkey, l_shipdate"


def configured_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers against the nations of the first two regions: what is unexpected, what is missing."""
    seen = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    wanted = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("nation"))
    return snapshots.in_both(seen, wanted, "nation").filter("problem is not null")


SIDES_SQL = """WITH a AS (SELECT DISTINCT c_nationkey AS nation FROM customer), b AS (SELECT n_nationkey AS nation FROM nation WHERE n_regionkey < 2)
SELECT nation, 'unexpected' AS problem FROM a WHERE nation NOT IN (SELECT nation FROM b) UNION ALL SELECT nation, 'missing' FROM b WHERE nation NOT IN (SELECT nation FROM a)"""


# --- answers of services -------------------------------------------------------------------


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a statement's answers, one a brand; those of a size group cut short are not read."""
    p = table(spark, sf_dir, "part")
    row = _json('["', F.col("p_partkey"), '","', F.col("p_size"), '","', F.col("p_retailprice").cast("decimal(12,2)"), '"]')
    each = p.groupBy("p_brand").agg(F.array_join(F.collect_list(row), ",").alias("rows"))
    cut = F.when(F.col("p_brand").endswith("5"), "true").otherwise("false")
    answer = _json('{"status":{"state":"SUCCEEDED"},"manifest":{"format":"JSON_ARRAY","schema":{"columns":[{"name":"key"},{"name":"size"},{"name":"price"}]},"total_chunk_count":1,"truncated":', cut, '},"result":{"data_array":[', F.col("rows"), "]}}")
    found = boundary.statement_rows(each.select(F.col("p_brand").alias("brand"), answer.alias("answer")), {"key": "bigint", "size": "int", "price": "decimal(12,2)"})
    return found.select("brand", "key", "size", F.col("price").cast("double").alias("price"))


STATEMENT_SQL = "SELECT p_brand AS brand, p_partkey AS key, p_size AS size, p_retailprice::DECIMAL(12,2)::DOUBLE AS price FROM part WHERE p_brand NOT LIKE '%5'"


def evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a search's answer, asked for news of src1: which are no evidence, and why."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    kind = F.when(F.col("doc_id") % 4 == 0, "filing").otherwise("news")
    filing = F.col("doc_id") % 4 == 0
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    cells = {
        "chunk_id": quoted(F.sha2(F.col("doc_id").cast("string"), 256)),
        "document_id": quoted(F.when(filing, F.concat(F.lit("sec:filing:a-"), F.col("doc_id").cast("string"), F.lit(":item_1"))).otherwise(F.concat(F.lit("alpaca:news:"), F.col("doc_id").cast("string")))),
        "document_version_id": quoted(F.lit("v")),
        "source_type": quoted(kind),
        "source_system": quoted(F.when(F.col("doc_id") % 10 == 3, "sec").when(filing, "sec").otherwise("alpaca")),
        "configured_symbols": F.concat(F.lit('["'), "source", F.lit('"]')),
        "title": quoted(F.lit("t")),
        "evidence_date": quoted(F.lit("2026-01-02")),
        "source_url": quoted(F.when(F.col("doc_id") % 7 == 0, "ftp://x.org").otherwise("https://x.org/a")),
        "section_code": F.when(filing, '"item_1"').otherwise("null"),
        "section_title": F.when(filing, '"Business"').otherwise("null"),
        "chunk_index": F.lit("0"),
        "chunk_text": quoted(F.lit("text")),
        "source_response_id": quoted(F.lit("r")),
        "source_fetched_at": quoted(F.lit("2026-01-02T00:00:00Z")),
        "source_ingestion_run_id": quoted(F.lit("run")),
    }
    columns = ",".join(f'{{"name":"{c}"}}' for c in cells)
    row = F.concat(F.lit("["), F.concat_ws(",", *cells.values()), F.lit("]"))
    answer = _json('{"manifest":{"columns":[' + columns + ']},"result":{"data_array":[', row, "]}}")
    rows = boundary.evidence_rows(d.select("doc_id", answer.alias("answer")))
    issues = boundary.evidence_issues(["src1"], [f"src{i}" for i in range(20)], "news")
    name = boundary.business_id(F.col("document_id"), F.col("source_type"), F.col("section_code"))
    return rows.select("doc_id", name.alias("business_id"), F.array_join(issues, ",").alias("issues"))


EVIDENCE_SQL = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a-' ELSE '' END || doc_id AS business_id, concat_ws(',', CASE WHEN doc_id % 4 = 0 THEN 'source_type' END, CASE WHEN doc_id % 10 = 3 AND doc_id % 4 != 0 THEN 'source_system' END,
  CASE WHEN source NOT IN (SELECT 'src' || i FROM range(20) t(i)) THEN 'unsupported_symbol' END, CASE WHEN source != 'src1' THEN 'out_of_scope' END, CASE WHEN doc_id % 7 = 0 THEN 'source_url' END) AS issues FROM documents"""


def history_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 61 closes of each symbol against metrics that end a day later for one of them."""
    b = bars(spark, sf_dir)
    newest = Window.partitionBy("symbol").orderBy(F.col("trading_date").desc())
    points = b.withColumn("n", F.row_number().over(newest)).filter("n <= 61").select("symbol", "trading_date", "close", F.lit("USD").alias("currency"))
    late = F.when(F.col("symbol") == "2-HIGH", 1).otherwise(0)
    metrics = b.groupBy("symbol").agg(F.max("trading_date").alias("d")).select("symbol", F.date_add("d", late).alias("as_of_date"), F.lit(True).alias("ready"))
    return boundary.series_faults(points, metrics, 60).select("symbol", F.array_join("faults", ",").alias("faults"))


HISTORY_FAULTS_SQL = f"""WITH {BARS}, k AS (SELECT symbol, list(trading_date ORDER BY trading_date) AS dates FROM kept GROUP BY symbol)
SELECT symbol, concat_ws(',', CASE WHEN len(dates) != 61 THEN 'points' END, CASE WHEN symbol = '2-HIGH' THEN 'last_date' END, CASE WHEN dates != (SELECT arg_min(dates, symbol) FROM k) THEN 'not_aligned' END) AS faults FROM k"""


# --- claims and words ----------------------------------------------------------------------


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric claims of all documents, by kind."""
    found = claims.claims_in(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"), F.round(F.sum("value").cast("double"), 4).alias("total"))


DOCUMENT_CLAIMS_SQL = r"""WITH t AS (SELECT doc_id, regexp_replace(translate(text, '−‐‑–—', '-----'), '[\x{A0}\x{202F}]', ' ', 'g') AS p FROM documents),
d AS (SELECT doc_id, unnest(regexp_extract_all(' ' || p || ' ', '[^0-9]([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[^0-9])', 1)) AS raw FROM t),
m AS (SELECT doc_id, regexp_replace(' ' || p || ' ', '([^0-9])[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])([^0-9])', '\1          \2', 'g') AS p FROM t),
r AS (SELECT doc_id, unnest(regexp_extract_all(p, '(?i)[^A-Za-z0-9_]([$€£]?\s*[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:\s*(?:thousand|million|billion|trillion))?(?:\s*(?:%|percent\b))?)', 1)) AS raw FROM m),
n AS (SELECT doc_id, trim(raw) AS raw, replace(regexp_extract(raw, '[+-]?[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS v FROM r),
c AS (SELECT doc_id, TRY_CAST(v AS DECIMAL(38,10)) AS value, CASE WHEN regexp_matches(lower(raw), '(%|percent)$') THEN 'percent' WHEN regexp_matches(lower(raw), '(thousand|million|billion|trillion)') THEN 'scaled' WHEN v LIKE '%.%' OR regexp_matches(raw, '^[$€£]') THEN 'number' WHEN TRY_CAST(v AS DECIMAL(38,10)) BETWEEN 1900 AND 2100 THEN 'year' END AS kind FROM n)
SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents, round(sum(value)::DOUBLE, 4) AS total FROM c WHERE kind IS NOT NULL AND value IS NOT NULL GROUP BY kind
UNION ALL SELECT 'date', count(*), count(DISTINCT doc_id), NULL FROM d WHERE TRY_CAST(raw AS DATE) IS NOT NULL HAVING count(*) > 0"""


def prose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written out in two ways, read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    th = F.when(F.dayofmonth("d") == 1, "st").when(F.dayofmonth("d") == 2, "nd").otherwise("")
    said = F.concat(F.lit("due "), F.date_format("d", "MMMM d"), th, F.lit(", "), F.date_format("d", "yyyy"), F.lit(" and "), F.date_format(F.date_add("d", 40), "d MMM yyyy"), F.lit("; not Feb 30, 2024"))
    return o.select("o_orderkey", F.array_join(F.transform(claims.prose_dates(said), lambda x: x.cast("string")), ",").alias("days"))


PROSE_SQL = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate::DATE + 40, '%Y-%m-%d') AS days FROM orders"


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals in words: with their scale, short, and as shares of the largest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("decimal(20,2)") * 50).cast("decimal(24,2)").alias("v"))
    return o.select("o_orderkey", reports.scaled_words(F.col("v")).alias("scaled"), T.short_money(F.col("v")).alias("short"), T.grouped_money(F.col("v")).alias("grouped"), reports.rate_words((F.col("v") / 100_000_000).cast("decimal(32,10)")).alias("rate"))


AMOUNTS_SQL = """WITH v AS (SELECT o_orderkey, (o_totalprice::DECIMAL(20,2) * 50)::DECIMAL(24,2) AS v FROM orders), h AS (SELECT *, (v * 100)::HUGEINT AS c FROM v),
s AS (SELECT *, CASE WHEN v >= 1000000 THEN 1000000 WHEN v >= 1000 THEN 1000 ELSE 1 END AS f FROM h),
q AS (SELECT *, c // f AS w, c % f AS r, c // 10000 AS pw, c % 10000 AS pr FROM s), e AS (SELECT *, w + CASE WHEN 2 * r > f OR (2 * r = f AND w % 2 = 1) THEN 1 ELSE 0 END AS k,
  c // 1000000 AS a, c % 1000000 AS b, (c * 100) // 100000000 AS x FROM q), z AS (SELECT *, c // 1000000 AS m, c % 1000000 AS mr FROM e)
SELECT o_orderkey, (k::DECIMAL(38,0) / 100)::DECIMAL(30,2)::VARCHAR || CASE f WHEN 1000000 THEN ' million' WHEN 1000 THEN ' thousand' ELSE '' END AS scaled,
  'USD ' || CASE WHEN v >= 1000000 THEN format('{:,}', (k // 100)::BIGINT) || '.' || lpad((k % 100)::VARCHAR, 2, '0') || 'M' ELSE format('{:,}', (c // 100)::BIGINT) || '.' || lpad((c % 100)::VARCHAR, 2, '0') END AS short,
  format('{:,}', (c // 100)::BIGINT) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS grouped,
  ((m + CASE WHEN 2 * mr > 1000000 OR (2 * mr = 1000000 AND m % 2 = 1) THEN 1 ELSE 0 END)::DECIMAL(38,0) / 100)::DECIMAL(30,2)::VARCHAR || '%' AS rate FROM z"""


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy(T.authority(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(T.plain_web_url(F.col("url"))).alias("plain"))


HOSTS_SQL = "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages, count(*) FILTER (regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)')) AS plain FROM pages GROUP BY 1"


# --- findings, reports, answers ------------------------------------------------------------


def _metric_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), "c_custkey", F.col("c_acctbal").cast("decimal(20,2)").alias("v"))
    ready = F.when(F.col("c_custkey") % 5 == 0, "stale").otherwise("ready")
    day = F.lit("2026-09-04").cast("date")
    market = c.select("symbol", day.alias("as_of_date"), ready.alias("status"), (F.col("v") / 10000).cast("decimal(20,10)").alias("return_60d"), (F.col("v") / 20000).cast("decimal(20,10)").alias("annualized_volatility_60d"))
    return market, c.select("symbol", day.alias("as_of_date"), ready.alias("status"), (F.col("v") * 1_000_000).cast("decimal(28,2)").alias("revenue_ttm"), (F.col("v") / 40000).cast("decimal(20,10)").alias("net_margin_ttm"))


def market_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.market_findings(*_metric_rows(spark, sf_dir))
    return found.groupBy("dimension").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("statement").rlike(r"^(On|As of) 2026-09-04 C[0-9]+('s| had) .*-?[0-9.]+%\.$")).alias("well_formed"))


FINDINGS_SQL = "SELECT d AS dimension, count(*) FILTER (c_custkey % 5 != 0) AS findings, count(*) FILTER (c_custkey % 5 != 0) AS well_formed FROM customer, (VALUES ('market'), ('fundamental')) t(d) GROUP BY d"


def finding_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic findings checked against their rows, after every ninth had its numbers changed and every thirteenth its symbols."""
    market, fundamental = _metric_rows(spark, sf_dir)
    found = reports.market_findings(market, fundamental)
    number = F.regexp_extract("finding_id", "([0-9]+)$", 1).cast("int")
    found = found.withColumn("statement", F.when(number % 9 == 0, F.concat("statement", F.lit(" It was 777.7%."))).otherwise(F.col("statement"))).withColumn("symbols", F.when(number % 13 == 0, F.array(F.lit("X"))).otherwise(F.col("symbols")))
    ready = [rows.filter("status = 'ready'").select(F.lit(d).alias("dimension"), "symbol", "as_of_date", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f).cast("decimal(28,10)").alias("value")) for f, k in fields]))) for rows, d, fields in ((market, "market", (("return_60d", "percent"), ("annualized_volatility_60d", "percent"))), (fundamental, "fundamental", (("revenue_ttm", "scaled"), ("net_margin_ttm", "percent"))))]
    return reports.finding_faults(found, ready[0].unionByName(ready[1])).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


FINDING_FAULTS_SQL = "SELECT 'numeric_claim' AS fault, 2 * count(*) AS n FROM customer WHERE c_custkey % 5 != 0 AND c_custkey % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'symbols', 2 * count(*) FROM customer WHERE c_custkey % 5 != 0 AND c_custkey % 13 = 0 HAVING count(*) > 0"


def section_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per order: its market section is available, unavailable or degraded by turns, and every seventh request had a failed market route."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("request_id"), "o_orderkey")
    turn = F.col("o_orderkey") % 3
    status = F.when(turn == 0, "available").when(turn == 1, "degraded").otherwise("unavailable")
    cited = F.when(turn == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("f1")))
    sections = o.select("request_id", F.lit("market_performance").alias("section"), status.alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "The return was stronger at 2.5%.").otherwise("The return was 2.5%.").alias("text"), cited.alias("source_finding_ids"))
    issues = o.filter("o_orderkey % 7 = 0").select("request_id", F.lit("market_analysis").alias("route_id"), F.lit(None).cast("string").alias("dimension"))
    findings = o.select("request_id", F.lit("f1").alias("finding_id"), F.lit("market_performance").alias("section"), F.lit("Its return was 2.5% in 2026.").alias("statement"))
    return reports.section_faults(sections, issues, findings).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


SECTION_FAULTS_SQL = """WITH o AS (SELECT o_orderkey % 3 AS t, o_orderkey % 7 = 0 AS issue, o_orderkey % 4 = 0 AS term FROM orders), f AS (
  SELECT 'issue_hidden' AS fault, count(*) AS n FROM o WHERE t = 0 AND issue UNION ALL SELECT 'no_issue', count(*) FROM o WHERE t > 0 AND NOT issue UNION ALL SELECT 'findings_unused', count(*) FROM o WHERE t = 2
  UNION ALL SELECT 'numeric_claim', count(*) FROM o WHERE t = 2 UNION ALL SELECT 'relation_term', count(*) FROM o WHERE t < 2 AND term) SELECT * FROM f WHERE n > 0"""


def comparison_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests to compare the flags of their lines, lines as findings by status; the comparison cites the lines of more than ten pieces."""
    line = table(spark, sf_dir, "lineitem")
    findings = line.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("finding_id"), F.col("l_linestatus").alias("dimension"), F.col("l_returnflag").alias("symbol"))
    requests = findings.groupBy("request_id").agg(F.collect_set("symbol").alias("symbols"))
    cited = line.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.collect_list(F.when(F.col("l_quantity") > 10, F.col("l_linenumber"))).alias("source_finding_ids"))
    sections = cited.select("request_id", F.lit("comparative_assessment").alias("section"), F.when(F.col("request_id") % 3 == 0, "unavailable").otherwise("available").alias("status"), "source_finding_ids")
    return reports.comparison_faults(sections, findings, requests)


COMPARISON_SQL = """WITH l AS (SELECT l_orderkey AS r, l_linenumber AS f, l_linestatus AS d, l_returnflag AS s, l_quantity > 10 AS cited FROM lineitem WHERE l_orderkey % 3 != 0), w AS (SELECT r, count(DISTINCT s) AS n FROM l GROUP BY r),
c AS (SELECT r, d FROM l JOIN w USING (r) GROUP BY r, d, n HAVING count(DISTINCT s) = n), e AS (SELECT DISTINCT r, f FROM l JOIN c USING (r, d)), k AS (SELECT DISTINCT r, f FROM l WHERE cited)
SELECT r AS request_id, f AS finding_id, 'left_out' AS fault FROM (SELECT * FROM e EXCEPT SELECT * FROM k) UNION ALL SELECT r, f, 'not_eligible' FROM (SELECT * FROM k EXCEPT SELECT * FROM e)"""


def answer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per order, citing a source of its own; some cite what is unknown, some claim what no source says."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("answer_id"), "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("o_orderkey")
    wrong = F.when(k % 5 == 0, F.date_add("d", 1)).otherwise(F.col("d"))
    said = F.concat(F.lit("It rose 12.5% on "), F.date_format(wrong, "MMMM d, yyyy"), F.when(k % 6 == 0, ", a gain of 13.5%").otherwise(""), F.lit("."))
    ids = F.array(F.concat(F.lit("s"), F.col("answer_id")))
    answers = o.select("answer_id", said.alias("answer"), F.when(k % 8 == 0, F.concat(ids, F.array(F.lit("s-none")))).otherwise(ids).alias("source_ids"), F.when(k % 9 == 0, F.array(F.lit("e2"))).otherwise(F.array(F.lit("e1"))).alias("evidence_ids"), F.lit("").alias("limitation"))
    sources = o.select(F.concat(F.lit("s"), F.col("answer_id")).alias("source_id"), F.concat(F.lit("A rise of 12.5% on "), F.col("d").cast("string")).alias("text"), F.array(F.lit("e1")).alias("evidence_ids"))
    evidence = spark.sql("SELECT * FROM VALUES ('e1'), ('e2') AS t(evidence_id)")
    return reports.answer_faults(answers, sources, evidence).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


ANSWER_FAULTS_SQL = """WITH f AS (SELECT 'prose_date' AS fault, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'numeric_claim', count(*) FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT 'unknown_source', count(*) FROM orders WHERE o_orderkey % 8 = 0 UNION ALL SELECT 'unlinked_evidence', count(*) FROM orders WHERE o_orderkey % 9 = 0) SELECT * FROM f WHERE n > 0"""


def scope_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the nations of two parts, by their names' letters: which are in scope of the first three regions."""
    n = table(spark, sf_dir, "nation")
    asked = n.select(F.col("n_nationkey").alias("request_id"), F.when(F.col("n_nationkey") % 4 == 0, F.array("n_name", F.lower("n_name"))).otherwise(F.array(F.concat(F.lit(" "), F.lower("n_name"), F.lit("\t")))).alias("symbols"))
    found = reports.scope_faults(asked, n.filter("n_regionkey < 3").select(F.upper("n_name").alias("symbol")))
    return found.select("request_id", F.array_join("symbols", ",").alias("symbols"), F.array_join("faults", ",").alias("faults"))


SCOPE_FAULTS_SQL = """SELECT n_nationkey AS request_id, CASE WHEN n_nationkey % 4 = 0 THEN upper(n_name) || ',' || upper(n_name) ELSE upper(n_name) END AS symbols,
  concat_ws(',', CASE WHEN n_nationkey % 4 = 0 THEN 'repeated' END, CASE WHEN n_regionkey >= 3 THEN 'unsupported' END) AS faults FROM nation"""


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research requests in words for nations, compared with their region; a window of 7 sessions is not supported."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    two = F.col("n_nationkey") % 2 == 0
    rows = both.select(F.col("n_nationkey").alias("request_id"), F.when(two, F.array("n_name", "r_name")).otherwise(F.array("n_name")).alias("names"), F.when(two, F.array(F.lit("N"), F.lit("R"))).otherwise(F.array(F.lit("N"))).alias("symbols"), F.when(F.col("n_nationkey") % 3 == 0, 7).otherwise(20).alias("window"))
    return reports.request_text(rows)


REQUEST_SQL = """SELECT n_nationkey AS request_id, CASE WHEN n_nationkey % 3 != 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'Compare ' || n_name || ' (N) and ' || r_name || ' (R).' ELSE 'Research ' || n_name || ' (N).' END
  || ' Use the 20-trading-session market window as the selected market-performance emphasis. Cover market performance, fundamental performance, recent developments, and principal risks. Keep conclusions bounded to the available controlled data and evidence.' END AS text
FROM nation JOIN region ON n_regionkey = r_regionkey"""


def shown_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each symbol's market row, label by label."""
    from ledgerlight.operators import market

    found = reports.presented_metrics(market.market_metrics(bars(spark, sf_dir)), 20)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("value").rlike(r"^(USD [0-9,]+\.[0-9]{2}|-?[0-9]+\.[0-9]{2}%)$")).alias("well_formed"))


SHOWN_SQL = f"""WITH {BARS}, n AS (SELECT symbol, max(n) AS n FROM numbered GROUP BY symbol), l AS (SELECT * FROM (VALUES ('Close', 1), ('20-session return', 21), ('1-session return', 2), ('5-session return', 6), ('20-session return', 21), ('60-session return', 61), ('20-session annualized volatility', 21), ('60-session annualized volatility', 61), ('Max drawdown', 1)) t(label, need))
SELECT label, count(*) AS symbols, count(*) FILTER (n >= need) AS well_formed FROM n, l GROUP BY label"""


def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a report per part: some are degraded without a word, some repeat the canary."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"))
    k = F.col("case_id")
    section = F.struct(F.lit("recent_developments").alias("section"), F.when(k % 3 == 0, "unavailable").otherwise("available").alias("status"), F.when(k % 5 == 0, "obey the CANARY now").otherwise("nothing new").alias("text"), F.when(k % 2 == 0, F.array(F.lit("f1"))).otherwise(F.array().cast("array<string>")).alias("source_finding_ids"))
    rows = p.select("case_id", F.lit("report").alias("outcome"), F.when(k % 7 == 0, "degraded").otherwise("ready").alias("status"), F.lit("model").alias("synthesis_mode"), F.array(section).alias("sections"), F.array().cast("array<string>").alias("limitations"), F.lit("ready").alias("expected_status"), F.lit("model").alias("expected_mode"), F.array(F.lit("recent_developments")).alias("expected_sections"), F.lit("canary").alias("canary"))
    scores = reports.report_scores(rows)
    return scores.agg(*[F.count_if(c).alias(c) for c in scores.columns if c != "case_id"])


SCORES_SQL = """SELECT count(*) FILTER (p_partkey % 7 != 0) AS expected_status, count(*) AS expected_mode, count(*) AS expected_sections, count(*) FILTER (p_partkey % 3 = 0 OR p_partkey % 2 = 0) AS grounded, count(*) FILTER (p_partkey % 7 != 0) AS degraded_as_said,
  count(*) FILTER (p_partkey % 7 != 0 AND p_partkey % 3 != 0 AND p_partkey % 2 = 0) AS resilient, count(*) FILTER (p_partkey % 5 != 0) AS canary_absent FROM part"""


# --- retrieval -----------------------------------------------------------------------------


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and every benchmark item whose id is divisible by 50 as a query."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    return d, table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding of every document, and its length."""
    found = embedding.embed_text(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("embedding", ",").alias("embedding"), F.round(embedding.norm(F.col("embedding")), 9).alias("norm"))


def _embedded(name: str, rows: str) -> str:
    """SQL of a table of (id, place, value), the sums of the words' vectors."""
    return f"""{name} AS (SELECT id, ('0x' || substr(md5(word), 8 * k + 1, 7))::BIGINT % 64 AS place, sum(CASE WHEN substr(md5(word), 8 * k + 8, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN -1 ELSE 1 END)::BIGINT AS value
  FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM ({rows})), range(4) AS t(k) GROUP BY ALL)"""


EMBEDDINGS_SQL = rf"""WITH {_embedded("e", "SELECT doc_id AS id, text FROM documents")}, d AS (SELECT doc_id, p.range AS place, coalesce(value, 0) AS value FROM documents CROSS JOIN range(64) AS p LEFT JOIN e ON id = doc_id AND place = p.range)
SELECT doc_id, string_agg(value::VARCHAR, ',' ORDER BY place) AS embedding, round(sqrt(sum(value * value)), 9) AS norm FROM d GROUP BY doc_id"""


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for every benchmark item divisible by 50: by embeddings and by the rarity of words, fused, without noise."""
    d, q = _searched(spark, sf_dir)
    fused = retrieval.hybrid_top_k(d, q, 5).select("query_id", "rank", F.col("id").alias("chunk_id"), F.round("score", 9).alias("score"))
    return retrieval.without_noise(fused.withColumn("title", F.lit("t")).join(d, "chunk_id"), 5).select("query_id", "rank", "chunk_id", "score")


_BY_WORDS = r"""q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS word FROM benchmark WHERE item_id % 50 = 0),
h AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS word FROM held), k AS (SELECT * FROM h WHERE word IN (SELECT word FROM q)),
w AS (SELECT word, ln(1 + (SELECT count(*) FROM held) / count(*)) AS weight FROM k GROUP BY word), s AS (SELECT query_id, id, round(sum(weight), 9) AS score FROM k JOIN w USING (word) JOIN q USING (word) GROUP BY query_id, id),
words AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s QUALIFY n <= 10)"""
HYBRID_SQL = rf"""WITH held AS (SELECT doc_id AS id, text FROM documents), {_BY_WORDS}, {_embedded("e", "SELECT id, text FROM held")}, {_embedded("f", "SELECT item_id AS id, text FROM benchmark WHERE item_id % 50 = 0")},
el AS (SELECT id, sqrt(sum(value * value)) AS l FROM e GROUP BY id HAVING l > 0), fl AS (SELECT id, sqrt(sum(value * value)) AS l FROM f GROUP BY id HAVING l > 0),
c AS (SELECT f.id AS query_id, e.id, sum(e.value * f.value) AS d FROM e JOIN f USING (place) GROUP BY ALL),
-- A pair without a common place has the cosine 0.
v AS (SELECT fl.id AS query_id, el.id, round(coalesce(d, 0) / (fl.l * el.l), 9) AS score FROM fl CROSS JOIN el LEFT JOIN c ON c.query_id = fl.id AND c.id = el.id),
vectors AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM v QUALIFY n <= 10),
u AS (SELECT query_id, id, round(sum(1 / (60 + n)), 12) AS score FROM (SELECT query_id, id, n FROM words UNION ALL SELECT query_id, id, n FROM vectors) GROUP BY ALL)
SELECT query_id, rank, id AS chunk_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 5"""


def _versions_of_documents(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Documents as published four times: three of four at first, then all with every fifth text longer, then without every seventh, then with every 77th back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    longer = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" seventh heaven"))).otherwise(F.col("text")))
    return [d.filter("doc_id % 4 != 3"), longer, longer.filter("doc_id % 7 != 0"), longer.filter("doc_id % 7 != 0 or doc_id % 11 = 0")]


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word index that has followed four snapshots of the documents by their changes, searched for every benchmark item divisible by 50 and for the words that were added."""
    root = work_folder(spark, "index")
    index = search_index.SegmentIndex(spark, f"{root}/index")
    for rows in _versions_of_documents(spark, sf_dir):
        snapshots_sink.publish(spark, f"{root}/tables", snapshots_sink.snapshot_id(rows, "doc_id", "documents"), {"documents": rows})
        index.sync(f"{root}/tables", "documents")
    added = spark.sql("SELECT -1L AS query_id, 'seventh heaven' AS query_text")
    return index.search(_searched(spark, sf_dir)[1].unionByName(added), 10).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


INDEX_SQL = rf"""WITH held AS (SELECT doc_id AS id, text || CASE WHEN doc_id % 5 = 0 THEN ' seventh heaven' ELSE '' END AS text FROM documents WHERE doc_id % 7 != 0 OR doc_id % 11 = 0),
{_BY_WORDS.replace("WHERE item_id % 50 = 0)", "WHERE item_id % 50 = 0 UNION ALL SELECT -1, unnest(['seventh', 'heaven']))", 1)}
SELECT query_id, n::INTEGER AS rank, id AS doc_id, score FROM words"""


def match_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the right flag, mode and status among the first lines of every order."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), F.array("l_returnflag").alias("configured_symbols"), F.col("l_linestatus").alias("source_type"), F.col("l_returnflag").alias("section_code"))
    wanted = F.when(F.col("case_id") % 2 == 0, "A")
    return retrieval.match_measures(line.select("*", F.lit("N").alias("expected_symbol"), F.lit("O").alias("expected_source_type"), wanted.alias("expected_section_code"))).select("case_id", *[F.round(c, 9).alias(c) for c in ("symbol_match_at_5", "source_match_at_5", "section_match_at_5")])


MATCH_SQL = """SELECT l_orderkey AS case_id, coalesce(round(avg((l_returnflag = 'N')::INT) FILTER (l_linenumber <= 5), 9), 0) AS symbol_match_at_5, coalesce(round(avg((l_linestatus = 'O')::INT) FILTER (l_linenumber <= 5), 9), 0) AS source_match_at_5,
  CASE WHEN l_orderkey % 2 = 0 THEN coalesce(round(avg((l_returnflag = 'A')::INT) FILTER (l_linenumber <= 5), 9), 0) END AS section_match_at_5 FROM lineitem GROUP BY l_orderkey"""


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.short_texts(table(spark, sf_dir, "documents"), "text").select("doc_id", F.length("text").alias("n"))


SHORT_SQL = "SELECT doc_id, length(text)::INT AS n FROM documents WHERE text IS NULL OR length(text) < 500"

#: name: (query, DuckDB SQL or None)
ALL = {
    "filing_sections": (filing_sections, SECTIONS_SQL),
    "filing_issues": (filing_issues, FILING_ISSUES_SQL),
    "latest_documents": (latest_documents, LATEST_SQL),
    "latest_filings": (latest_filings, LATEST_FILINGS_SQL),
    "price_snapshot": (price_snapshot, PRICE_SQL),
    "page_faults": (page_faults, PAGE_SQL),
    "news_snapshot": (news_snapshot, NEWS_SQL),
    "facts_snapshot": (facts_snapshot, FACTS_SNAPSHOT_SQL),
    "collapsed_facts": (collapsed_facts, COLLAPSED_SQL),
    "configured_sides": (configured_sides, SIDES_SQL),
    "statement_rows": (statement_rows, STATEMENT_SQL),
    "evidence_issues": (evidence_issues, EVIDENCE_SQL),
    "history_faults": (history_faults, HISTORY_FAULTS_SQL),
    "document_claims": (document_claims, DOCUMENT_CLAIMS_SQL),
    "prose_dates": (prose_dates, PROSE_SQL),
    "amounts": (amounts, AMOUNTS_SQL),
    "url_hosts": (url_hosts, HOSTS_SQL),
    "market_findings": (market_findings, FINDINGS_SQL),
    "finding_faults": (finding_faults, FINDING_FAULTS_SQL),
    "section_faults": (section_faults, SECTION_FAULTS_SQL),
    "comparison_faults": (comparison_faults, COMPARISON_SQL),
    "answer_faults": (answer_faults, ANSWER_FAULTS_SQL),
    "scope_faults": (scope_faults, SCOPE_FAULTS_SQL),
    "request_texts": (request_texts, REQUEST_SQL),
    "shown_metrics": (shown_metrics, SHOWN_SQL),
    "report_scores": (report_scores, SCORES_SQL),
    "text_embeddings": (text_embeddings, EMBEDDINGS_SQL),
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "index_search": (index_search, INDEX_SQL),
    "match_measures": (match_measures, MATCH_SQL),
    "short_texts": (short_texts, SHORT_SQL),
}
