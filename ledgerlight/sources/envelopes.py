"""Raw response envelopes (one row a page, payload as JSON text) opened into rows.

Payloads are parsed once into variants; shapes that break a page's contract are
rows of ``envelope_faults``, problems of single rows are left to the validators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.functions.text import ACCESSION, CIK, cik10, matches, nonblank, sha256, strip

ENVELOPE = (
    "source_response_id string, source_system string, source_endpoint string, request_parameters_json string, page_number int, "
    "http_status int, response_payload_json string, response_bytes bigint, response_sha256 string, records_received bigint, fetched_at timestamp, ingestion_run_id string"
)


def read_envelopes(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Envelopes kept as files (JSON lines or Parquet), with their schema stated."""
    return spark.read.schema(ENVELOPE).format(form).load(path)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Configured entities: symbol, display_name, feed symbol and CIK, from one JSON document."""
    return spark.read.schema("symbol string, display_name string, alpaca_symbol string, sec_cik string").json(path, multiLine=True)


def envelope_faults(envelopes: DataFrame) -> DataFrame:
    """Responses whose status, size, hash or JSON is not what the envelope says."""
    body = F.col("response_payload_json")
    broken = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("http_status") != 200, F.lit(True)), F.lit("http_status")),
            F.when(F.coalesce(F.octet_length(body) != F.col("response_bytes"), F.lit(True)), F.lit("response_bytes")),
            F.when(F.coalesce(sha256(body) != F.col("response_sha256"), F.lit(True)), F.lit("response_sha256")),
            F.when(F.try_parse_json(body).isNull(), F.lit("response_payload_json")),
        )
    )
    return envelopes.withColumn("faults", broken).filter(F.size("faults") > 0).select("source_response_id", "faults")


def bars_of(envelopes: DataFrame) -> DataFrame:
    """A row per bar: symbol, bar (variant) and its provenance."""
    # JSON has no NaN; what some servers write becomes an object that the validator knows.
    spelled = F.regexp_replace("response_payload_json", r"(?<=[:,\[\s])(-?Infinity|NaN)(?=\s*[,}\]])", '{"nonfinite":"$1"}')
    parsed = F.try_parse_json(spelled)
    by_symbol = F.try_variant_get(parsed, "$.bars", "map<string, array<variant>>")
    rows = envelopes.select("source_response_id", "ingestion_run_id", "fetched_at", F.explode(by_symbol).alias("symbol", "bars"))
    return rows.select("source_response_id", "ingestion_run_id", "fetched_at", F.trim("symbol").alias("symbol"), F.explode("bars").alias("bar"))


def articles_of(envelopes: DataFrame) -> DataFrame:
    parsed = F.try_parse_json("response_payload_json")
    return envelopes.select("source_response_id", "source_system", "ingestion_run_id", "fetched_at", F.explode(F.try_variant_get(parsed, "$.news", "array<variant>")).alias("article"))


def facts_of(envelopes: DataFrame, concepts: list[str], taxonomy: str = "us-gaap", unit: str = "USD") -> DataFrame:
    """A row per observation of the wanted concepts; a response without one of them gives none of it."""
    parsed = F.try_parse_json("response_payload_json")
    listed = F.array(*[F.struct(F.lit(c).alias("concept"), F.try_variant_get(parsed, f"$.facts['{taxonomy}'].{c}.units.{unit}", "array<variant>").alias("observations")) for c in concepts])
    rows = envelopes.select("source_response_id", "fetched_at", F.try_variant_get(parsed, "$.cik", "bigint").cast("string").alias("cik"), F.explode(listed).alias("x"))
    return rows.select("source_response_id", "fetched_at", F.lpad("cik", 10, "0").alias("cik"), F.col("x.concept").alias("concept"), F.explode("x.observations").alias("observation"))


_RECENT = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")


def submissions_faults(submissions: DataFrame) -> DataFrame:
    """Documents (cik, payload) that are not what a submissions page promises: other company, no arrays, or arrays of unequal length, blank forms."""
    parsed = F.try_parse_json("payload")
    kinds = [F.schema_of_variant(F.try_variant_get(parsed, f"$.filings.recent.{f}", "variant")) for f in _RECENT]
    arrays = F.lit(True)
    for k in kinds:
        arrays = arrays & F.coalesce(k.startswith("ARRAY"), F.lit(False))
    sizes = F.array(*[F.size(F.try_variant_get(parsed, f"$.filings.recent.{f}", "array<variant>")) for f in _RECENT])
    said = F.coalesce(F.try_variant_get(parsed, "$.cik", "string"), F.lit(""))
    forms = F.try_variant_get(parsed, "$.filings.recent.form", "array<string>")
    broken = F.array_compact(
        F.array(
            F.when(~F.coalesce(cik10(said) == F.col("cik"), F.lit(False)), F.lit("other_cik")),
            F.when(~arrays, F.lit("not_arrays")),
            F.when(arrays & (F.size(F.array_distinct(sizes)) != 1), F.lit("unequal_lengths")),
            F.when(arrays & F.exists(forms, lambda f: nonblank(f).isNull()), F.lit("blank_form")),
        )
    )
    return submissions.withColumn("faults", broken).filter(F.size("faults") > 0).select("cik", "faults")


def recent_filings(submissions: DataFrame, form: str = "10-K") -> DataFrame:
    """Filings of one form from the columnar arrays of a submissions document (columns cik, payload), with issues: accession, dates or document not of their form."""
    recent = F.from_json("payload", "filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>>>")["filings"]["recent"]
    rows = submissions.withColumn("r", recent).select("cik", F.explode(F.arrays_zip("r.accessionNumber", "r.form", "r.filingDate", "r.reportDate", "r.primaryDocument")).alias("f"))
    out = rows.select("cik", F.col("f.accessionNumber").alias("accession_number"), strip(F.col("f.form")).alias("filing_form"), F.try_to_date("f.filingDate", "yyyy-MM-dd").alias("filing_date"), F.try_to_date("f.reportDate", "yyyy-MM-dd").alias("report_date"), F.col("f.primaryDocument").alias("primary_document"))
    document = F.col("primary_document")
    issues = F.array_compact(
        F.array(
            F.when(~F.coalesce(matches(F.col("accession_number"), ACCESSION), F.lit(False)), F.lit("accession")),
            F.when(F.col("filing_date").isNull() | F.col("report_date").isNull(), F.lit("date")),
            F.when(nonblank(document).isNull() | document.rlike(r"[/\\\\]") | document.isin(".", ".."), F.lit("document")),
        )
    )
    return out.filter(F.col("filing_form") == form).withColumn("issues", issues)


def latest_filings(filings: DataFrame) -> DataFrame:
    """The filing of the last date of each company; ``ambiguous`` if several share it (then the smallest accession is shown)."""
    last = F.max("filing_date").over(Window.partitionBy("cik"))
    newest = filings.withColumn("_last", last).filter(F.col("filing_date") == F.col("_last")).drop("_last")
    rest = [c for c in newest.columns if c != "cik"]
    return newest.groupBy("cik").agg(F.min_by(F.struct(*rest), "accession_number").alias("row"), (F.count(F.lit(1)) > 1).alias("ambiguous")).select("cik", "row.*", "ambiguous")


def page_faults(envelopes: DataFrame, kind: str) -> DataFrame:
    """Pages of bars or news whose payload is not of their shape: symbols that repeat once stripped, a token that is no nonblank text, fewer or more records than the envelope says."""
    parsed = F.try_parse_json("response_payload_json")
    token = F.schema_of_variant(F.try_variant_get(parsed, "$.next_page_token", "variant"))
    said = F.try_variant_get(parsed, "$.next_page_token", "string")
    if kind == "bars":
        by_symbol = F.try_variant_get(parsed, "$.bars", "map<string, array<variant>>")
        records = F.aggregate(F.map_values(by_symbol), F.lit(0), lambda n, bars: n + F.size(bars))
        names = F.transform(F.map_keys(by_symbol), strip)
        unique = (F.size(F.array_distinct(names)) == F.size(names)) & ~F.exists(names, lambda s: s == "")
    else:
        records, unique = F.size(F.try_variant_get(parsed, "$.news", "array<variant>")), F.lit(True)
    broken = F.array_compact(
        F.array(
            F.when(records.isNull(), F.lit("shape")),
            F.when(records.isNotNull() & ~unique, F.lit("symbols")),
            F.when(~F.coalesce(token.isNull() | (token == "VOID") | ((token == "STRING") & nonblank(said).isNotNull()), F.lit(False)), F.lit("page_token")),
            F.when(records.isNotNull() & ~F.coalesce(records == F.col("records_received"), F.lit(False)), F.lit("records_received")),
        )
    )
    return envelopes.withColumn("faults", broken).filter(F.size("faults") > 0).select("source_response_id", "faults")


def universe_faults(universe: DataFrame) -> DataFrame:
    """Configured entities that break a rule: blank names, a symbol or CIK not of its form, or one that another entity has."""
    times = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    rows = universe.withColumns({"_symbols": times("symbol"), "_feeds": times("alpaca_symbol"), "_ciks": times("sec_cik")})
    no = F.lit(False)
    broken = F.array_compact(
        F.array(
            F.when(~F.coalesce(matches(F.col("symbol"), r"[A-Z][A-Z0-9.]*") & matches(F.col("alpaca_symbol"), r"[A-Z][A-Z0-9.]*"), no), F.lit("symbol")),
            F.when(nonblank(F.col("display_name")).isNull(), F.lit("display_name")),
            F.when(~F.coalesce(matches(F.col("sec_cik"), CIK), no), F.lit("sec_cik")),
            F.when((F.col("_symbols") > 1) | (F.col("_feeds") > 1) | (F.col("_ciks") > 1), F.lit("repeated")),
        )
    )
    return rows.withColumn("faults", broken).filter(F.size("faults") > 0).select("symbol", "faults")
