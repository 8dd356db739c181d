"""What comes back from outside services, checked before it is used.

Answers arrive as JSON texts, one row each. Each reader gives typed rows and each
``*_faults`` says why an answer cannot be used; an answer with faults gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import text as T

# The sources of evidence and the systems they come from.
SYSTEMS = {"news": "alpaca", "filing": "sec"}
PREFIXES = {"news": "alpaca:news:", "filing": "sec:filing:"}
EVIDENCE = (
    "chunk_id", "document_id", "document_version_id", "source_type", "source_system", "configured_symbols", "title", "evidence_date",
    "source_url", "section_code", "section_title", "chunk_index", "chunk_text", "source_response_id", "source_fetched_at", "source_ingestion_run_id",
)

_STATEMENT = "status struct<state: string>, manifest struct<format: string, schema: struct<columns: array<struct<name: string>>>, total_chunk_count: int, truncated: boolean>, result struct<data_array: array<array<string>>, next_chunk_index: int, truncated: boolean>"
_SEARCH = "manifest struct<columns: array<struct<name: string>>>, result struct<data_array: array<array<variant>>>"


def _coded(**broken: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(True)), F.lit(code)) for code, b in broken.items()]))


def statement_faults(answer: Column, columns: list[str]) -> Column:
    """Codes of why a statement's answer (JSON) is not exactly the asked columns, whole and in one chunk."""
    a = F.from_json(answer, _STATEMENT)
    names = F.transform(a["manifest"]["schema"]["columns"], lambda c: c["name"])
    false = F.lit(False)
    return _coded(
        not_succeeded=~F.coalesce(a["status"]["state"] == "SUCCEEDED", false),
        format=~F.coalesce(a["manifest"]["format"] == "JSON_ARRAY", false),
        columns=~F.coalesce(names == F.array(*[F.lit(c) for c in columns]), false),
        several_chunks=a["result"]["next_chunk_index"].isNotNull() | (F.coalesce(a["manifest"]["total_chunk_count"], F.lit(1)) != 1),
        truncated=F.coalesce(a["manifest"]["truncated"], false) | F.coalesce(a["result"]["truncated"], false),
        row_width=F.exists(F.coalesce(a["result"]["data_array"], F.array().cast("array<array<string>>")), lambda r: F.size(r) != len(columns)),
    )


def statement_rows(answers: DataFrame, columns: dict[str, str], answer_col: str = "answer") -> DataFrame:
    """Typed rows of answers without faults: their other columns, then ``columns`` (name to type, in the asked order); a cell that does not fit its type is null."""
    kept = [c for c in answers.columns if c != answer_col]
    sound = answers.filter(F.size(statement_faults(F.col(answer_col), list(columns))) == 0)
    rows = sound.select(*kept, F.explode(F.from_json(F.col(answer_col), _STATEMENT)["result"]["data_array"]).alias("_r"))
    return rows.select(*kept, *[F.get("_r", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items())])


def evidence_rows(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Rows of a search's answers (JSON: named columns, rows of values) with their rank, and ``shape`` faults of the answer."""
    kept = [c for c in answers.columns if c != answer_col]
    a = F.from_json(F.col(answer_col), _SEARCH)
    names = F.transform(a["manifest"]["columns"], lambda c: c["name"])
    lacking = F.array_except(F.array(*[F.lit(c) for c in EVIDENCE]), names)
    rows = answers.select(*kept, names.alias("_names"), F.coalesce(F.size(lacking) > 0, F.lit(True)).alias("_lacking"), F.posexplode(a["result"]["data_array"]).alias("_at", "_r"))
    shape = _coded(columns=F.col("_lacking"), row_width=F.size("_r") != F.size("_names"))
    cell = lambda name: F.get("_r", F.array_position("_names", name).cast("int") - 1)
    kinds = {"configured_symbols": "array<string>", "chunk_index": "int", "evidence_date": "date"}
    return rows.select(*kept, (F.col("_at") + 1).alias("retrieval_rank"), shape.alias("shape"), *[F.try_variant_get(cell(c), "$", kinds.get(c, "string")).alias(c) for c in EVIDENCE])


def evidence_issues(requested: list[str], configured: list[str], source_type: str | None = None) -> Column:
    """Codes of why a row of ``evidence_rows`` is not evidence for the requested symbols (a subset of the configured)."""
    listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    kind, false = F.col("source_type"), F.lit(False)
    system, prefix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in SYSTEMS:
        system, prefix = F.when(kind == name, SYSTEMS[name]).otherwise(system), F.when(kind == name, PREFIXES[name]).otherwise(prefix)
    section = T.nonblank(F.col("section_code")).isNotNull(), T.nonblank(F.col("section_title")).isNotNull()
    texts = [c for c in EVIDENCE if c not in ("configured_symbols", "chunk_index", "evidence_date", "section_code", "section_title")]
    blank = F.lit(False)
    for c in texts:
        blank = blank | T.nonblank(F.col(c)).isNull()
    return F.concat(
        F.col("shape"),
        _coded(
            required_text=blank,
            chunk_id=~F.coalesce(T.matches(F.col("chunk_id"), T.SHA256), false),
            source_type=~F.coalesce(kind.isin(*SYSTEMS) & (F.lit(source_type is None) | (kind == (source_type or ""))), false),
            source_system=~F.coalesce(F.col("source_system") == system, false),
            unsupported_symbol=~F.coalesce(F.size(F.array_except("configured_symbols", listed(configured))) == 0, false),
            out_of_scope=~F.coalesce(F.arrays_overlap("configured_symbols", listed(requested)), false),
            evidence_date=F.col("evidence_date").isNull(),
            source_url=~T.plain_web_url(F.col("source_url")),
            section=F.when(kind == "news", section[0] | section[1]).otherwise(~(section[0] & section[1])),
            chunk_index=~F.coalesce(F.col("chunk_index") >= 0, false),
            document_id=~F.coalesce(F.startswith("document_id", prefix) & (business_id(F.col("document_id"), kind, F.col("section_code")) != ""), false),
        ),
    )


def business_id(document_id: Column, source_type: Column, section_code: Column) -> Column:
    """What the source calls a document: a news id, or a filing's accession number; null where the id is not of that form."""
    news = F.regexp_extract(document_id, r"\Aalpaca:news:([0-9]+)\z", 1)
    head, tail = F.regexp_extract(document_id, r"\Asec:filing:(.+):([^:]+)\z", 1), F.regexp_extract(document_id, r"\Asec:filing:(.+):([^:]+)\z", 2)
    filing = F.when(F.coalesce(tail == section_code, F.lit(False)), head)
    return F.nullif(F.when(source_type == "news", news).when(source_type == "filing", filing), F.lit(""))


def cited_captured(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (position, evidence_id) whose evidence was captured, each evidence once, in order of first citation."""
    first = citations.groupBy("evidence_id").agg(F.min("position").alias("position")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return first.withColumn("rank", F.row_number().over(Window.orderBy("position"))).select("rank", "evidence_id")  # an answer's own citations


def series_faults(points: DataFrame, metrics: DataFrame, sessions: int) -> DataFrame:
    """Per requested symbol what is wrong with its price history against its market metrics; no code: it is ready.

    ``points``: symbol, trading_date, close, currency. ``metrics``: symbol, as_of_date, ready; one row
    per requested symbol. If any metric is not ready, every series is unavailable.
    """
    days = F.array_sort(F.collect_list("trading_date"))
    held = points.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trading_date").alias("days"), F.max("trading_date").alias("last"), F.count_if(F.coalesce(F.col("currency") != "USD", F.lit(True))).alias("other"), F.count_if(~F.coalesce(F.col("close") > 0, F.lit(False))).alias("bad"), days.alias("dates"))
    every = Window.partitionBy()  # one row per requested symbol
    rows = metrics.join(held, "symbol", "left").withColumn("_all", F.min(F.coalesce(F.col("ready"), F.lit(False))).over(every)).withColumn("_first", F.min(F.struct("symbol", "dates")).over(every)["dates"])
    codes = _coded(
        points=~F.coalesce(F.col("n") == sessions + 1, F.lit(False)),
        repeated_dates=F.coalesce(F.col("days") != F.col("n"), F.lit(False)),
        currency=F.coalesce(F.col("other") > 0, F.lit(False)),
        close=F.coalesce(F.col("bad") > 0, F.lit(False)),
        last_date=~F.coalesce(F.col("last") == F.col("as_of_date"), F.lit(False)),
        not_aligned=~F.coalesce(F.col("dates") == F.col("_first"), F.lit(False)),
    )
    return rows.select("symbol", F.when(~F.col("_all"), F.array(F.lit("unavailable"))).otherwise(codes).alias("faults"))


def out_of_scope(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """Symbols with points that nobody asked for."""
    return points.select("symbol").distinct().join(metrics, "symbol", "left_anti")
