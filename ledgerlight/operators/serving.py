"""What an application asks of the published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.text import IDENTIFIER


def rows_for(spark: SparkSession, table: str, symbols: list[str], limit: int = 10) -> DataFrame:
    """Rows of the requested symbols by a parameterised statement, one more than ``limit`` at most (see ``whole_rows``)."""
    for part in table.split("."):
        check_identifier(part)
    names = {f"s{i}": s for i, s in enumerate(symbols)}
    marks = ", ".join(f":{n}" for n in names) or "NULL"
    return spark.sql(f"SELECT * FROM IDENTIFIER(:t) WHERE symbol IN ({marks}) ORDER BY symbol LIMIT {int(limit) + 1}", args={"t": table, **names})


def whole_rows(rows: DataFrame, limit: int = 10) -> list:
    """The rows of ``rows_for``; a ValueError if there are more than ``limit``, as an answer cut short is no answer."""
    found = rows.collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows")
    return found


def filing_age_issue(form: Column, filed: Column, today: Column) -> Column:
    """ahead, or stale beyond 180 days (an annual report: 450); null where the filing is recent."""
    age = F.datediff(today, filed)
    return F.when(age < 0, "ahead").when(age > F.when(form == "10-K", 450).otherwise(180), "stale")


def check_identifier(name: str) -> str:
    import re

    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def readiness(requested: DataFrame, published: DataFrame, key: str, as_of: str, today: Column, most_days: int = 4) -> DataFrame:
    """Status of each requested entity: ready, or unavailable as missing or stale; a date ahead of today is an error."""
    joined = requested.select(key).join(published.select(key, F.col(as_of).alias("as_of_date")), key, "left")
    lag = F.datediff(today, F.col("as_of_date"))
    reason = F.when(F.col("as_of_date").isNull(), "missing").when(lag < 0, "ahead").when(lag > most_days, "stale")
    return joined.withColumn("lag_days", lag).withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "ready").when(reason == "ahead", "error").otherwise("unavailable"))


def covering_sections(findings: DataFrame, symbols: int) -> DataFrame:
    """Dimensions that every requested symbol has findings for."""
    return findings.groupBy("dimension").agg(F.count_distinct("symbol").alias("n")).filter(F.col("n") == symbols).select("dimension")


def route_status(outcomes: DataFrame) -> DataFrame:
    """unavailable if every route failed, degraded if any failed or is limited, else ready; one row per request."""
    failed, limited = F.count_if("failed"), F.count_if("limited")
    status = F.when(failed == F.count(F.lit(1)), "unavailable").when((failed > 0) | (limited > 0), "degraded").otherwise("ready")
    return outcomes.groupBy("request_id").agg(status.alias("status"))


def cited_evidence(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations in order with their evidence; ``citation_only`` where none was captured."""
    return citations.join(evidence, "evidence_id", "left").withColumn("citation_only", F.col("evidence_text").isNull())


def citing_findings(citations: DataFrame) -> DataFrame:
    """Per evidence the findings that cite it, in order of first citation."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "finding_id")))
    return citations.groupBy("evidence_id").agg(F.array_distinct(F.transform(ordered, lambda x: x["finding_id"])).alias("findings"))


def route_precision(judged: DataFrame) -> DataFrame:
    """Relevant over returned documents by symbol and topic, by symbol, and in all; no documents give 0."""
    n = F.sum("documents")
    return judged.rollup("symbol", "topic").agg(F.sum("relevant").alias("relevant"), n.alias("documents"), F.when(n > 0, F.sum("relevant") / n).otherwise(0.0).alias("precision"))
