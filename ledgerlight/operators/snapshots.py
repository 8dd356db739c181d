"""From raw responses to the tables of a snapshot, with counters of what became of every row.

Nothing is dropped unseen: a row is rejected (with issues), out of scope, a repeat,
superseded or current. ``faults`` are what must keep a snapshot from being published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.operators import validate, versions
from ledgerlight.sources import envelopes

# The request settings of the product.
BAR_SETTINGS = {"feed": "sip", "adjustment": "split", "timeframe": "1Day", "currency": "USD"}


def request_issues(request: Column) -> Column:
    """Codes of what a request's JSON lacks: settings, or a list of unique nonblank symbols."""
    says = lambda name: F.nullif(T.strip(F.get_json_object(request, f"$.{name}")), F.lit(""))
    rules = {name: says(name).isNotNull() for name in BAR_SETTINGS}
    rules["symbols"] = T.unique_list(says("symbols")).isNotNull()
    return F.array_compact(F.array(*[F.when(~sound, F.lit(f"request_{name}")) for name, sound in rules.items()]))


def is_wanted_request(request: Column) -> Column:
    """Whether a request asked for the product's own settings."""
    wanted = F.lit(True)
    for name, value in BAR_SETTINGS.items():
        wanted = wanted & F.coalesce(F.get_json_object(request, f"$.{name}") == value, F.lit(False))
    return wanted


def asked_symbols(request: Column) -> Column:
    return T.unique_list(F.get_json_object(request, "$.symbols"))


def price_rows(responses: DataFrame, configured: list[str]) -> DataFrame:
    """Every bar of ``responses`` (see ``sources.envelopes.ENVELOPE``) with its issues and its state: rejected, out_of_scope or accepted.

    Bars of another product's request or of a symbol that is not configured are out of scope.
    """
    wanted = responses.select("source_response_id", "source_system", "request_parameters_json")
    rows = validate.validate_bars(envelopes.bars_of(responses)).join(wanted, "source_response_id")
    scoped = is_wanted_request(F.col("request_parameters_json")) & F.col("symbol").isin(configured)
    state = F.when(~scoped, "out_of_scope").when(F.size("issues") > 0, "rejected").otherwise("accepted")
    return rows.withColumn("state", state).drop("request_parameters_json")


def price_snapshot(responses: DataFrame, configured: list[str]) -> tuple[DataFrame, DataFrame]:
    """(current bar of each symbol and day, one row of counters)."""
    rows = price_rows(responses, configured)
    kept = rows.filter("state = 'accepted'").select("source_system", "symbol", "trading_date", "bar_timestamp", "open", "high", "low", "close", "volume", "fetched_at", "source_response_id", "ingestion_run_id")
    content = ["bar_timestamp", "open", "high", "low", "close", "volume"]
    current = versions.current_versions(kept, ["source_system", "symbol", "trading_date"], "fetched_at", content, "source_response_id")
    return current, _counters(responses, rows, current)


def _counters(responses: DataFrame, rows: DataFrame, current: DataFrame) -> DataFrame:
    """One row: responses, rows by state, what version selection made of the accepted, and conflicts."""
    n = F.count(F.lit(1))
    states = rows.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "rejected", "out_of_scope")])
    made = current.agg(n.alias("current"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("duplicates", "superseded", "conflicts")])
    return responses.agg(n.alias("responses")).crossJoin(states).crossJoin(made)  # three single rows


def news_snapshot(responses: DataFrame, configured: list[str]) -> tuple[DataFrame, DataFrame]:
    """(current articles in scope, one row of counters).

    Scope is judged after version selection: a revision that drops the last configured
    symbol takes the article out, whatever older versions said.
    """
    rows = validate.validate_articles(envelopes.articles_of(responses), configured)
    rows = rows.withColumn("state", F.when(F.size("issues") > 0, "rejected").otherwise("accepted"))
    kept = rows.filter("state = 'accepted'").select("source_system", "article_id", "headline", "symbols", "configured_symbols", "created_at", "updated_at", "source", "url", "summary", "content", "fetched_at", "ingestion_run_id", "source_response_id")
    content = ["headline", "symbols", "created_at", "source", "url", "summary", "content"]
    latest = versions.earliest_of_latest(kept, ["source_system", "article_id"], "updated_at", content, ["fetched_at", "ingestion_run_id", "source_response_id"], sets=["symbols"])
    scoped = F.size("configured_symbols") > 0
    states = rows.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "rejected")])
    made = latest.agg(F.count_if(scoped).alias("current"), F.count_if(~scoped).alias("out_of_scope"), F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("superseded"), F.lit(0)).alias("superseded"), F.count_if("conflict").alias("conflicts"))
    return latest.filter(scoped), responses.agg(F.count(F.lit(1)).alias("responses")).crossJoin(states).crossJoin(made)


def facts_snapshot(responses: DataFrame, concepts: list[str], instant_concepts: list[str], configured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of each company's latest response, one row of counters). ``configured``: cik. Equal facts collapse; differing ones are conflicts."""
    parsed = F.try_parse_json("response_payload_json")
    cik = F.lpad(F.coalesce(F.try_variant_get(parsed, "$.cik", "bigint").cast("string"), F.lit("")), 10, "0")
    latest = versions.latest_responses(responses.withColumn("cik", cik), "cik", configured)
    rows = validate.validate_facts(envelopes.facts_of(latest.filter("in_scope"), concepts), instant_concepts)
    rows = rows.withColumn("state", F.when(F.size("issues") > 0, "rejected").otherwise("accepted"))
    key = ["cik", "concept", "accession_number", "period_start", "period_end", "filing_form", "filing_date"]
    facts = versions.collapse_repeats(rows.filter("state = 'accepted'").select(*key, "fact_value", "fiscal_year", "source_response_id", "fetched_at"), key, ["fact_value", "fiscal_year"], ["source_response_id"])
    states = rows.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "rejected")])
    made = facts.agg(F.count(F.lit(1)).alias("current"), F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicates"), F.count_if("conflict").alias("conflicts"))
    chosen = latest.agg(F.sum("superseded").alias("superseded"), F.sum("tie_repeats").alias("tie_repeats"), F.count_if(~F.col("in_scope")).alias("out_of_scope"), F.count_if(F.col("tie_conflict") | F.col("repeated_id")).alias("response_faults"))
    return facts, chosen.crossJoin(states).crossJoin(made)


def concept_availability(responses: DataFrame, concepts: list[str], taxonomy: str = "us-gaap", unit: str = "USD") -> DataFrame:
    """Per response and concept: available, unavailable (the path is not there) or wrong_type (something else than a list stands there)."""
    parsed = F.try_parse_json("response_payload_json")

    def state(concept: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(parsed, f"$.facts['{taxonomy}'].{concept}.units.{unit}", "variant"))
        return F.when(found.isNull() | (found == "VOID"), "unavailable").when(found.startswith("ARRAY"), "available").otherwise("wrong_type")

    listed = F.array(*[F.struct(F.lit(c).alias("concept"), state(c).alias("state")) for c in concepts])
    return responses.select("source_response_id", F.inline(listed))


def facts_in_config(facts: DataFrame, configured: DataFrame) -> DataFrame:
    """Facts with their configured symbol; ``fault`` where the CIK is not configured or the symbol is another's. ``configured``: project_symbol, cik."""
    known = configured.select("cik", F.col("project_symbol").alias("_symbol"))
    fault = F.when(F.col("_symbol").isNull(), "unknown_cik").when(F.col("_symbol") != F.col("project_symbol"), "other_symbol")
    return facts.join(known, "cik", "left").withColumn("fault", fault).drop("_symbol")


def in_both(observed: DataFrame, configured: DataFrame, key: str) -> DataFrame:
    """Entities of either side with what is wrong: unexpected (not configured) or missing (not observed); null where both have it."""
    a, b = observed.select(key).distinct().withColumn("_a", F.lit(True)), configured.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_b").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").alias("problem"))
