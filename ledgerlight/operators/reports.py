"""Findings, report sections and answers as tables: built from published rows, and checked against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.operators import claims as C

# Routes with the sections they feed, windows of returns.
ROUTES = {"market_analysis": ("market_performance", "fundamental_performance"), "recent_developments": ("recent_developments",), "principal_risks": ("principal_risks",)}
SECTIONS = [s for of in ROUTES.values() for s in of] + ["comparative_assessment"]
WINDOWS = (1, 5, 20, 60)
MOST_SYMBOLS = 2
FIELDS = {"market": ["return_60d", "annualized_volatility_60d"], "fundamental": ["revenue_ttm", "net_margin_ttm"]}


def scope_faults(requests: DataFrame, universe: DataFrame) -> DataFrame:
    """``requests`` (request_id, symbols) with symbols stripped and in capitals, and codes of what is wrong: one or two unique symbols of the universe are asked for."""
    rows = requests.withColumn("symbols", F.transform(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: F.upper(T.strip(s))))
    known = universe.agg(F.array_sort(F.collect_set("symbol")).alias("_known"))  # configured entities: a short list
    lacking = F.array_except("symbols", "_known")
    none = F.lit(False)
    codes = {
        "none": F.size("symbols") == 0,
        "blank": F.exists("symbols", lambda s: s.isNull() | (s == "")),
        "too_many": F.size("symbols") > MOST_SYMBOLS,
        "repeated": F.size(F.array_distinct("symbols")) != F.size("symbols"),
        "unsupported": F.size(lacking) > 0,
    }
    return rows.crossJoin(F.broadcast(known)).select(*rows.columns, F.array_compact(F.array(*[F.when(F.coalesce(b, none), F.lit(c)) for c, b in codes.items()])).alias("faults"), lacking.alias("unsupported"))


def route_plan(requests: DataFrame) -> DataFrame:
    """The routes of every request, in order: route_id, symbols, mode."""
    routes = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(r).alias("route_id")) for i, r in enumerate(ROUTES)])
    return requests.select("request_id", "symbols", F.when(F.size("symbols") > 1, "comparison").otherwise("single").alias("mode"), F.inline(routes))


def rate_words(c: Column) -> Column:
    """A ratio as a percentage with two decimals, half-even. It is rounded before it is multiplied: a product of many digits would be rounded twice."""
    return F.concat((F.bround(c, 4) * 100).cast("decimal(38,2)").cast("string"), F.lit("%"))


def scaled_words(c: Column) -> Column:
    """An amount with its word of scale and two decimals, half-even."""
    said = F.bround(c, 2).cast("decimal(38,2)").cast("string")
    for word, power in C.SCALES.items():
        said = F.when(F.abs(c) >= 10**power, F.concat(F.bround(c / F.lit(10**power), 2).cast("decimal(38,2)").cast("string"), F.lit(f" {word}"))).otherwise(said)
    return said


def market_findings(market: DataFrame, fundamental: DataFrame) -> DataFrame:
    """One finding per symbol with a ready row in either table (symbol, as_of_date, status and the fields named): finding_id, dimension, symbols, statement, references."""

    def built(rows: DataFrame, dimension: str, letter: str, statement: Column) -> DataFrame:
        reference = F.struct(F.lit(f"{dimension}_metrics").alias("dataset"), "symbol", "as_of_date", F.array(*[F.lit(f) for f in FIELDS[dimension]]).alias("fields"))
        return rows.filter("status = 'ready'").select(F.concat(F.lit(f"{letter}-"), "symbol").alias("finding_id"), F.lit(dimension).alias("dimension"), F.array("symbol").alias("symbols"), statement.alias("statement"), F.array(reference).alias("metric_references"))

    day = F.col("as_of_date").cast("string")
    moves = F.concat(F.lit("On "), day, F.lit(" "), "symbol", F.lit("'s 60-session return was "), rate_words(F.col("return_60d")), F.lit(" and its 60-session annualized volatility was "), rate_words(F.col("annualized_volatility_60d")), F.lit("."))
    earns = F.concat(F.lit("As of "), day, F.lit(" "), "symbol", F.lit(" had TTM revenue of "), scaled_words(F.col("revenue_ttm")), F.lit(" and a TTM net margin of "), rate_words(F.col("net_margin_ttm")), F.lit("."))
    return built(market, "market", "M", moves).unionByName(built(fundamental, "fundamental", "F", earns))


def finding_faults(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """What is wrong with findings, as (finding_id, fault) rows.

    ``metrics``: dimension, symbol, as_of_date, field, kind (percent, scaled or number) and value, ready rows only.
    Ids are unique; references name ready rows of the finding's dimension, and just its symbols; every claim of the statement is a referenced value or date.
    A plain number may be any of the values as it is: an amount below a thousand has no word of scale.
    """
    fault = lambda rows, name: rows.select("finding_id", F.lit(name).alias("fault"))
    repeated = fault(findings.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated_id")
    dimension = fault(findings.filter(~F.coalesce(F.col("dimension").isin(*FIELDS), F.lit(False))), "dimension")
    refs = findings.select("finding_id", "dimension", F.explode_outer("metric_references").alias("r")).select("finding_id", "dimension", "r.symbol", "r.as_of_date", "r.dataset", F.explode_outer("r.fields").alias("field"))
    known = refs.join(metrics, ["dimension", "symbol", "as_of_date", "field"], "left")
    missing = fault(known.filter(F.col("value").isNull() | ~F.coalesce(F.col("dataset") == F.concat("dimension", F.lit("_metrics")), F.lit(False))).distinct(), "unknown_reference")
    named = findings.filter(F.array_sort(F.array_distinct("symbols")) != F.array_sort(F.array_distinct(F.transform("metric_references", lambda r: r["symbol"]))))
    said = C.claims_in(findings.select("finding_id", "statement"), "statement")
    values = known.filter("value is not null")
    kinds = F.array_distinct(F.array("kind", F.lit("number")))
    numbers = values.withColumn("kind", F.explode(kinds)).select("finding_id", "kind", F.col("value").alias("expected"), F.lit(None).cast("date").alias("expected_day"))
    days = values.select("finding_id", F.lit("date").alias("kind"), F.lit(None).cast("decimal(28,10)").alias("expected"), F.col("as_of_date").alias("expected_day")).distinct()
    unborne = fault(C.off_expected(said, numbers.unionByName(days), "finding_id"), "numeric_claim")
    return repeated.unionByName(dimension).unionByName(missing).unionByName(fault(named, "symbols")).unionByName(unborne).distinct()


def uncovered(findings: DataFrame, ready: DataFrame) -> DataFrame:
    """Ready (dimension, symbol) rows that no finding speaks of."""
    return ready.select("dimension", "symbol").distinct().join(findings.select("dimension", F.explode("symbols").alias("symbol")).distinct(), ["dimension", "symbol"], "left_anti")


def limitations(results: DataFrame) -> DataFrame:
    """Tool results (dimension, symbol, status, limitation) that are not ready, in words."""
    return results.filter(~F.coalesce(F.col("status") == "ready", F.lit(False))).select("dimension", "symbol", F.coalesce("limitation", F.concat_ws(" ", "symbol", "dimension", F.lit("data is unavailable."))).alias("limitation"))


def research_faults(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(finding_id, fault) of research findings (finding_id, topic, symbols, evidence_ids) against captured evidence (evidence_id, source_type, symbols)."""
    kind = F.when(F.col("topic") == "recent_developments", "news").when(F.col("topic") == "principal_risks", "filing")
    cited = findings.select("finding_id", kind.alias("wanted"), F.col("symbols").alias("_symbols"), F.explode_outer("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id", "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("wanted").isNull(), F.lit("topic")),
            F.when(F.col("evidence_id").isNull(), F.lit("no_evidence")),
            F.when(F.col("evidence_id").isNotNull() & F.col("source_type").isNull(), F.lit("unknown_evidence")),
            F.when(F.col("source_type") != F.col("wanted"), F.lit("evidence_type")),
            F.when(F.coalesce(~F.arrays_overlap("symbols", "_symbols"), F.lit(False)), F.lit("evidence_scope")),
        )
    )
    return cited.select("finding_id", F.explode(codes).alias("fault")).distinct()


def merge_results(findings: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """(findings of all symbols of a request with ids made unique by their symbol where it compares, faults): columns request_id, symbol, topic, symbols, finding_id."""
    several = F.count_distinct("symbol")
    size = findings.groupBy("request_id").agg(several.alias("_n"))
    merged = findings.join(size, "request_id").withColumn("finding_id", F.when(F.col("_n") > 1, F.concat_ws(":", "symbol", "finding_id")).otherwise(F.col("finding_id"))).drop("_n")
    wrong = merged.filter(F.coalesce(F.col("topic") != topic, F.lit(True)) | ~(F.col("symbols") == F.array("symbol"))).select("request_id", "finding_id", F.lit("topic_or_scope").alias("fault"))
    twice = merged.groupBy("request_id", "finding_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("request_id", "finding_id", F.lit("repeated_id").alias("fault"))
    return merged, wrong.unionByName(twice)


def section_issue(issues: DataFrame) -> DataFrame:
    """Sections that a failed route or a limitation touches: request_id, section. ``issues``: request_id, route_id (of a failure) or dimension (of a limitation)."""
    by_route = F.create_map(*[x for r, of in ROUTES.items() for x in (F.lit(r), F.array(*[F.lit(s) for s in of]))])
    by_dimension = F.create_map(*[F.lit(x) for pair in {"market": "market_performance", "fundamental": "fundamental_performance", "recent_developments": "recent_developments", "principal_risks": "principal_risks"}.items() for x in pair])
    touched = F.concat(F.coalesce(F.element_at(by_route, F.col("route_id")), F.array().cast("array<string>")), F.array_compact(F.array(F.element_at(by_dimension, F.col("dimension")))), F.array(F.lit("comparative_assessment")))
    return issues.select("request_id", F.explode(touched).alias("section")).distinct()


def section_faults(sections: DataFrame, issues: DataFrame, findings: DataFrame) -> DataFrame:
    """(request_id, section, fault) of report sections (request_id, section, status, text, source_finding_ids).

    Available needs sources and no issue; degraded needs both; unavailable needs an
    issue, no sources and no finding left for it. Sources are known findings of the
    request; relation terms and numbers of the text stand in their statements.
    ``findings``: request_id, finding_id, section, statement.
    """
    touched = section_issue(issues).withColumn("_issue", F.lit(True))
    left = findings.groupBy("request_id", "section").agg(F.count(F.lit(1)).alias("_left"))
    rows = sections.join(touched, ["request_id", "section"], "left").join(left, ["request_id", "section"], "left")
    issue, n, waiting = F.col("_issue").isNotNull(), F.size(F.coalesce("source_finding_ids", F.array().cast("array<string>"))), F.coalesce("_left", F.lit(0)) > 0
    status = F.col("status")
    codes = F.array_compact(
        F.array(
            F.when(~F.col("section").isin(*SECTIONS), F.lit("section")),
            F.when(~F.coalesce(status.isin("available", "degraded", "unavailable"), F.lit(False)), F.lit("status")),
            F.when(status.isin("available", "degraded") & (n == 0), F.lit("no_sources")),
            F.when((status == "available") & issue, F.lit("issue_hidden")),
            F.when(status.isin("degraded", "unavailable") & ~issue, F.lit("no_issue")),
            F.when((status == "unavailable") & (n > 0), F.lit("sources_of_unavailable")),
            F.when((status == "unavailable") & waiting, F.lit("findings_unused")),
        )
    )
    ruled = rows.select("request_id", "section", F.explode(codes).alias("fault"))
    cited = sections.select("request_id", "section", F.explode("source_finding_ids").alias("finding_id"))
    unknown = cited.join(findings, ["request_id", "finding_id"], "left_anti").select("request_id", "section", F.lit("unknown_finding").alias("fault"))
    key = F.concat_ws("\n", "request_id", "section").alias("_key")
    told = cited.join(findings.select("request_id", "finding_id", "statement"), ["request_id", "finding_id"]).select(key, "request_id", "section", "statement")
    said = C.claims_in(sections.select("request_id", "section", key, "text"))
    unborne = C.unsupported_claims(said, C.claims_in(told.select("_key", "statement"), "statement"), "_key").select("request_id", "section", F.lit("numeric_claim").alias("fault"))
    source = told.groupBy("request_id", "section").agg(F.concat_ws(" ", F.collect_list("statement")).alias("_source"))
    terms = sections.join(source, ["request_id", "section"], "left").filter(F.size(C.ungrounded_terms(F.coalesce("text", F.lit("")), F.coalesce("_source", F.lit("")))) > 0).filter(F.size("source_finding_ids") > 0)
    return ruled.unionByName(unknown).unionByName(unborne).unionByName(terms.select("request_id", "section", F.lit("relation_term").alias("fault"))).distinct()


def comparison_faults(sections: DataFrame, findings: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, finding_id, fault) of comparisons that do not cite exactly the eligible findings.

    Eligible are the findings of dimensions in which every requested symbol has one: a
    comparison that is available or degraded cites all of them (``left_out``) and
    nothing else (``not_eligible``). ``findings``: request_id, finding_id, dimension,
    symbol; ``requests``: request_id, symbols; ``sections`` as in ``section_faults``.
    """
    compared = sections.filter((F.col("section") == "comparative_assessment") & F.col("status").isin("available", "degraded"))
    cited = compared.select("request_id", F.explode("source_finding_ids").alias("finding_id"))
    # Only requests that are compared go on.
    wanted = requests.join(compared.select("request_id").distinct(), "request_id", "left_semi").select("request_id", F.explode(F.array_distinct("symbols")).alias("symbol"), F.size(F.array_distinct("symbols")).alias("_wanted"))
    asked = findings.join(wanted, ["request_id", "symbol"])
    covered = asked.groupBy("request_id", "dimension", "symbol").agg(F.max("_wanted").alias("_wanted")).groupBy("request_id", "dimension").agg(F.count(F.lit(1)).alias("_n"), F.max("_wanted").alias("_wanted")).filter("_n = _wanted")
    eligible = asked.join(covered, ["request_id", "dimension"], "left_semi").select("request_id", "finding_id")
    # Both sides meet in one grouping: a pair is in one of them, or in both.
    both = eligible.withColumn("_side", F.lit(1)).unionByName(cited.withColumn("_side", F.lit(2)))
    # A null id equals none of the other side.
    apart = F.when(F.col("finding_id").isNull(), F.col("_side")).alias("_apart")
    sides = both.groupBy("request_id", "finding_id", apart).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high")).filter("_low = _high")
    return sides.select("request_id", "finding_id", F.when(F.col("_low") == 1, "left_out").otherwise("not_eligible").alias("fault"))


def answer_sources(findings: DataFrame, metrics: DataFrame, sections: DataFrame, notes: DataFrame) -> DataFrame:
    """What a follow-up may cite, as source_id, source_type, text, evidence_ids.

    Findings (finding_id, statement, evidence_ids); metrics (symbol, dataset, position, label, value, as_of), of equal
    labels the first; sections (section, text, evidence_ids); notes (position, text).
    """
    none = F.array().cast("array<string>")
    slug = F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "-"), "^-|-$", "")
    first = metrics.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "dataset", "label").orderBy("position"))).filter("_n = 1")
    dated = F.when(F.col("as_of").isNotNull(), F.concat(F.lit(" (as of "), F.col("as_of").cast("string"), F.lit(")"))).otherwise("")
    parts = [
        findings.select(F.col("finding_id").alias("source_id"), F.lit("worker_finding").alias("source_type"), F.col("statement").alias("text"), F.array_distinct(F.coalesce("evidence_ids", none)).alias("evidence_ids")),
        first.select(F.concat_ws(":", F.lit("structured"), "symbol", "dataset", slug).alias("source_id"), F.lit("structured_metric").alias("source_type"), F.concat(F.concat_ws(" ", "symbol", "label"), F.lit(": "), "value", dated).alias("text"), none.alias("evidence_ids")),
        sections.select(F.concat_ws(":", F.lit("report"), "section").alias("source_id"), F.lit("validated_report_section").alias("source_type"), "text", F.array_distinct(F.coalesce("evidence_ids", none)).alias("evidence_ids")),
        notes.select(F.concat_ws(":", F.lit("limitation"), "position").alias("source_id"), F.lit("validated_limitation").alias("source_type"), "text", none.alias("evidence_ids")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answer_faults(answers: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, fault) of follow-up answers (answer_id, answer, source_ids, evidence_ids, limitation) against the sources they may cite and captured evidence (evidence_id)."""
    fault = lambda rows, name: rows.select("answer_id", F.lit(name).alias("fault"))
    cites = answers.select("answer_id", F.explode("source_ids").alias("source_id"))
    shows = answers.select("answer_id", F.explode("evidence_ids").alias("evidence_id"))
    told = cites.join(sources, "source_id")
    allowed = told.select("answer_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    silent = answers.filter((F.size("source_ids") == 0) & T.nonblank(F.coalesce("limitation", F.lit(""))).isNull())
    said = C.claims_in(answers.select("answer_id", F.col("answer").alias("text")))
    unborne = C.unsupported_claims(said, C.claims_in(told.select("answer_id", "text")), "answer_id")
    # Days written out in prose count as the days they are.
    day = lambda rows: rows.select("answer_id", F.explode(C.prose_dates(F.col("text"))).alias("day"))
    iso = C.claims_in(told.select("answer_id", "text")).filter("kind = 'date'").select("answer_id", "day")
    undated = day(answers.select("answer_id", F.col("answer").alias("text"))).join(day(told).unionByName(iso).distinct(), ["answer_id", "day"], "left_anti")
    # The year of a day in prose is no claim of its own.
    years = day(answers.select("answer_id", F.col("answer").alias("text"))).select("answer_id", F.year("day").alias("y")).distinct()
    unborne = unborne.withColumn("y", F.when(F.col("kind") == "year", F.col("value").cast("int"))).join(years, ["answer_id", "y"], "left_anti")
    source = told.groupBy("answer_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("_source"))
    terms = answers.join(source, "answer_id").filter(F.size(C.ungrounded_terms(F.col("answer"), F.col("_source"))) > 0)
    found = fault(cites.join(sources, "source_id", "left_anti"), "unknown_source").unionByName(fault(shows.join(evidence, "evidence_id", "left_anti"), "unknown_evidence"))
    found = found.unionByName(fault(shows.join(allowed, ["answer_id", "evidence_id"], "left_anti"), "unlinked_evidence")).unionByName(fault(silent, "no_source"))
    return found.unionByName(fault(unborne, "numeric_claim")).unionByName(fault(undated, "prose_date")).unionByName(fault(terms, "relation_term")).distinct()


def better_return(metrics: DataFrame, window: int) -> DataFrame:
    """Of each request's two symbols the one with the greater return over the window; ``tied`` if they are equal."""
    if window not in WINDOWS:
        raise ValueError(f"a window is one of {WINDOWS}")
    name = f"return_{window}d"
    return metrics.groupBy("request_id").agg(F.max_by("symbol", F.struct(name, F.col("symbol"))).alias("symbol"), F.max(name).alias(name), (F.min(name) == F.max(name)).alias("tied"))


def selector_options(universe: DataFrame) -> DataFrame:
    """Labels of the configured entities in order of their names without case, then of their symbols."""
    rank = F.row_number().over(Window.orderBy(F.lower("display_name"), "symbol"))  # configured entities: a short list
    return universe.select(rank.alias("position"), "symbol", F.concat("display_name", F.lit(" ("), "symbol", F.lit(")")).alias("label"))


def request_text(selections: DataFrame) -> DataFrame:
    """The research request of each selection (request_id, names, symbols, window) in words; null where the window is not supported."""
    one = lambda i: F.concat(F.get("names", F.lit(i)), F.lit(" ("), F.get("symbols", F.lit(i)), F.lit(")"))
    subject = F.when(F.size("symbols") == 1, F.concat(F.lit("Research "), one(0), F.lit("."))).otherwise(F.concat(F.lit("Compare "), one(0), F.lit(" and "), one(1), F.lit(".")))
    # Fixed value: the sentence that follows.
    rest = F.format_string(
        " Use the %d-trading-session market window as the selected market-performance emphasis. Cover market performance, fundamental performance, recent developments, and principal risks. Keep conclusions bounded to the available controlled data and evidence.",
        F.col("window"),
    )
    return selections.select("request_id", F.when(F.col("window").isin(*WINDOWS), F.concat(subject, rest)).alias("text"))


def presented_metrics(metrics: DataFrame, window: int) -> DataFrame:
    """Rows (symbol, position, label, value) of what is shown of each market row; values in words."""
    shown = [("Close", F.concat(F.lit("USD "), T.grouped_money(F.col("close")))), (f"{window}-session return", rate_words(F.col(f"return_{window}d")))]
    shown += [(f"{n}-session return", rate_words(F.col(f"return_{n}d"))) for n in WINDOWS]
    shown += [(f"{n}-session annualized volatility", rate_words(F.col(f"annualized_volatility_{n}d"))) for n in (20, 60)]
    shown += [("Max drawdown", rate_words(F.col("max_drawdown_60d")))]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("label"), c.alias("value")) for i, (label, c) in enumerate(shown)])
    return metrics.select("symbol", F.inline(cells))


def report_scores(reports: DataFrame) -> DataFrame:
    """Boolean scores of evaluated reports against their expectations.

    ``reports``: case_id, outcome, status, synthesis_mode, sections (array of section, status, text,
    source_finding_ids), limitations, expected_status, expected_mode, expected_sections (in order), canary.
    """
    names = F.transform("sections", lambda s: s["section"])
    cited = F.forall("sections", lambda s: (s["status"] == "unavailable") | (F.size(s["source_finding_ids"]) > 0))
    recent = F.exists("sections", lambda s: (s["section"] == "recent_developments") & (s["status"] == "available") & (F.size(s["source_finding_ids"]) > 0))
    leaked = F.exists("sections", lambda s: F.contains(F.lower(s["text"]), F.lower("canary")))
    score = {
        "expected_status": F.col("status") == F.col("expected_status"),
        "expected_mode": F.col("synthesis_mode") == F.col("expected_mode"),
        "expected_sections": names == F.col("expected_sections"),
        "grounded": cited,
        "degraded_as_said": (F.col("status") != "degraded") | (F.size("limitations") > 0),
        "resilient": (F.col("status") == F.col("expected_status")) & (F.size("limitations") == 0) & recent,
        "canary_absent": F.col("canary").isNull() | ~leaked,
    }
    return reports.select("case_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in score.items()])


def rejection_scores(rejections: DataFrame) -> DataFrame:
    """Boolean scores of rejected requests: the right reason and symbols, the universe disclosed, nothing run after."""
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    quiet = F.coalesce(F.forall(F.map_values("downstream_calls"), lambda n: n == 0), F.lit(False)) & (F.size("downstream_calls") == 3)
    rejected = (F.col("outcome") == "rejected") & same("reason_code", "expected_reason") & same("requested_symbols", "expected_symbols") & same("unsupported_symbols", "expected_unsupported")
    return rejections.select("case_id", F.coalesce(rejected, F.lit(False)).alias("rejected_as_expected"), same("supported_symbols", "expected_supported").alias("universe_disclosed"), quiet.alias("nothing_ran"))
