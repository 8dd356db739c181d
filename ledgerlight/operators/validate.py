"""Row validators: each adds ``issues``, an array of (code, field); a row without any is accepted.

All problems of a row are collected. Raw fields come as ``variant`` values, so that
a number, a text that looks like one and a boolean stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.functions.decimals import exact
from ledgerlight.functions.times import instant, market_date

_NUMERIC = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _issue(broken: Column, code: str, field: str) -> Column:
    """The issue, or null where it is not so (or not known)."""
    return F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))


def _absent(v: Column) -> Column:
    return v.isNull() | (F.schema_of_variant(v) == "VOID")


def as_text(v: Column) -> Column:
    """A variant that holds a text, stripped; null for anything else or a blank."""
    return F.when(F.schema_of_variant(v) == "STRING", T.nonblank(F.try_variant_get(v, "$", "string")))


def as_number(v: Column, precision: int, scale: int) -> Column:
    """A variant that holds a number which fits exactly; null for anything else."""
    return F.when(F.schema_of_variant(v).rlike(_NUMERIC), exact(F.try_variant_get(v, "$", "string"), precision, scale))


def _text_issue(v: Column, code: str, field: str, optional: bool = False) -> Column:
    """A text that is missing, blank or none at all; one that is ``optional`` may be missing or blank."""
    if optional:
        return _issue(~_absent(v) & (F.schema_of_variant(v) != "STRING"), code, field)
    return _issue(as_text(v).isNull(), code, field)


def _bar_number_issue(v: Column, field: str) -> Column:
    kind, value = F.schema_of_variant(v), as_number(v, 20, 8)
    code = F.when(_absent(v), "required_field").when(kind.startswith("OBJECT<nonfinite"), "nonfinite").when(~kind.rlike(_NUMERIC), "numeric_type").when(value.isNull(), "decimal_20_8").when(value <= 0, "not_positive")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(field).alias("field")))


def validate_bars(bars: DataFrame) -> DataFrame:
    """``bars``: symbol, bar (variant with t, o, h, l, c, v), fetched_at. Adds typed columns and issues."""
    field = lambda name: F.try_variant_get("bar", f"$.{name}", "variant")
    names = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}
    rows = bars.withColumn("bar_timestamp", instant(as_text(field("t")))).withColumns({n: as_number(field(k), 20, 8) for n, k in names.items()})
    rows = rows.withColumn("trading_date", market_date(F.col("bar_timestamp")))
    issues = [
        _issue(_absent(field("t")), "required_field", "bar_timestamp"),
        _issue(~_absent(field("t")) & F.col("bar_timestamp").isNull(), "invalid_timestamp", "bar_timestamp"),
        *[_bar_number_issue(field(k), n) for n, k in names.items()],
        *[_issue(~F.col(n).between(F.col("low"), F.col("high")), "outside_low_high", n) for n in ("open", "close")],
        _issue(F.col("trading_date") >= market_date(F.col("fetched_at")), "incomplete_trading_day", "trading_date"),
    ]
    return rows.withColumn("issues", F.array_compact(F.array(*issues)))


def _time_issues(v: Column, field: str) -> list[Column]:
    said = as_text(v)
    naive = said.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$") & said.try_cast("timestamp_ntz").isNotNull()
    none = F.coalesce(naive, F.lit(False))
    return [_issue(none, "timezone_required", field), _issue(instant(said).isNull() & ~none, "invalid_timestamp", field)]


def validate_articles(articles: DataFrame, configured: list[str]) -> DataFrame:
    """``articles``: article (variant), fetched_at. Adds typed columns, configured_symbols (in the order of ``configured``) and issues."""
    field = lambda name: F.try_variant_get("article", f"$.{name}", "variant")
    kind = lambda name: F.schema_of_variant(field(name))
    rows = articles.withColumns(
        {
            "article_id": F.when(kind("id") == "BIGINT", F.try_variant_get("article", "$.id", "bigint")),
            **{n: as_text(field(n)) for n in ("headline", "source", "url", "summary", "content")},
            "created_at": instant(as_text(field("created_at"))),
            "updated_at": instant(as_text(field("updated_at"))),
            "symbols": F.when(kind("symbols").startswith("ARRAY"), F.transform(F.try_variant_get("article", "$.symbols", "array<variant>"), as_text)),
        }
    )
    none = F.array().cast("array<string>")
    rows = rows.withColumn("configured_symbols", F.array_intersect(F.array(*[F.lit(s) for s in configured]).cast("array<string>"), F.coalesce("symbols", none)))
    issues = [
        _issue(~F.coalesce(F.col("article_id") > 0, F.lit(False)), "invalid_article_id", "id"),
        *[_text_issue(field(n), "invalid_required_string", n) for n in ("headline", "source", "url")],
        _issue(F.col("url").isNotNull() & ~T.plain_web_url(F.col("url")), "invalid_citation_url", "url"),
        *[_text_issue(field(n), "invalid_optional_string", n, optional=True) for n in ("summary", "content")],
        *_time_issues(field("created_at"), "created_at"),
        *_time_issues(field("updated_at"), "updated_at"),
        _issue(F.col("created_at") > F.col("updated_at"), "created_after_updated", "created_at"),
        _issue(F.col("updated_at") > F.col("fetched_at"), "updated_after_fetched", "updated_at"),
        _issue(F.col("symbols").isNull(), "invalid_symbols", "symbols"),
        _issue(F.exists(F.coalesce("symbols", none), lambda s: s.isNull()), "invalid_symbol_tag", "symbols"),
    ]
    return rows.withColumn("issues", F.array_compact(F.array(*issues)))


def validate_facts(facts: DataFrame, instant_concepts: list[str]) -> DataFrame:
    """``facts``: concept, observation (variant with start, end, val, accn, fy, fp, form, filed, frame). Adds typed columns and issues."""
    field = lambda name: F.try_variant_get("observation", f"$.{name}", "variant")
    day = lambda name: F.try_to_date(as_text(field(name)), "yyyy-MM-dd")
    kind = lambda name: F.schema_of_variant(field(name))
    is_instant = F.col("concept").isin(*instant_concepts) if instant_concepts else F.lit(False)
    rows = facts.withColumns(
        {
            "period_start": F.when(~is_instant, day("start")),
            "period_end": day("end"),
            "filing_date": day("filed"),
            "fact_value": as_number(field("val"), 28, 8),
            "accession_number": as_text(field("accn")),
            "filing_form": as_text(field("form")),
            "fiscal_year": F.when(kind("fy") == "BIGINT", F.try_variant_get("observation", "$.fy", "int")),
            "fiscal_period": as_text(field("fp")),
            "frame": as_text(field("frame")),
        }
    )
    there = F.coalesce(F.schema_of_variant("observation").startswith("OBJECT"), F.lit(False))
    number = F.coalesce(kind("val").rlike(_NUMERIC), F.lit(False))
    wide = F.try_variant_get("observation", "$.val", "string").try_cast("decimal(38,18)")
    too_fine = number & F.col("fact_value").isNull() & F.coalesce(wide != F.round(wide, 8), F.lit(False))
    issues = [
        _text_issue(field("accn"), "missing_or_invalid_required_string", "accn"),
        _issue(~T.matches(F.col("accession_number"), T.ACCESSION), "invalid_accession_number", "accn"),
        _issue(~number, "invalid_fact_value", "val"),
        _issue(too_fine, "fact_value_exceeds_scale", "val"),
        _issue(number & F.col("fact_value").isNull() & ~too_fine, "fact_value_out_of_range", "val"),
        _issue(F.col("period_end").isNull(), "missing_or_invalid_date", "end"),
        _issue(~is_instant & F.col("period_start").isNull(), "missing_or_invalid_date", "start"),
        _issue(F.col("period_start") > F.col("period_end"), "period_start_after_end", "start"),
        _issue(is_instant & ~_absent(field("start")), "unexpected_start_for_instant_fact", "start"),
        _text_issue(field("form"), "missing_or_invalid_required_string", "form"),
        _issue(F.col("filing_date").isNull(), "missing_or_invalid_date", "filed"),
        _issue(~_absent(field("fy")) & (kind("fy") != "BIGINT"), "invalid_optional_integer", "fy"),
        *[_text_issue(field(n), "invalid_optional_string", n, optional=True) for n in ("fp", "frame")],
    ]
    return rows.withColumn("issues", F.when(there, F.array_compact(F.array(*issues))).otherwise(F.array(_issue(F.lit(True), "observation_not_object", "observation"))))


def split_accepted(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their issues)."""
    return validated.filter(F.size("issues") == 0).drop("issues"), validated.filter(F.size("issues") > 0)


def issue_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.inline("issues")).groupBy("code", "field").agg(F.count(F.lit(1)).alias("n"))
