"""What an application reports of itself: events of a fixed schema, and the tokens its answers say they used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

# Fixed values.
EVENT_TYPES = ["research_completed", "research_failed", "followup_completed", "followup_failed", "feedback_submitted"]
MODES = ["single_company", "comparison"]
FEEDBACK = ["helpful", "needs_work"]
LABELS = ["report_status", "synthesis_mode", "error_type"]
COUNTS = {"market_window_sessions": 1, "evidence_count": 0, "duration_ms": 0, "question_length": 0, "turn_count": 0, "source_count": 0}
MOST_SYMBOLS, LONGEST_LABEL, SCHEMA_VERSION = 2, 100, 1

EVENT = StructType(
    [StructField("event_type", StringType(), False), StructField("mode", StringType()), StructField("symbols", ArrayType(StringType()))]
    + [StructField(c, LongType()) for c in COUNTS]
    + [StructField(c, StringType()) for c in LABELS]
    + [StructField("limitation_present", BooleanType()), StructField("feedback", StringType())]
)


def event_faults(events: DataFrame) -> DataFrame:
    """Adds ``faults``: names of the fields of an event that break the schema; columns that ``events`` lacks are null."""
    have = set(events.columns)
    field = lambda c: F.col(c) if c in have else F.lit(None).cast(EVENT[c].dataType)
    no, yes = F.lit(False), F.lit(True)
    # Each says where its field is sound; null, where a field is absent, is sound unless the field is needed.
    rules: dict[str, Column] = {
        "event_type": F.coalesce(field("event_type").isin(EVENT_TYPES), no),
        "mode": F.coalesce(field("mode").isin(MODES), yes),
        "symbols": F.coalesce(F.size(F.coalesce(field("symbols"), F.array().cast("array<string>"))) <= MOST_SYMBOLS, yes) & ~F.coalesce(F.exists(field("symbols"), lambda s: s.isNull() | (F.trim(s) == "")), no),
        **{c: F.coalesce(field(c) >= least, yes) for c, least in COUNTS.items()},
        **{c: F.coalesce(F.length(F.trim(field(c))).between(1, LONGEST_LABEL), yes) for c in LABELS},
        "feedback": F.coalesce(field("feedback").isin(FEEDBACK), F.coalesce(field("event_type") != "feedback_submitted", yes) & field("feedback").isNull()),
    }
    return events.withColumn("faults", F.array_compact(F.array(*[F.when(~ok, F.lit(c)) for c, ok in rules.items()])))


def event_line(events: DataFrame) -> Column:
    """One JSON object with the version of the schema and the fields of it that are set; no other column of ``events`` is in it."""
    have = [c for c in EVENT.names if c in events.columns]
    listed = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda s: F.upper(F.trim(s)))).alias(c) if c == "symbols" else F.col(c)
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *[listed(c) for c in have]))


# What services call the tokens read, written, and both.
TOKEN_NAMES = {"input_tokens": ["prompt_tokens", "input_tokens"], "output_tokens": ["completion_tokens", "output_tokens"], "total_tokens": ["total_tokens"]}


def token_usage(answers: DataFrame, json_col: str) -> DataFrame:
    """Adds usage_shape, usage_rule and the three counts, read from ``usage`` of an answer's JSON by the rule that its shape selects.

    The shape is the schema of ``usage`` as it stands in that answer; the rule names the
    fields that count, or is ``unknown``: then, as where a count is negative, none is
    given. Only whole numbers count: not text that looks like one, not true or false.
    """
    usage = F.try_variant_get(F.try_parse_json(json_col), "$.usage", "variant")
    rows = answers.withColumn("_usage", usage)
    part = lambda name: F.try_variant_get("_usage", f"$.{name}", "variant")
    whole = {n: (F.schema_of_variant(part(n)) == "BIGINT") & (F.try_variant_get("_usage", f"$.{n}", "bigint") >= 0) for names in TOKEN_NAMES.values() for n in names}
    # The first name that holds a whole number, by the shape.
    chosen = {c: F.coalesce(*[F.when(whole[n], F.lit(n)) for n in names]) for c, names in TOKEN_NAMES.items()}
    rows = rows.withColumns({f"_{c}": name for c, name in chosen.items()})
    found = F.col("_input_tokens").isNotNull() & F.col("_output_tokens").isNotNull() & F.col("_total_tokens").isNotNull()
    count = lambda c: F.when(found, F.coalesce(*[F.when(F.col(f"_{c}") == n, F.try_variant_get("_usage", f"$.{n}", "bigint")) for n in TOKEN_NAMES[c]])).alias(c)
    rule = F.when(found, F.concat_ws("+", *[f"_{c}" for c in TOKEN_NAMES])).otherwise("unknown")
    return rows.select(*answers.columns, F.schema_of_variant("_usage").alias("usage_shape"), rule.alias("usage_rule"), *[count(c) for c in TOKEN_NAMES])


def usage_shapes(used: DataFrame) -> DataFrame:
    """Of each shape of ``token_usage``: its fingerprint, its rule, answers, and the tokens they add up to; shapes without a rule show what to learn next."""
    print_ = F.sha2(F.coalesce("usage_shape", F.lit("")), 256).alias("fingerprint")
    return used.groupBy(print_, "usage_shape", "usage_rule").agg(F.count(F.lit(1)).alias("answers"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
