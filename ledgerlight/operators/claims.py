"""Numeric claims in statements, and whether their sources bear them out.

A claim is a struct of kind (date, percent, scaled, number, year), raw, value,
precision (decimals written), scale (the word of scale) and day (of a date). Texts are read once.
"""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlight.functions.decimals import bound
from ledgerlight.functions.text import any_pattern
from ledgerlight.operators.bands import band_join

# The form of a number that claims something, words that relate quantities, words of scale, dashes, months, and topics that are no developments.
NUMBER_CLAIM = r"(?i)(?<![A-Za-z0-9_])([$€£]?\s*[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?\s*(?:thousand|million|billion|trillion)?\s*(?:%|percent\b)?)"
RELATION_TERMS = ["above", "below", "higher", "lower", "larger", "smaller", "strong", "weak", "stronger", "weaker", "better", "worse", "outperformed", "underperformed"]
SCALES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
DASHES = "\u2212\u2010\u2011\u2013\u2014"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
NOISE = [
    r"\brule\s+10b5-1\b",
    r"\b13f\b",
    r"\binstitutional\s+holdings?\b",
    r"\bgolden\s+cross\b",
    r"\bmoving\s+averages?\b",
    r"\btechnical[-\s]+analysis\b",
    r"\bprice\s+targets?\b",
    r"\banalyst\s+ratings?\b",
    r"\binsider\b.{0,40}\b(sale|sold|purchase|bought)\b",
]


# Days that a calendar has, so that only those are dates; the 29th of February in leap years only.
_LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)-02-29"
_DAY = r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
_DATE = rf"(?<![0-9])(?!0000)((?:[0-9]{{4}}-{_DAY}|{_LEAP}))(?![0-9])"
_MONTH = r"(?:January|Jan\.?|February|Feb\.?|March|Mar\.?|April|Apr\.?|May|June|Jun\.?|July|Jul\.?|August|Aug\.?|September|Sept?\.?|October|Oct\.?|November|Nov\.?|December|Dec\.?)"
_NTH = r"([0-9]{1,2})(?:st|nd|rd|th)?"

CLAIM = "struct<kind: string, raw: string, value: decimal(38,10), precision: int, scale: string, day: date>"


@F.arrow_udf(StringType())
def _compatible(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return texts
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalized(text: Column) -> Column:
    """Compatibility forms made plain (NFKC), dashes a hyphen, no-break spaces a space."""
    # ASCII is plain as it is: only other texts go to Python, which gets nulls for the rest.
    plain = F.octet_length(text) == F.length(text)
    made = F.coalesce(_compatible(F.when(~plain, text)), text)
    return F.translate(made, DASHES + "\u00a0\u202f", "-" * len(DASHES) + "  ")


def _claim(written: Column) -> Column:
    """The claim that a number makes as written, or null: small bare integers make none.

    Each part is bound once: inside a lambda Spark computes what is named twice two times.
    """

    def read(raw: Column) -> Column:
        digits = F.replace(F.regexp_extract(raw, r"[+-]?[0-9][0-9,]*(?:\.[0-9]+)?", 0), F.lit(","), F.lit(""))
        return F.struct(raw.alias("raw"), digits.alias("digits"), F.lower(F.regexp_extract(raw, r"(?i)(thousand|million|billion|trillion)", 1)).alias("word"))

    def judged(p: Column) -> Column:
        raw, dotted = p["raw"], p["digits"].contains(".")
        return bound(p["digits"].try_cast("decimal(38,10)"), lambda value: bound(_kind(raw, p["word"], dotted, value), lambda kind: made(p, kind, value)))

    def _kind(raw: Column, word: Column, dotted: Column, value: Column) -> Column:
        return F.when(raw.rlike("(?i)(?:%|percent)$"), "percent").when(word != "", "scaled").when(dotted | raw.rlike("^[$€£]"), "number").when(~dotted & value.between(1900, 2100), "year")

    def made(p: Column, kind: Column, value: Column) -> Column:
        decimals, scale = F.length(F.regexp_extract(p["digits"], r"\.([0-9]+)", 1)), F.when(kind == "scaled", p["word"])
        found = F.struct(kind.alias("kind"), p["raw"].alias("raw"), value.alias("value"), decimals.alias("precision"), scale.alias("scale"), F.lit(None).cast("date").alias("day"))
        return F.when(kind.isNotNull() & value.isNotNull(), found)

    return bound(written, lambda raw: bound(read(raw), judged))


def _dated(raw: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit("date").alias("kind"), raw.alias("raw"), none.cast("decimal(38,10)").alias("value"), none.cast("int").alias("precision"), none.cast("string").alias("scale"), raw.cast("date").alias("day"))


def claims_of(plain: Column) -> Column:
    """The claims of a normalised text as one array: its dates first, then what is left without them."""
    dates = F.transform(F.regexp_extract_all(plain, F.lit(_DATE), F.lit(1)), _dated)
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(plain, _DATE, "          "), F.lit(NUMBER_CLAIM), F.lit(1)), lambda x: _claim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.concat(dates.cast(f"array<{CLAIM}>"), F.array_compact(numbers).cast(f"array<{CLAIM}>"))


def claims_in(statements: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per claim of the rows of ``statements``: their other columns, and kind, raw, value, precision, scale, day. Null texts have none."""
    kept = [c for c in statements.columns if c != text_col]
    return statements.withColumn("_plain", normalized(F.col(text_col))).select(*kept, F.explode(claims_of(F.col("_plain"))).alias("_c")).select(*kept, "_c.*")


def prose_dates(text: Column) -> Column:
    """Dates written as "July 3rd, 2026" or "3 July 2026": distinct, in order; what no calendar has is left out."""
    month_first, day_first = rf"(?i)\b({_MONTH})\s+{_NTH},?\s+([0-9]{{4}})\b", rf"(?i)\b{_NTH}\s+({_MONTH}),?\s+([0-9]{{4}})\b"
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m.lower(), f"{i + 1:02d}")])

    def found(pattern: str, month: int, day: int) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (month, day, 3)]
        return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "mdy", strict=True)]), lambda x: F.try_to_date(F.concat_ws("-", x["y"], F.element_at(number, F.lower(F.left(x["m"], F.lit(3)))), F.lpad(x["d"], 2, "0")), "yyyy-MM-dd"))

    return F.array_sort(F.array_distinct(F.array_compact(F.concat(found(month_first, 1, 2), found(day_first, 2, 1)))))


def unsupported_claims(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Claims that no claim of their sources equals in kind, scale and value (dates: the day)."""
    same = F.col(f"c.{key}") == F.col(f"s.{key}")
    for c in ("kind", "scale", "value", "day"):
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}"))
    return claims.alias("c").join(sources.alias("s"), same, "left_anti")


def _ten(power: Column) -> Column:
    """Ten to a power from -12 to 12."""
    return F.element_at(F.array(*[F.lit(Decimal(1).scaleb(p)).cast("decimal(25,12)") for p in range(-12, 13)]), power + 13)


def off_expected(claims: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Claims that no expected value of their key bears out.

    ``expected``: key, kind (percent, scaled, number or date), expected (a ratio for
    percent, whole money for scaled), expected_day. A claim may differ by half a unit
    of its last digit: a percentage from the ratio times 100, a scaled one from the
    money over its scale. A year is that of an expected date. Claims and expected values
    meet in cells of a claim's last digit, so a key with very many of both is no cross join.
    """
    dated = F.col("kind").isin("date", "year")
    power = F.lit(0)
    for word, n in SCALES.items():
        power = F.when(F.col("scale") == word, n).otherwise(power)
    # The exponent of ten of a claim's last digit, and what it says in the expected value's terms.
    plain = claims.filter(~dated).withColumns({"_power": power, "_digit": power - F.least("precision", F.lit(11))})
    written = F.col("value").cast("decimal(28,10)")
    said = F.when(F.col("_power") > 0, (written * _ten(F.col("_power")).cast("decimal(13,0)")).try_cast("decimal(38,10)")).otherwise(written.cast("decimal(38,10)"))
    half = _ten(F.col("_digit")) / 2
    cell = lambda c: F.floor(c * _ten(-F.col("_digit")))
    # An expected value meets the claims of its key once for each last digit that these are written to.
    digits = plain.select(key, "kind", "_digit").distinct()
    times = F.when(F.col("kind") == "percent", F.lit(100)).otherwise(F.lit(1)).cast("decimal(3,0)")
    held = expected.filter("kind != 'date'").select(key, "kind", (F.col("expected").cast("decimal(28,10)") * times).alias("_expected")).join(digits, [key, "kind"])
    off = band_join(plain, held, [key, "kind", "_digit"], low=said - half, high=said + half, low_cell=cell(said - half), value="_expected", value_cell=cell(F.col("_expected")), how="left_anti")
    day = F.when(F.col("c.kind") == "date", F.col("c.day") == F.col("e.expected_day")).otherwise(F.col("c.value") == F.year("e.expected_day"))
    late = claims.filter(dated).alias("c").join(expected.filter("kind = 'date'").alias("e"), (F.col(f"c.{key}") == F.col(f"e.{key}")) & day, "left_anti")
    return off.drop("_power", "_digit").unionByName(late)


def relation_terms(text: Column) -> Column:
    """Relation terms that stand in a text as whole words, in their fixed order."""
    # Patterns are literals, so each is compiled once, not for every row.
    return bound(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(low.rlike(rf"\b{t}\b"), F.lit(t)) for t in RELATION_TERMS])))


def ungrounded_terms(statement: Column, source: Column) -> Column:
    return F.array_except(relation_terms(statement), relation_terms(source))


def is_noise(title: Column, text: Column) -> Column:
    return any_pattern(F.concat_ws("\n", title, text), NOISE)
