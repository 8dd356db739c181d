"""Text, id and URL columns as built-in expressions. Nulls give nulls throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() knows it: Unicode white space and U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"

# Patterns of identifiers.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
CIK = r"[0-9]{10}"
ACCESSION = r"[0-9]{10}-[0-9]{2}-[0-9]{6}"
SHA256 = r"[0-9a-f]{64}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def nonblank(c: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def matches(c: Column, pattern: str) -> Column:
    """Whether the whole text matches."""
    return c.rlike(rf"\A(?:{pattern})\z")


def unique_list(c: Column) -> Column:
    """A comma list as an array of stripped items; null if an item is blank or stands twice."""
    items = F.transform(F.split(c, ","), strip)
    sound = (F.size(F.array_distinct(items)) == F.size(items)) & ~F.exists(items, lambda x: x == "")
    return F.when(sound, items)


def cik10(c: Column) -> Column:
    """A CIK as ten digits; null if it is no number of at most ten."""
    digits = strip(c.cast("string"))
    return F.when(matches(digits, r"[0-9]{1,10}"), F.lpad(digits, 10, "0"))


def slice_chars(text: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end``, counted from 0."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def sha256(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def canonical_json(**columns: Column) -> Column:
    """JSON with fields in alphabetical order and no spaces; nulls are kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def content_id(**columns: Column) -> Column:
    return sha256(canonical_json(**columns))


def plain_web_url(c: Column) -> Column:
    """Whether a URL is http or https, has a host and carries no user info."""
    part = lambda p: F.try_parse_url(c, F.lit(p))
    return F.coalesce(F.lower(part("PROTOCOL")).isin("http", "https") & part("HOST").isNotNull() & part("USERINFO").isNull(), F.lit(False))


def any_pattern(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(f"(?i){p}") for p in patterns])


def money_words(c: Column) -> Column:
    """A short amount: trillions, billions or millions with two decimals, else whole cents, half-even."""
    text = F.format_string("%,.2f", F.bround(c, 2).cast("double"))
    for power, letter in ((6, "M"), (9, "B"), (12, "T")):
        scaled = F.format_string(f"%,.2f{letter}", F.bround(c / F.lit(10**power), 2).cast("double"))
        text = F.when(F.abs(c) >= 10**power, scaled).otherwise(text)
    return text


def grouped_money(c: Column) -> Column:
    """An amount with two decimals, half-even, and its thousands set apart by commas; exact for decimals of any size."""
    plain = F.bround(F.abs(c), 2).cast("decimal(38,2)").cast("string")
    whole = F.regexp_replace(F.regexp_extract(plain, r"^[0-9]+", 0), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
    return F.concat(F.when(c < 0, "-").otherwise(""), whole, F.regexp_extract(plain, r"\.[0-9]+$", 0))


def short_money(c: Column, currency: str = "USD") -> Column:
    """An amount with its currency, in trillions, billions or millions with two decimals, else in full."""
    said = grouped_money(c)
    for power, letter in ((6, "M"), (9, "B"), (12, "T")):
        said = F.when(F.abs(c) >= 10**power, F.concat(grouped_money(c / F.lit(10**power)), F.lit(letter))).otherwise(said)
    return F.concat(F.lit(f"{currency} "), said)


def symbol(c: Column) -> Column:
    """A requested symbol: stripped, in capitals; null where nothing is left."""
    return F.upper(nonblank(c))


def authority(url: Column) -> Column:
    """Host and port of a URL, for display; null if there is none."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def new_id() -> Column:
    """A random id for a run or a response; nothing that has to repeat may depend on it."""
    return F.expr("uuid()")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)
