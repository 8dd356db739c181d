"""Fundamentals from period facts: annual pairs, comparable periods, trailing twelve months.

``facts``: entity, concept, period_start (null: an instant), period_end, fact_value,
filing_form, filing_date, accession_number. Ambiguity is reported in a column, never
decided by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.decimals import half_even_ratio
from ledgerlight.functions.times import days_inclusive, is_year_long

PERIOD = ["entity", "concept", "period_start", "period_end"]


def latest_facts(facts: DataFrame) -> DataFrame:
    """Of each (entity, concept, period) the fact filed last, the smaller accession of equal ones; ``ambiguous``: values differ then."""
    rank = F.rank().over(Window.partitionBy(*PERIOD).orderBy(F.col("filing_date").desc()))
    newest = facts.withColumn("_r", rank).filter("_r = 1")
    return newest.groupBy(*PERIOD).agg(
        F.min_by("fact_value", "accession_number").alias("fact_value"),
        F.max("filing_date").alias("filing_date"),
        F.min("accession_number").alias("accession_number"),
        (F.min("fact_value") != F.max("fact_value")).alias("ambiguous"),
    )


def latest_filing(facts: DataFrame) -> DataFrame:
    """The newest eligible filing of each entity; ``ambiguous`` if several share its date."""
    eligible = facts.filter(F.col("filing_form").isin("10-K", "10-Q"))
    rank = F.rank().over(Window.partitionBy("entity").orderBy(F.col("filing_date").desc()))
    newest = eligible.withColumn("_r", rank).filter("_r = 1")
    return newest.groupBy("entity").agg(F.max("filing_date").alias("filing_date"), F.min("filing_form").alias("filing_form"), F.min("accession_number").alias("accession_number"), (F.count_distinct("accession_number", "filing_form") > 1).alias("ambiguous"))


def annual_pairs(facts: DataFrame, top: str = "revenue", bottom: str = "net_income") -> DataFrame:
    """Year-long periods of annual filings that hold both concepts, with the year before them (350 to 380 days earlier)."""
    annual = latest_facts(facts.filter((F.col("filing_form") == "10-K") & is_year_long(F.col("period_start"), F.col("period_end"))))
    value = lambda name: F.max(F.when(F.col("concept") == name, F.col("fact_value")))
    pairs = annual.groupBy("entity", "period_start", "period_end").agg(value(top).alias(top), value(bottom).alias(bottom), F.max("ambiguous").alias("ambiguous")).filter(F.col(top).isNotNull() & F.col(bottom).isNotNull())
    order = Window.partitionBy("entity").orderBy("period_end", "period_start")
    before = F.lag(F.struct("period_end", top, bottom)).over(order)
    comparable = F.datediff("period_end", F.col("_before.period_end")).between(350, 380)
    return pairs.withColumn("_before", before).select("entity", "period_start", "period_end", top, bottom, F.when(comparable, F.col(f"_before.{top}")).alias(f"prior_{top}"), F.when(comparable, F.col(f"_before.{bottom}")).alias(f"prior_{bottom}"), "ambiguous")


def year_to_date_bridge(facts: DataFrame) -> DataFrame:
    """Trailing twelve months per (entity, concept): annual value, or annual + current part of a year - the same part a year before.

    The current part is the longest period that ends last in the newest filing; its
    counterpart ends 350 to 380 days earlier and differs by two days in length at
    most; the annual period ends the day before the current part starts.
    """
    known = latest_facts(facts.filter(F.col("period_start").isNotNull())).withColumn("days", days_inclusive(F.col("period_start"), F.col("period_end")))
    newest = latest_filing(facts).select("entity", "filing_form", F.col("accession_number").alias("_accession"))
    own = facts.filter(F.col("period_start").isNotNull()).join(newest.withColumnRenamed("_accession", "accession_number"), ["entity", "filing_form", "accession_number"], "left_semi")
    longest = Window.partitionBy("entity", "concept").orderBy(F.col("period_end").desc(), "period_start")
    current = own.withColumn("_n", F.row_number().over(longest)).filter("_n = 1").select("entity", "concept", "period_start", "period_end", F.col("fact_value").alias("current"), days_inclusive(F.col("period_start"), F.col("period_end")).alias("days"))
    current = current.join(newest.select("entity", "filing_form"), "entity")
    old = known.select("entity", "concept", F.col("period_end").alias("_end"), F.col("period_start").alias("_start"), F.col("fact_value").alias("_value"), F.col("days").alias("_days"), F.col("filing_date").alias("_filed"), F.col("accession_number").alias("_accession"))
    met = current.join(old, ["entity", "concept"])
    prior = F.datediff("period_end", "_end").between(350, 380) & (F.abs(F.col("days") - F.col("_days")) <= 2)
    annual = is_year_long(F.col("_start"), F.col("_end")) & (F.col("_end") == F.date_sub("period_start", 1))
    keys = ["entity", "concept", "filing_form", "period_start", "period_end", "current"]
    # Equivalent facts are one; of them the one filed first speaks. Several that differ are ambiguous.
    first = lambda of: F.min_by("_value", F.when(of, F.struct("_filed", "_accession")))
    several = lambda of: F.count_distinct(F.when(of, F.struct("_start", "_end", "_value"))) > 1
    sums = met.groupBy(*keys).agg(first(prior).alias("prior_part"), first(annual).alias("annual"), (several(prior) | several(annual)).alias("ambiguous"))
    bridged = F.col("annual") + F.col("current") - F.col("prior_part")
    return sums.select("entity", "concept", "period_end", F.when(F.col("filing_form") == "10-K", F.col("current")).otherwise(bridged).cast("decimal(30,8)").alias("ttm"), "ambiguous")


def fundamental_metrics(ttm: DataFrame, pairs: DataFrame) -> DataFrame:
    """Margin of the trailing months, growth and change of the latest year, one row per entity."""
    value = lambda name: F.max(F.when(F.col("concept") == name, F.col("ttm")))
    months = ttm.groupBy("entity").agg(value("revenue").alias("revenue_ttm"), value("net_income").alias("net_income_ttm"))
    newest = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy(F.col("period_end").desc(), F.col("period_start").desc()))).filter("_n = 1")
    return months.join(newest, "entity").select(
        "entity",
        "revenue_ttm",
        "net_income_ttm",
        half_even_ratio(F.col("net_income_ttm"), F.col("revenue_ttm")).alias("net_margin_ttm"),
        half_even_ratio(F.col("revenue") - F.col("prior_revenue"), F.col("prior_revenue")).alias("revenue_growth_latest_fy"),
        (F.col("net_income") - F.col("prior_net_income")).alias("net_income_change_latest_fy"),
    )
