"""Session-based market metrics: one row per symbol, from its last 61 closes.

A series is a symbol's whole history, and one symbol may hold a third of all bars. No
window or task sees a whole series: it is cut into blocks of time, a block is summed up
where it lies (its number of bars, its last ones, the highest, the lowest and the worst
fall within it), and the summaries of blocks combine as those of bars do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.decimals import half_even_ratio, half_even_ratios, published, ratio

HORIZONS = (1, 5, 20, 60)
SESSIONS = 61
#: Days of a block of a series.
BLOCK_DAYS = 128


def _block(date: Column, days: int) -> Column:
    return F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / days)


def newest(rows: DataFrame, key: list[str], order: list[Column], n: int, *, date: str, days: int = BLOCK_DAYS) -> DataFrame:
    """The first ``n`` rows of each key by ``order`` (the latest ``date`` first), with ``back`` (0: the first).

    Blocks of days keep their own first ``n``, and tasks keep those of the blocks they
    read before anything is shuffled; only these meet by key.
    """
    block = Window.partitionBy(*key, "_block").orderBy(*order)
    kept = rows.withColumn("_block", _block(F.col(date), days)).withColumn("_n", F.row_number().over(block)).filter(F.col("_n") <= n).drop("_n", "_block")
    return kept.withColumn("back", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).filter(F.col("back") < n)


def last_sessions(bars: DataFrame, symbol: str = "symbol") -> DataFrame:
    """The last 61 bars of each symbol with ``back`` (0: the last) and observations_available."""
    order = [F.col("trading_date").desc(), F.col("bar_timestamp").desc()]
    counts = bars.groupBy(symbol).agg(F.count(F.lit(1)).alias("observations_available"))
    return newest(bars, [symbol], order, SESSIONS, date="trading_date").join(counts, symbol)


def series_summary(bars: DataFrame, symbol: str = "symbol", days: int = BLOCK_DAYS) -> DataFrame:
    """Per symbol over its whole history: bars, first_date, last_date, high, low, and worst_fall (close over the highest close until then, less one; 0 if it never fell).

    A block's (high, low, worst close under a running high) is made within the block; a
    fall from a high before the block to its low is added when blocks meet in order.
    """
    dealt = bars.withColumn("_block", _block(F.col("trading_date"), days))
    so_far = Window.partitionBy(symbol, "_block").orderBy("trading_date", "bar_timestamp").rowsBetween(Window.unboundedPreceding, 0)
    fallen = dealt.withColumn("_fall", half_even_ratio(F.col("close") - F.max("close").over(so_far), F.max("close").over(so_far)))
    blocks = fallen.groupBy(symbol, "_block").agg(F.count(F.lit(1)).alias("bars"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.max("close").alias("high"), F.min("close").alias("low"), F.min("_fall").alias("worst"))
    earlier = F.max("high").over(Window.partitionBy(symbol).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("worst", F.least("worst", half_even_ratio(F.col("low") - earlier, earlier)))
    return blocks.groupBy(symbol).agg(F.sum("bars").alias("bars"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.max("high").alias("high"), F.min("low").alias("low"), F.least(F.min("worst"), F.lit(0)).cast("decimal(20,10)").alias("worst_fall"))


def market_metrics(bars: DataFrame, symbol: str = "symbol") -> DataFrame:
    """``bars``: symbol, trading_date, bar_timestamp, close. Metrics whose window is not full are null."""
    forward = Window.partitionBy(symbol).orderBy(F.col("back").desc())
    rows = last_sessions(bars, symbol)
    rows = rows.withColumn("step", ratio(F.col("close"), F.lag("close").over(forward)) - 1)
    peak = F.max("close").over(forward.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("fall", half_even_ratio(F.col("close") - peak, peak))

    def at(back: int) -> Column:
        return F.max(F.when(F.col("back") == back, F.col("close")))

    def total(n: int) -> Column:
        within = F.when(F.col("back") < n, F.col("close").cast("decimal(20,8)"))
        return F.when(F.count(within) == n, F.sum(within))

    def volatility(n: int) -> Column:
        within = F.when(F.col("back") < n, F.col("step").cast("double"))
        return F.when(F.count(within) == n, F.stddev_samp(within) * F.sqrt(F.lit(252.0)))

    found = [
        F.max("trading_date").alias("as_of_date"),
        F.min("trading_date").alias("window_start_date_60d"),
        F.max("observations_available").alias("observations_available"),
        at(0).alias("close"),
        *[at(n).alias(f"_at_{n}") for n in HORIZONS],
        *[published(volatility(n)).alias(f"annualized_volatility_{n}d") for n in (20, 60)],
        F.max("close").alias("_top"),
        F.least(F.min("fall"), F.lit(0)).cast("decimal(20,10)").alias("max_drawdown_60d"),
        *[total(n).alias(f"_sum_{n}") for n in (20, 60)],
    ]
    out = rows.groupBy(symbol).agg(*found)
    close, top, short, long = (F.col(c) for c in ("close", "_top", "_sum_20", "_sum_60"))
    # Means are compared before they are rounded: as sums, each over its own number of closes.
    ratios = {
        **{f"return_{n}d": (close - F.col(f"_at_{n}"), F.col(f"_at_{n}")) for n in HORIZONS},
        "current_drawdown_60d": (close - top, top),
        "close_vs_sma_20": (close * 20 - short, short),
        "close_vs_sma_60": (close * 60 - long, long),
        "sma_20_vs_sma_60": (short * 3 - long, long),
        "sma_20": (short, F.lit(20)),
        "sma_60": (long, F.lit(60)),
    }
    out = out.withColumn("_ratios", half_even_ratios(*ratios.values()))
    out = out.withColumns({c: F.col("_ratios")[k].cast("decimal(28,10)" if c.startswith("sma_") and "vs" not in c else "decimal(20,10)") for k, c in enumerate(ratios)})
    return out.drop("_ratios", "_top", "_sum_20", "_sum_60", *[f"_at_{n}" for n in HORIZONS])


def coverage_gate(bars: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Per symbol: sessions, last date, and whether it has 61, the common last date and the common 61 dates."""
    dates = last_sessions(bars, symbol).groupBy(symbol).agg(F.max("observations_available").alias("sessions"), F.max("trading_date").alias("last_date"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("trading_date").cast("string"))), ","), 256).alias("vector"))
    every = Window.partitionBy()  # one row per symbol
    return dates.select(
        symbol,
        "sessions",
        "last_date",
        (F.col("sessions") >= SESSIONS).alias("enough"),
        (F.col("last_date") == F.max("last_date").over(every)).alias("current"),
        (F.min("vector").over(every) == F.max("vector").over(every)).alias("aligned"),
    )


def top_sessions(bars: DataFrame, n: int, symbol: str = "symbol") -> DataFrame:
    """The last n + 1 closes of each symbol, with the close indexed to 100 at the first of them."""
    oldest = Window.partitionBy(symbol).orderBy("trading_date")
    kept = newest(bars, [symbol], [F.col("trading_date").desc()], n + 1, date="trading_date").drop("back")
    return kept.withColumn("indexed_close", F.bround(ratio(F.col("close"), F.first("close").over(oldest)) * 100, 2))
