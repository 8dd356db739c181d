"""Joins on near values: equal keys, and numbers that lie within a band of each other.

A band join by inequality compares all pairs of a key, so a key with a third of all rows
is a cross join. Here numbers are dealt to cells about as wide as the band. A left row
asks from the cell of its band's lower end; a right row is sent to its own cell and to
the few below from which a band can reach it; cells meet by equality, and the exact
test comes after. Work follows the pairs that nearly match, a key is as many groups as
its values have cells, and since a left row asks once, semi and anti joins are plain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], *, low: Column, high: Column, low_cell: Column, value: str, value_cell: Column, cells: int = 1, how: str = "inner") -> DataFrame:
    """Rows of ``left`` and ``right`` of equal ``keys`` (null-safe) where the right row's ``value`` lies from ``low`` to ``high``, expressions of the left row.

    ``low_cell`` and ``value_cell`` number the cells of ``low`` and ``value`` by the same
    rule; a rule that rounds may be one off. A band is at most ``cells`` cells wide.
    ``how``: inner (columns of the left, then those of the right that are no keys),
    left_semi or left_anti. A null value or band matches nothing.
    """
    a = left.withColumns({"_low": low, "_high": high, "_cell": low_cell.cast("decimal(38,0)")})
    reach = F.array(*[value_cell.cast("decimal(38,0)") - j for j in range(-1, cells + 2)])
    rest = [c for c in right.columns if c not in keys]
    b = right.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *rest, F.explode(reach).alias("_at"))
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_cell") == F.col("_at"))
    found = a.join(b, met & F.col(value).between(F.col("_low"), F.col("_high")), how)
    return found.drop("_low", "_high", "_cell", "_at", *[f"_k{i}" for i in range(len(keys))])


def comparable_periods(periods: DataFrame, keys: list[str], *, end: str = "period_end", days: str = "days", earlier: tuple[int, int] = (350, 380), length: int = 2) -> DataFrame:
    """Periods with those of the same keys that end 350 to 380 days earlier and differ by two days in length at most: the row's columns, and ``prior_`` ones."""
    rest = [c for c in periods.columns if c not in keys]
    prior = periods.select(*keys, *[F.col(c).alias(f"prior_{c}") for c in rest])
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    width = earlier[1] - earlier[0] + 1
    low, high = F.date_sub(end, earlier[1]), F.date_sub(end, earlier[0])
    met = band_join(periods, prior, keys, low=low, high=high, low_cell=F.floor(day(low) / width), value=f"prior_{end}", value_cell=F.floor(day(F.col(f"prior_{end}")) / width))
    return met.filter(F.abs(F.col(days) - F.col(f"prior_{days}")) <= length)
