"""Exact decimals: fit tests and half-even rounding, once and at the end."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,2})?"


def exact(text: Column, precision: int, scale: int) -> Column:
    """The number a text writes, if it fits the type without rounding; else null."""
    wide = F.when(text.rlike(rf"\A{_NUMBER}\z"), text.try_cast(f"decimal(38,{min(18, scale + 8)})"))
    narrow = wide.try_cast(f"decimal({precision},{scale})")
    lost = text.try_cast("double") != wide.cast("double")
    return F.when((narrow == wide) & ~lost, narrow)


def ratio(a: Column, b: Column) -> Column:
    """a / b at scale 18 for operands of (20,8); null if b is 0."""
    return (a.cast("decimal(20,8)") / F.nullif(b.cast("decimal(20,8)"), F.lit(0).cast("decimal(20,8)"))).cast("decimal(38,18)")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def half_even_ratio(a: Column, b: Column) -> Column:
    """a / b at scale 10, rounded half-even once from the exact quotient, for operands of (30,8); null if b is 0 or the quotient has more than 20 whole digits."""
    return half_even_ratios((a, b))[0]


def half_even_ratios(*pairs: tuple[Column, Column]) -> Column:
    """The ratios of several pairs (see ``half_even_ratio``) as an array: one expression, however many there are.

    The quotient's digits come by long division, five at a time, so nothing is rounded
    on the way. Each step's rest is bound once: named twice it would double the
    expression at every step.
    """
    wide, whole, ten = "decimal(30,8)", "decimal(20,0)", F.lit(100_000).cast("decimal(6,0)")
    tick = F.lit(Decimal("0.0000000001"))

    def digits(rest: Column, low: Column, then: Callable[[Column, Column], Column]) -> Column:
        return bound((rest % low).cast(wide), lambda left: then(((rest - left) / low).try_cast(whole), left))

    def more(left: Column, low: Column, then: Callable[[Column, Column], Column]) -> Column:
        return bound((left * ten).cast("decimal(36,8)"), lambda rest: digits(rest, low, then))

    def ended(front: Column, first: Column, second: Column, left: Column, low: Column) -> Column:
        up = (left * 2 > low) | ((left * 2 == low) & (second % 2 == 1))
        behind = (first * ten + second).cast(whole) + F.when(up, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")
        return (front.cast("decimal(30,10)") + (behind.cast(whole) * tick)).cast("decimal(30,10)")

    def divided(s: Column) -> Column:
        low = s["low"]
        return digits(s["top"], low, lambda front, l0: more(l0, low, lambda first, l1: more(l1, low, lambda second, l2: bound(second, lambda held: ended(front, first, held, l2, low)))))

    both = [F.struct(F.abs(a.cast(wide)).alias("top"), F.abs(F.nullif(b.cast(wide), F.lit(0).cast(wide))).alias("low"), ((a < 0) != (b < 0)).alias("negative")) for a, b in pairs]
    return F.transform(F.array(*both), lambda s: bound(divided(s), lambda size: F.when(s["negative"], -size).otherwise(size).cast("decimal(30,10)")))


def published(c: Column, precision: int = 20, scale: int = 10) -> Column:
    return F.bround(c, scale).cast(f"decimal({precision},{scale})")
