"""Prices: currencies, deal percentages, stepwise fees, inferred VAT and calibrated fees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules.tables import FEE_KNOTS, SORT_RATES


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def sort_rate(currency: Column) -> Column:
    """SEK for one unit by the fixed rates; 1 for others."""
    rates = F.create_map(*[F.lit(x) for pair in SORT_RATES.items() for x in pair])
    return F.coalesce(rates[F.upper(currency)], F.lit(1.0))


def shown_price(current: Column, least: Column, currency: Column) -> Column:
    return F.coalesce(current, least) * sort_rate(currency)


def best_price(total: Column, current: Column, least: Column) -> Column:
    """Total, bid or starting price, the first that is known and positive."""
    return F.coalesce(*[F.when(c > 0, c) for c in (total, current, least)])


def deal_percent(price: Column, count: Column, estimate: Column, low: Column, high: Column, ends: Column, as_of: Column, hours: int = 48) -> Column:
    """How far a price is under its estimate, in percent; null unless the estimate can be trusted and time is short."""
    sound = (count >= 4) & (estimate > 0) & (low > 0) & (high <= 2.5 * low)
    near = (ends > as_of) & (ends <= as_of + F.expr(f"INTERVAL {hours} HOURS"))
    return F.when(sound & (price > 0) & (price < low) & near, F.round((estimate - price) / estimate * 100))


def stepwise(x: Column, knots: tuple[tuple[float, float], ...] = FEE_KNOTS) -> Column:
    """Linear between knots, flat before the first, the last slope beyond the last; null for null and negative."""
    out = F.when(x.isNull() | (x < 0), None).when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        on = half_up(y0 + (x - x0) / float(x1 - x0) * (y1 - y0)).cast("double")
        out = out.when(x <= x1, on) if (x1, y1) != knots[-1] else out.otherwise(on)
    return out


def residual_vat(total: Column, bid: Column, fee: Column) -> Column:
    """25 if what a total holds beyond bid, fee and the fee's VAT is over a twentieth of the bid, else 0."""
    return F.when(total - bid - fee - 0.25 * fee > 0.05 * bid, 25).otherwise(0)


def calibrated(x1: Column, f1: Column, x2: Column, f2: Column) -> Column:
    """(slope, intercept) of a fee through two probes; null when the probes coincide or the line is no fee."""
    slope = (f2 - f1) / F.nullif(x2 - x1, F.lit(0.0))
    base = f1 - slope * x1
    return F.when((slope >= 0) & (slope <= 1) & (base >= 0), F.struct(slope.alias("slope"), base.alias("base")))


def nice_ceiling(x: Column) -> Column:
    """The least of 1, 2, 5 times a power of ten that is not under x."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    lead = x / power
    return power * F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10)
