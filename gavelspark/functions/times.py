"""Points in time from the many ways sources write them. ``as_of`` stands for now."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules.tables import COUNTDOWN, MONTHS
from .text import once


def month_rule_utc(local: Column) -> Column:
    """UTC of a local time under the rule "two hours ahead from April to October, one otherwise"."""
    return F.when(F.month(local).between(4, 10), local - F.expr("INTERVAL 2 HOURS")).otherwise(local - F.expr("INTERVAL 1 HOUR"))


def zone_utc(local: Column, zone: str = "Europe/Stockholm") -> Column:
    """UTC of a local time by the zone's own rules."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz")


def future_biased(month: Column, day: Column, as_of: Column) -> Column:
    """A date without a year: this year, or the next when that lies more than a day back."""
    this = F.make_date(F.year(as_of), month, day)
    return F.when(this < F.date_sub(F.to_date(as_of), 1), F.make_date(F.year(as_of) + 1, month, day)).otherwise(this)


def past_biased(month: Column, day: Column, as_of: Column) -> Column:
    """A date without a year: this year, or the last when that lies more than a day ahead."""
    this = F.make_date(F.year(as_of), month, day)
    return F.when(this > F.date_add(F.to_date(as_of), 1), F.make_date(F.year(as_of) - 1, month, day)).otherwise(this)


def exact_local(text: Column) -> Column:
    """UTC of the first 'YYYY-MM-DD HH:MM[:SS]' in a text that tells local time; null if there is none."""
    found = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?", 0)
    part = lambda m, start, size: F.substring(m, start, size)
    written = lambda m: F.try_to_timestamp(F.concat(part(m, 1, 10), F.lit(" "), part(m, 12, 5), F.coalesce(F.nullif(part(m, 17, 3), F.lit("")), F.lit(":00")))).cast("timestamp_ntz")
    return once(once(found, written), month_rule_utc)


def yearless(text: Column, as_of: Column, past: bool = False) -> Column:
    """UTC of a local time such as '29 jun 09:59' or '23 augusti 15:01': of the year of ``as_of``, or of the next if
    that lies more than a day back (``past``: of the last if it lies more than a day ahead)."""
    found = F.regexp_extract(F.lower(text), r"\d{1,2}\s+[a-zåäö]{3,}\.?\s+\d{1,2}:\d{2}", 0)
    day = F.expr("INTERVAL 1 DAY")

    def told(parts: Column) -> Column:
        part = lambda k: F.get(parts, F.lit(k))
        month = F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair])[F.left(part(1), F.lit(3))]
        two = lambda v: F.lpad(v.cast("string"), 2, "0")

        def of(year: Column) -> Column:
            written = F.concat(year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(part(0)), F.lit(" "), two(part(2)), F.lit(":"), part(3))
            return F.when(part(2).try_cast("int") < 24, once(F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"), month_rule_utc))

        wrong = lambda this: this > as_of + day if past else this < as_of - day
        return once(of(F.year(as_of)), lambda this: F.when(wrong(this), of(F.year(as_of) + (-1 if past else 1))).otherwise(this))

    return once(F.split(found, r"\.?\s+|:"), told)


def countdown_seconds(text: Column) -> Column:
    """Seconds that a countdown such as '3 dygn 10 tim 46 minuter 5 sek' leaves; null if it says nothing."""
    total = None
    said = None
    for pattern, seconds in COUNTDOWN:
        n = F.nullif(F.regexp_extract(F.lower(text), pattern, 1), F.lit("")).cast("long")
        part = F.coalesce(n, F.lit(0)) * seconds
        total, said = (part, n.isNotNull()) if total is None else (total + part, said | n.isNotNull())
    return F.when(said, total)


def age_minutes(seen: Column, as_of: Column) -> Column:
    return F.timestamp_diff("MINUTE", seen, as_of)


def freshness(minutes: Column) -> Column:
    """'ok' under 45 minutes, 'slow' under 180, else 'stale'."""
    return F.when(minutes < 45, "ok").when(minutes < 180, "slow").otherwise("stale")


def clock(minutes: Column) -> Column:
    """HH:MM of minutes after midnight."""
    whole = F.pmod(minutes.cast("int"), F.lit(1440))
    return F.format_string("%02d:%02d", (whole / 60).cast("int"), whole % 60)


def clock_minutes(text: Column) -> Column:
    """Minutes after midnight of 'H:MM'; null unless it is a time of day."""
    h, m = (F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", i).try_cast("int") for i in (1, 2))
    return F.when((h < 24) & (m < 60), h * 60 + m)


def from_epoch(number: Column, millis: bool = False) -> Column:
    """The UTC time that is so many seconds (or milliseconds) after the epoch."""
    return (F.timestamp_millis(number) if millis else F.timestamp_seconds(number)).cast("timestamp_ntz")
