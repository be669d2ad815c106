"""Small column helpers shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Exact two-digit decimal, so that sums do not depend on row order."""
    return col(c).cast("decimal(14,2)")


def total(c: Column | str) -> Column:
    """Exact sum of a two-digit amount, as a double."""
    return F.sum(money(c)).cast("double")


def mean(c: Column | str) -> Column:
    """Average that does not depend on row order: exact sum over the count."""
    return F.sum(money(c)).cast("double") / F.count(col(c))


def net(price: Column | str, discount: Column | str) -> Column:
    """price * (1 - discount), exact to four digits."""
    return col(price).cast("decimal(12,2)") * (F.lit(1).cast("decimal(3,2)") - col(discount).cast("decimal(4,2)"))


def day(c: Column | str) -> Column:
    """Timestamp or date as ``yyyy-MM-dd`` text."""
    return col(c).cast("date").cast("string")


def occurrences(text: Column | str, part: str) -> Column:
    """How often ``part`` occurs in ``text`` (non-overlapping)."""
    text = col(text)
    gone = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    return (gone / len(part)).cast("long")


def day_of_week(c: Column | str) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(col(c)) - 1


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))


def microseconds_of_day(hour: Column, minute: Column, second: Column) -> Column:
    """Time of day as microseconds, the form used here for TIME values."""
    return ((hour.cast("long") * 60 + minute) * 60 + second) * F.lit(1_000_000).cast("long")


def micros(ts: Column | str) -> Column:
    """Timestamp as microseconds since 1970."""
    return F.unix_micros(col(ts).cast("timestamp"))


def ieee_divide(a: Column | str, b: Column | str) -> Column:
    """a / b of doubles by IEEE 754: a zero divisor gives an infinity, or NaN for 0 / 0, and no error."""
    a, b = col(a).cast("double"), col(b).cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, F.when(a.isNotNull(), by_zero)).otherwise(F.try_divide(a, b))
