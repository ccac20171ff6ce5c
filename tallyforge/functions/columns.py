"""Column functions with the null, zero and tie rules that the operators rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def zero_sum(value: Column, when: Column | None = None) -> Column:
    """Sum that is 0, not null, over no rows; over the rows where ``when`` holds, if given."""
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0))


def any_true(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def ratio(n: Column, d: Column) -> Column:
    """``n / d``, null where ``d`` is null or 0."""
    return F.when(d != 0, n / d)


def bucket(seconds: Column, width: int) -> Column:
    """Interval number of a time; a time on a boundary belongs to the interval that it closes."""
    return F.greatest(F.floor((seconds - 1) / width), F.lit(0)).cast("long")


def binned(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the label of the first break that is not below the value, else the last label."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(breaks, labels))):
        out = F.when(value <= edge, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


def average_rank(value: Column, partition: Sequence[str], name: str) -> Column:
    """Rank within the partition where ties share the mean of their places; ``name`` is the value's column."""
    place = F.rank().over(Window.partitionBy(*partition).orderBy(value))
    return place + (F.count(F.lit(1)).over(Window.partitionBy(*partition, name)) - 1) / F.lit(2.0)


def iso_week(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def local_time(at: Column, zone: str) -> Column:
    return F.from_utc_timestamp(at, zone)


def since_day(at: Column, day: str, zone: str = "UTC") -> Column:
    """Whether a time's local day is ``day`` or later."""
    return F.to_date(local_time(at, zone)) >= F.to_date(F.lit(day))


def mean_of_two(a: Column, b: Column) -> Column:
    """Mean of those that are not null."""
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return F.when(n > 0, (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) / n)


def share_of(value: Column, *partition: str) -> Column:
    total = F.sum(value).over(Window.partitionBy(*partition))
    return ratio(100.0 * value, total)


def badge_index(badge: Column) -> Column:
    """Consecutive number of a badge: tens are the tier, ones the level 1 to 6; no badge is null."""
    return F.when(badge > 0, F.floor(badge / 10) * 6 + badge % 10).cast("long")


def badge_of(index: Column) -> Column:
    whole = F.round(index).cast("long")
    return F.when(whole > 0, F.floor((whole - 1) / 6) * 10 + (whole - 1) % 6 + 1).cast("long")
