"""Operators over cumulative snapshots: last samples, interval gains, marks, milestones, leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import bucket


def last_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's last row in time, not the largest: totals may fall."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def interval_grid(games: DataFrame, keys: Sequence[str], duration: str, width: int) -> DataFrame:
    """One row per full interval of a game; a game shorter than one interval has none."""
    n = F.floor(F.col(duration) / width).cast("long")
    return games.where(F.col(duration) >= width).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("interval"))


def filled_grid(samples: DataFrame, grid: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], values: Sequence[str], width: int) -> DataFrame:
    """Values at the end of every grid interval: the last sample so far, 0 before the first."""
    last = samples.withColumn("interval", bucket(F.col(at), width)).groupBy(*keys, "interval").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    window = Window.partitionBy(*keys).orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(last, [*keys, "interval"], "left")
    carried = joined.withColumn("_v", F.last("_v", ignorenulls=True).over(window))
    return carried.select(*keys, "interval", *(F.coalesce(F.col(f"_v.{v}"), F.lit(0)).alias(v) for v in values))


def gains(filled: DataFrame, keys: Sequence[str], values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """What each interval adds to the interval before; columns in ``keep`` stay as they are."""
    window = Window.partitionBy(*keys).orderBy("interval")
    return filled.select(*keys, "interval", *keep, *((F.col(v) - F.lag(v, 1, 0).over(window)).alias(v) for v in values))


def column_gains(samples, games, keys, at, order, values, width, duration="duration_s") -> DataFrame:
    return gains(filled_grid(samples, interval_grid(games, keys, duration, width), keys, at, order, values, width), keys, values)


def source_gains(samples, games, keys, source, at, order, value, width, duration="duration_s") -> DataFrame:
    """Gains of a total kept per source: each source's largest total so far is carried forward on its own, then the sources are added."""
    pairs = samples.select(*keys, source).distinct()
    grid = interval_grid(games, keys, duration, width).join(pairs, list(keys))
    per = gains(filled_grid(samples, grid, [*keys, source], at, [value, *order], [value], width), [*keys, source], [value])
    return per.groupBy(*keys, "interval").agg(F.sum(value).alias(value))


def event_gains(events, games, keys, at, width, name="n", duration="duration_s") -> DataFrame:
    counted = events.withColumn("interval", bucket(F.col(at), width)).groupBy(*keys, "interval").agg(F.count(F.lit(1)).alias(name))
    return interval_grid(games, keys, duration, width).join(counted, [*keys, "interval"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def totals(samples, games, keys, order, value, duration="duration_s") -> DataFrame:
    """A game's whole total with its length; no sample counts as 0, games without length are left out."""
    return games.where(F.col(duration) > 0).select(*keys, duration).join(last_sample(samples, keys, order, [value]), list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def at_marks(samples, games, keys, at, order, value, marks: Sequence[int], duration="duration_s") -> DataFrame:
    """The last value at or before each mark, for the marks that a game reaches; without a sample, 0."""
    wanted = games.where(F.col(duration) >= min(marks)).select(*keys, duration, F.explode(F.array(*(F.lit(m).cast("long") for m in marks))).alias("mark_s")).where(F.col(duration) >= F.col("mark_s"))
    # all marks in one pass over the samples, without a row per sample and mark
    best = [F.max_by(F.when(F.col(at) <= m, F.col(value)), F.when(F.col(at) <= m, F.struct(*order))).alias(f"_m{m}") for m in marks]
    per = samples.groupBy(*keys).agg(*best)
    value_at = F.coalesce(*(F.when(F.col("mark_s") == m, F.col(f"_m{m}")) for m in marks), F.lit(0))
    return wanted.join(per, list(keys), "left").select(*keys, "mark_s", value_at.alias(value))


def target_times(samples, keys, at, order, value, targets: Sequence[float]) -> DataFrame:
    """When a total first crosses each target, by linear interpolation between samples; unreached targets have no row."""
    window = Window.partitionBy(*keys).orderBy(*order)
    steps = samples.select(*keys, F.col(at).alias("t1"), F.col(value).alias("v1"), F.lag(at, 1, 0).over(window).alias("t0"), F.lag(value, 1, 0).over(window).alias("v0"))
    crossed = F.filter(F.array(*(F.lit(float(t)) for t in targets)), lambda t: (F.col("v0") < t) & (t <= F.col("v1")))
    rows = steps.select("*", F.explode(crossed).alias("target"))
    moment = F.col("t0") + (F.col("t1") - F.col("t0")) * (F.col("target") - F.col("v0")) / (F.col("v1") - F.col("v0"))
    return rows.groupBy(*keys, "target").agg(F.min(moment).alias("reached_s"))


def team_lead(filled: DataFrame, game: Sequence[str], team: str, value: str) -> DataFrame:
    """Both teams' totals by interval, their gains, and the first team's lead."""
    both = filled.groupBy(*game, "interval").pivot(team, [0, 1]).agg(F.sum(value))
    window = Window.partitionBy(*game).orderBy("interval")
    a, b = F.coalesce("0", F.lit(0)), F.coalesce("1", F.lit(0))
    out = both.select(*game, "interval", a.alias("team0"), b.alias("team1"))
    return out.withColumns({"gain0": F.col("team0") - F.lag("team0", 1, 0).over(window), "gain1": F.col("team1") - F.lag("team1", 1, 0).over(window), "lead": F.col("team0") - F.col("team1")})


def rates(df: DataFrame, value: str, duration: str = "duration_s") -> Column:
    return F.col(value) * 60.0 / F.col(duration)
