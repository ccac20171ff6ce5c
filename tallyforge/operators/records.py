"""Records by day, ranks within teams and populations, gaps, nearby players, modal gains, transitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import average_rank, ratio, zero_sum
from tallyforge.functions.frames import dealt


def last_days(df: DataFrame, day: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the last ``n`` days that have rows at all (of each key)."""
    days = df.select(*by, day).distinct()
    if by:
        recent = days.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(day)))).where(F.col("_n") <= n).drop("_n")
    else:
        recent = days.orderBy(F.desc(day)).limit(n)
    return df.join(recent, [*by, day], "left_semi")


def record(df: DataFrame, by: Sequence[str], won: Column, lost: Column, along: str | None = None) -> DataFrame:
    """Games, wins, losses, their difference, and its running total along a column."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("games"), zero_sum(won.cast("long")).alias("wins"), zero_sum(lost.cast("long")).alias("losses")).withColumn("net", F.col("wins") - F.col("losses"))
    if along:
        window = Window.partitionBy(*(b for b in by if b != along)).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("cum_net", F.sum("net").over(window))
    return out


def team_ranks(df: DataFrame, team: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*team).orderBy(F.desc(value), *tie))
    return df.withColumn("team_rank", place).withColumn("is_top", F.col("team_rank") == 1)


def percentiles(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Percentile: the average rank as a rounded share of all rows of the group; rows without a value have none but count."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    out = df.withColumn("_known", F.col(value).isNotNull())
    rank = average_rank(F.col(value), [*group, "_known"], value)
    out = out.withColumn("avg_rank", F.when(F.col("_known"), rank)).drop("_known")
    return out.withColumn("percentile", F.round(100.0 * F.col("avg_rank") / n))


def aim_rates(counters: DataFrame, keys: Sequence[str], hero: str, name: str, value: str, min_shots: int = 100, min_games: int = 50) -> DataFrame:
    """Each game's shots, hits, headshots and their rates, and percentiles of the rates within the hero over all games.

    Games of fewer than ``min_shots`` shots are left out; a hero of fewer than ``min_games`` games has no percentiles.
    Filter by account afterwards: percentiles are of everyone.  ``counters``: keys, hero, name, value.
    """
    wide = counters.groupBy(*keys, hero).agg(*(zero_sum(F.col(value), F.col(name) == n).alias(c) for c, n in (("shots", "Shots"), ("hits", "Hits"), ("headshots", "Headshots"))))
    rows = wide.where(F.col("shots") >= min_shots).withColumns({"hit_rate": ratio(100.0 * F.col("hits"), F.col("shots")), "headshot_rate": ratio(100.0 * F.col("headshots"), F.col("hits"))})
    rows = rows.withColumn("hero_games", F.count(F.lit(1)).over(Window.partitionBy(hero)))
    for rate in ("hit", "headshot"):
        rows = percentiles(rows, [hero], f"{rate}_rate").withColumn(f"{rate}_percentile", F.when(F.col("hero_games") >= min_games, F.col("percentile"))).drop("percentile", "avg_rank")
    return rows


def abandons(games: DataFrame, leavers: DataFrame, samples: DataFrame, accounts: Sequence[int], value: str) -> DataFrame:
    """Matches that somebody left: whether that was one of ``accounts``, an ally or an enemy, and whether one came back.

    ``games``: match_id, won, team of the account's player; ``leavers``: match_id, account_id, team, abandon_time_s;
    ``samples``: match_id, account_id, time_stamp_s and a running total, which grows only for someone who plays.
    """
    per = samples.groupBy("match_id", "account_id", "time_stamp_s").agg(F.sum(value).alias("_v"))
    after = leavers.join(per, ["match_id", "account_id"], "left").withColumn("_v", F.when(F.col("time_stamp_s") > F.col("abandon_time_s"), F.col("_v")))
    each = after.groupBy("match_id", "account_id", F.col("team").alias("_team")).agg(F.coalesce(F.max("_v") > F.min("_v"), F.lit(False)).alias("returned"))
    you = F.col("account_id").isin(*accounts)
    both = games.select("match_id", "won", "team").distinct().join(each, "match_id")
    return both.groupBy("match_id").agg(
        F.min("won").alias("won"), F.bool_or(you).alias("you"), F.bool_or(~you & (F.col("_team") == F.col("team"))).alias("ally"), F.bool_or(F.col("_team") != F.col("team")).alias("enemy"), F.bool_or("returned").alias("returned")
    )


def flag_gaps(df: DataFrame, by: Sequence[str], order: Sequence[str], start: str, end: str) -> DataFrame:
    """Marks rows whose start is not the end of the row before."""
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("gap", before.isNotNull() & (F.col(start) != before))


def returned(samples: DataFrame, keys: Sequence[str], value: str, after: Column) -> DataFrame:
    """Whether a running total grew after a moment: its largest value there is above its smallest."""
    later = F.when(after, F.col(value))
    return samples.groupBy(*keys).agg(F.coalesce(F.max(later) > F.min(later), F.lit(False)).alias("returned"))


def nearby(events: DataFrame, positions: DataFrame, match: Sequence[str], own: str, other: str, near: Column) -> DataFrame:
    """How many others stand within reach of each event, at the same match and second: allies and enemies.

    ``events`` and ``positions`` join on ``match``; ``near`` is the distance condition on both sides' columns, and the
    columns ``own`` and ``other`` tell the teams.  Equal events are counted once and given back as often as they were.
    """
    distinct = events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("_times"))
    rows = distinct.withColumn("_event", F.struct(*events.columns, "_times")).join(positions, list(match), "left")
    close = F.coalesce(near, F.lit(False))
    out = rows.groupBy("_event").agg(zero_sum(F.lit(1), close & (F.col(own) == F.col(other))).alias("allies"), zero_sum(F.lit(1), close & (F.col(own) != F.col(other))).alias("enemies"))
    out = out.select("_event.*", "allies", "enemies").withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times")
    return out.withColumn("solo", F.col("allies") == 0).withColumn("outnumbered", F.col("enemies") > F.col("allies") + 1)


def furthest(values: np.ndarray, reach: float) -> np.ndarray:
    """The largest double whose difference from each value, as doubles subtract, is not above ``reach``.

    Found by halving among the doubles in their order; ``value + reach`` may be rounded to a neighbour of it.
    """
    lowest = np.iinfo(np.int64).min
    place = lambda x: np.where(x.view(np.int64) < 0, lowest - x.view(np.int64), x.view(np.int64))
    double = lambda n: np.where(n < 0, lowest - n, n).view(np.float64)
    low, high = place(values), place(np.full(len(values), np.finfo(np.float64).max))
    with np.errstate(over="ignore"):
        while (low < high).any():
            middle = (low | high) - ((low ^ high) >> 1)
            within = double(middle) - values <= reach
            low, high = np.where(within, middle, low), np.where(within, high, middle - 1)
    return double(low)


def nearby_on_line(events: DataFrame, positions: DataFrame, match: Sequence[str], who: str, at: str, team: str, reach: float) -> DataFrame:
    """``nearby`` where places are numbers: how many positions of others lie within ``reach`` of each event.

    Positions and the two ends of each event's reach are sorted together and the positions so far are counted, over all,
    the team, the player and both, so that no event meets each position of its match.  Both tables have ``match``, ``who``,
    ``at`` and ``team``.  Equal events are counted once and given back as often as they were.
    """

    @F.pandas_udf("low double, high double")
    def ends(values: pd.Series) -> pd.DataFrame:
        v = values.to_numpy("float64")
        return pd.DataFrame({"low": -furthest(-v, reach), "high": furthest(v, reach)})

    columns = [*match, who, team]
    placed = F.abs(at) < float("inf")
    for c in columns:
        placed = placed & F.col(c).isNotNull()
    distinct = events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("_times")).withColumn("_placed", F.coalesce(placed, F.lit(False)))
    reached = ends(F.when(F.col("_placed"), F.col(at).cast("double")).otherwise(0.0))
    marks = distinct.withColumn("_ends", reached).select(*columns, F.struct(*events.columns, "_times").alias("_event"), F.inline(F.array(
        F.struct(F.when(F.col("_placed"), F.col("_ends.low")).alias("_t"), F.lit(0).alias("_side")),
        F.struct(F.when(F.col("_placed"), F.col("_ends.high")).alias("_t"), F.lit(2).alias("_side")),
    )))
    both = positions.where(placed).select(*columns, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_side")).unionByName(marks, allowMissingColumns=True)
    out = dealt(both, *match)
    for name, by in (("_all", ()), ("_team", (team,)), ("_own", (who,)), ("_both", (team, who))):
        so_far = Window.partitionBy(*match, *by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(name, F.sum(F.when(F.col("_side") == 1, 1).otherwise(0)).over(so_far) * F.when(F.col("_side") == 0, -1).otherwise(1))
    sums = out.where("_side <> 1").groupBy(*match, "_event").agg(*(F.sum(c).alias(c) for c in ("_all", "_team", "_own", "_both")))
    allies = F.col("_team") - F.col("_both")
    counted = sums.select("_event.*", allies.alias("allies"), (F.col("_all") - F.col("_own") - allies).alias("enemies"))
    out = counted.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times")
    return out.withColumn("solo", F.col("allies") == 0).withColumn("outnumbered", F.col("enemies") > F.col("allies") + 1)


def modal_value(df: DataFrame, group: Sequence[str], value: str, least: int) -> DataFrame:
    """Each group's most frequent value, smallest first, where at least ``least`` rows have it."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))
    return counted.withColumn("_r", first).where((F.col("_r") == 1) & (F.col("n") >= least)).drop("_r")


def transitions(df: DataFrame, by: Sequence[str], order: Sequence[str], state: str, value: str, cap: float, still: float, group: Sequence[str]) -> DataFrame:
    """Per group: rows, changes of state, still rows, and the way gone in steps below a cap."""
    window = Window.partitionBy(*by).orderBy(*order)
    step = F.abs(F.col(value) - F.lag(value).over(window))
    out = df.withColumn("_step", step).withColumn("_before", F.lag(state).over(window))
    ok = F.col("_step") < cap
    return out.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        zero_sum(F.lit(1), F.col("_before").isNotNull() & (F.col("_before") != F.col(state))).alias("entered"),
        zero_sum(F.lit(1), ok & (F.col("_step") < still)).alias("still"),
        zero_sum(F.col("_step"), ok).alias("distance"),
    )


def counters(df: DataFrame, keys: Sequence[str], name: str, value: Column, wanted: Sequence[str]) -> DataFrame:
    """One column per counter, 0 where it is missing."""
    return df.groupBy(*keys).agg(*(zero_sum(value, F.col(name) == w).alias(w) for w in wanted))


def merged_ledger(*parts: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The earliest row of each key over several ledgers; null keys are equal."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(at, *rest)).alias("_r")).select(*keys, "_r.*")


def latest_of_each(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
