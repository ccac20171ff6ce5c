"""A game along its time: gains by source, enemy and interval, movement buckets, deaths by phase, objective timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import binned, bucket, ratio, zero_sum
from tallyforge.functions.frames import dealt
from tallyforge.operators.snapshots import gains


def last_interval(duration: Column, width: int) -> Column:
    return F.greatest(F.floor((duration - 1) / width), F.lit(0)).cast("long")


def whole_grid(games: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Intervals from 0 to the one in which a game ends, with ``end_s`` clipped to its end and whether it is ``full``."""
    rows = games.select(*keys, "duration_s", F.explode(F.sequence(F.lit(0).cast("long"), last_interval(F.col("duration_s"), width))).alias("interval"))
    end = (F.col("interval") + 1) * width
    return rows.withColumn("end_s", F.least(end, F.col("duration_s")).cast("long")).withColumn("full", end <= F.col("duration_s"))


def _source_gains(samples: DataFrame, games: DataFrame, keys: Sequence[str], source: Sequence[str], at: str, value: str, width: int) -> DataFrame:
    """One row per source of a game: ``duration_s``, and ``_gains`` with each interval that it has samples in and its gain there.

    Samples after a game's end count in its last interval.  Games are dealt like their samples, or the join would deal
    both over as many tasks as the games came in.
    """
    lengths = dealt(games.select(*keys, "duration_s"), *keys)
    rows = dealt(samples.select(*keys, *source, at, value), *keys).join(lengths, list(keys))
    at_most = rows.withColumn("interval", F.least(bucket(F.col(at), width), last_interval(F.col("duration_s"), width)))
    top = at_most.groupBy(*keys, *source, "interval").agg(F.max(value).alias("_v"), F.max("duration_s").alias("duration_s"))
    reached = F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("interval", "_v"))))
    per = top.groupBy(*keys, *source).agg(F.max("duration_s").alias("duration_s"), reached.alias("_reached"))
    upto = lambda n: F.array_max(F.slice(F.transform("_reached", lambda r: r["_v"]), 1, n))
    gained = F.transform("_reached", lambda r, i: F.struct(r["interval"].alias("interval"), (upto(i + 1) - F.coalesce(upto(i), F.lit(0))).alias("gain")))
    return per.select(*keys, *source, "duration_s", gained.alias("_gains"))


def source_intervals(samples: DataFrame, games: DataFrame, keys: Sequence[str], source: Sequence[str], at: str, value: str, width: int) -> DataFrame:
    """Gains of each source's running total by interval; samples after a game's end count in its last interval.

    Samples meet their game once, and each source's intervals are laid out from what it gained in them; a game has few.
    Gains are worked out in one row per source, so the intervals laid out are not sorted again.
    """
    per = _source_gains(samples, games, keys, source, at, value, width).withColumn("_gained", F.map_from_entries("_gains"))
    every = per.select(*keys, *source, "duration_s", "_gained", F.explode(F.sequence(F.lit(0).cast("long"), last_interval(F.col("duration_s"), width))).alias("interval"))
    full = (F.col("interval") + 1) * width <= F.col("duration_s")
    return every.select(*keys, *source, "interval", full.alias("full"), F.coalesce(F.col("_gained")[F.col("interval")], F.lit(0)).alias(value))


def group_intervals(samples: DataFrame, games: DataFrame, keys: Sequence[str], source: Sequence[str], group: Column, name: str, at: str, value: str, width: int) -> DataFrame:
    """Gains by another group of the sources (an enemy, a display name), with each group's total over the game.

    Groups whose total is 0 are left out.  Gains are summed and sorted as they come, and all intervals are laid out last:
    each gain brings the empty intervals before it, and the last one those up to the game's end.
    """
    gains = _source_gains(samples, games, keys, source, at, value, width).select(*keys, group.alias(name), "duration_s", F.inline("_gains"))
    per = gains.groupBy(*keys, name, "interval").agg(F.sum("gain").alias("gain"), F.max("duration_s").alias("duration_s"))
    along = Window.partitionBy(*keys, name).orderBy("interval")
    total = F.sum("gain").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spans = per.withColumns({"total": total, "_after": F.lag("interval").over(along), "_last": F.lead("interval").over(along).isNull()}).where("total != 0")
    until = F.when(F.col("_last"), last_interval(F.col("duration_s"), width)).otherwise(F.col("interval"))
    every = spans.select(*keys, name, F.explode(F.sequence(F.coalesce(F.col("_after") + 1, F.lit(0).cast("long")), until)).alias("_i"), "interval", "gain", "total")
    return every.select(*keys, name, F.col("_i").alias("interval"), F.when(F.col("_i") == F.col("interval"), F.col("gain")).otherwise(F.lit(0)).alias(value), "total")


def match_intervals(samples: DataFrame, events: DataFrame, games: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], kinds: Sequence[str], width: int) -> DataFrame:
    """Gains of several running totals and counts of events by interval, the last one clipped to the game's end.

    A total counts as its last sample so far, also where it fell.  ``events`` has ``kind``; each of ``kinds`` gets a
    column.  The first of ``values`` also comes per minute.
    """
    ends = games.select(*keys, last_interval(F.col("duration_s"), width).alias("_last"))
    clamp = F.least(bucket(F.col(at), width), F.col("_last"))
    last = F.max_by(F.struct(*values), F.struct(at, *values)).alias("_v")
    top = samples.join(ends, list(keys)).withColumn("interval", clamp).groupBy(*keys, "interval").agg(last)
    counted = events.join(ends, list(keys)).withColumn("interval", clamp).groupBy(*keys, "interval").agg(*(zero_sum(F.lit(1), F.col("kind") == k).alias(k) for k in kinds))
    so_far = Window.partitionBy(*keys).orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    grid = whole_grid(games, keys, width)
    carried = grid.join(top, [*keys, "interval"], "left").withColumn("_v", F.last("_v", ignorenulls=True).over(so_far))
    filled = carried.select(*grid.columns, *(F.coalesce(F.col("_v")[v], F.lit(0)).alias(v) for v in values))
    out = gains(filled, keys, values, ["end_s"]).join(counted, [*keys, "interval"], "left")
    out = out.withColumns({k: F.coalesce(k, F.lit(0)) for k in kinds})
    return out.withColumn("per_min", ratio(60.0 * F.col(values[0]), F.col("end_s") - F.col("interval") * width))


def movement_buckets(minutes: DataFrame, games: DataFrame, keys: Sequence[str], width: int, states: Sequence[str]) -> DataFrame:
    """Minute rows in wider buckets: sums and shares as of ``movement_shares``; empty buckets stay.

    Buckets go up to the game's end, and further where there are minutes after it; ``end_s`` is never after the end.
    """
    interval, counted = F.floor(F.col("start_s") / width).cast("long"), ("alive_s", "moving_s", "distance", *states)
    sums = minutes.withColumn("interval", interval).groupBy(*keys, "interval").agg(*(F.sum(c).alias(c) for c in counted))
    ends = sums.groupBy(*keys).agg(F.max("interval").alias("_moved"))
    last = F.greatest(last_interval(F.col("duration_s"), width), F.coalesce("_moved", F.lit(0)))
    grid = games.select(*keys, "duration_s").join(ends, list(keys), "left").select(*keys, "duration_s", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("interval"))
    grid = grid.select(*keys, "interval", (F.col("interval") * width).alias("start_s"), F.least((F.col("interval") + 1) * width, "duration_s").cast("long").alias("end_s"))
    out = grid.join(sums, [*keys, "interval"], "left")
    return movement_shares(out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counted}), states)


#: States that are told of the seconds that someone could move in; all others are of the seconds alive.
OF_MOVING = ("stationary_s",)


def movement_shares(sums: DataFrame, states: Sequence[str]) -> DataFrame:
    """Percents of the states, standing still of the moving seconds and the others of those alive; ``pace`` is the way in a moving minute."""
    shares = {f"{s.removesuffix('_s')}_percent": ratio(100.0 * F.col(s), F.col("moving_s" if s in OF_MOVING else "alive_s")) for s in states}
    return sums.withColumns(shares | {"pace": ratio(60.0 * F.col("distance"), F.col("moving_s"))})


def movement_totals(minutes: DataFrame, keys: Sequence[str], states: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """A player's whole game: sums, percents, pace, and the counts per minute alive."""
    sums = minutes.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("alive_s", "moving_s", "distance", *states, *counts)))
    return movement_shares(sums, states).withColumns({f"{c}_per_min": ratio(60.0 * F.col(c), F.col("alive_s")) for c in counts})


def phases(deaths: DataFrame, at: str, breaks: Sequence[float], labels: Sequence[str], games: int | Column, value: str, flags: Sequence[str]) -> DataFrame:
    """Deaths by phase of the game: number, per game, median of a value, percent of each flag."""
    rows = deaths.withColumn("phase", binned(F.col(at), breaks, labels))
    per = F.lit(games) if isinstance(games, int) else games
    return rows.groupBy("phase").agg(
        F.count(F.lit(1)).alias("deaths"), ratio(F.count(F.lit(1)), F.first(per)).alias("per_game"), F.median(value).alias(f"median_{value}"), *((100.0 * F.avg(F.col(f).cast("double"))).alias(f"{f}_percent") for f in flags)
    )


def enemy_interval_counts(events: DataFrame, games: DataFrame, keys: Sequence[str], enemy: str, at: str, width: int) -> DataFrame:
    """How often each enemy appears in a game's intervals; later events count in the last one."""
    ends = games.select(*keys, last_interval(F.col("duration_s"), width).alias("_last"))
    rows = events.join(ends, list(keys)).withColumn("interval", F.least(bucket(F.col(at), width), F.col("_last")))
    return rows.groupBy(*keys, enemy, "interval").agg(F.count(F.lit(1)).alias("n"))


def objective_timeline(parts: Sequence[tuple[str, DataFrame]], match: str, at: str, team: str, my_team: DataFrame) -> DataFrame:
    """Events of several kinds in order of time, each seen from one side: ``mine`` or ``theirs``.

    ``parts`` are (kind, rows with match, time and the team that gains); ``my_team`` has one row per match.
    """
    rows = None
    for kind, part in parts:
        part = part.select(match, F.col(at).alias("at"), F.col(team).alias("team"), F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.join(my_team.select(match, F.col("team").alias("_mine")), match).withColumn("side", F.when(F.col("team") == F.col("_mine"), "mine").otherwise("theirs"))
    place = F.row_number().over(Window.partitionBy(match).orderBy("at", "kind", "team"))
    return out.withColumn("n", place).drop("_mine")


def distance(a: Sequence[Column], b: Sequence[Column], unit: float = 1.0) -> Column:
    """Straight way between two positions; null where a coordinate is missing."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))) / unit


def buff_sources(taken: DataFrame, jackpots: DataFrame, bosses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where a game's buffs come from: four of each jackpot, two of each boss, the rest (never below 0) collected."""
    out = taken.join(jackpots, list(keys), "left").join(bosses, list(keys), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("jackpots", "bosses")})
    out = out.withColumns({"from_jackpots": F.col("jackpots") * 4, "from_bosses": F.col("bosses") * 2})
    return out.withColumn("collected", F.greatest(F.col("taken") - F.col("from_jackpots") - F.col("from_bosses"), F.lit(0)))


def enemy_totals(damage: DataFrame, games: DataFrame, players: DataFrame, match: str, mine: str, other: str, value: str) -> DataFrame:
    """What a game's player exchanged with each enemy in all, from final figures: a whole-game twin of the intervals.

    ``damage`` has the dealer and the target; ``mine`` is the side that ``games`` (match, account_id) names, ``other`` the
    enemy's.  ``players`` give the enemy's hero and team.  Games without figures have no rows; rows of 0 don't count.
    """
    wanted = games.select(match, "account_id").distinct()
    rows = damage.where(F.col(other).isNotNull() & (F.col(value) != 0)).select(match, F.col(mine).alias("account_id"), F.col(other).alias("enemy_account_id"), value)
    per = rows.join(wanted, [match, "account_id"], "left_semi").groupBy(match, "account_id", "enemy_account_id").agg(F.sum(value).alias(value))
    enemies = players.select(match, F.col("account_id").alias("enemy_account_id"), F.col("hero_id").alias("enemy_hero_id"), F.col("team").alias("enemy_team"))
    return per.join(enemies, [match, "enemy_account_id"], "left")


def differing_totals(totals: DataFrame, intervals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose final figure is not the sum of its intervals, with both; none where the two tables agree."""
    summed = intervals.groupBy(*keys).agg(F.sum(value).alias("from_intervals")).where("from_intervals != 0")
    both = totals.select(*keys, F.col(value).alias("final")).join(summed, list(keys), "full")
    return both.where(~F.col("final").eqNullSafe(F.col("from_intervals")))
