"""Figures of a game's reports: final counters, ranges, uptimes, medians of two pools, value of an item, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import ratio, share_of, zero_sum
from tallyforge.operators.timeline import distance


def custom_stats(samples: DataFrame, players: DataFrame, keys: Sequence[str], stat: str, value: str, order: Sequence[str], wanted: Column | None = None, final: bool = True) -> DataFrame:
    """Counters of games with their player's columns: the last value of each, or with ``final`` off every sample."""
    rows = samples if wanted is None else samples.where(wanted)
    if final:
        rows = rows.groupBy(*keys, stat).agg(F.max_by(value, F.struct(*order)).alias(value))
    return rows.join(players, list(keys))


def taken_by_attacker(hits: DataFrame, players: DataFrame, match: str, by: str, target: str, value: str) -> DataFrame:
    """What each player of a match took from each attacker, with the attacker's columns of ``players``."""
    per = hits.groupBy(match, target, by).agg(F.sum(value).alias("taken"))
    return per.join(players, [match, by], "left")


def combat_rows(games: DataFrame, counters: DataFrame, gun: DataFrame, keys: Sequence[str], name: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """One row per game with its counters and its gun damage, 0 where nothing was tracked."""
    wide = counters.where(F.col(name).isin(list(wanted))).groupBy(*keys).agg(*(zero_sum(F.col(value), F.col(name) == w).alias(w) for w in wanted))
    dealt = gun.groupBy(*keys).agg(F.sum(value).alias("gun_damage"))
    out = games.join(wide, list(keys), "left").join(dealt, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in (*wanted, "gun_damage")})


def shares_of_group(counters: DataFrame, group: Sequence[str], bucket: str, value: str) -> DataFrame:
    """Each bucket's sum and its percent of its group: ranges of distance, falloff of bullets."""
    per = counters.groupBy(*group, bucket).agg(F.sum(value).alias(value))
    return per.withColumn("percent", share_of(F.col(value), *group))


def stack_uptime(counters: DataFrame, keys: Sequence[str], stat: str, value: str) -> DataFrame:
    """Seconds and percent of time at each number of stacks, from counters named ``<ability>TimeAt_<n>_stacks``."""
    pattern = r"^(.+)TimeAt_(\d+)_stacks$"
    rows = counters.where(F.col(stat).rlike(pattern))
    named = rows.withColumns({"ability": F.regexp_extract(stat, pattern, 1), "stacks": F.regexp_extract(stat, pattern, 2).cast("long")})
    return shares_of_group(named, [*keys, "ability"], "stacks", value)


def held_on_average(counters: DataFrame, games: DataFrame, keys: Sequence[str], name: str, value: str, minutes: Sequence[str]) -> DataFrame:
    """Counters of amount times minutes, divided by the game's minutes; a game of no length has nulls."""
    sums = counters.where(F.col(name).isin(list(minutes))).groupBy(*keys).agg(*(zero_sum(F.col(value), F.col(name) == m).alias(m) for m in minutes))
    out = games.select(*keys, "duration_s").join(sums, list(keys))
    return out.select(*keys, *(ratio(60.0 * F.col(m), F.col("duration_s")).alias(f"{m}_held") for m in minutes))


def pool_medians(gains: DataFrame, mine: Column, interval: str, value: str, least: int = 3, lower_is_better: bool = False) -> DataFrame:
    """Medians of two pools by interval, their gap, its running sum and the interval where mine falls short the most, if any.

    It ends before the first interval that fewer than ``least`` rows of either pool reach.  There is one row per
    interval of a game, so the windows over all of them are small.
    """
    rows = gains.withColumn("_mine", mine)
    side = lambda which: F.when(F.col("_mine") == F.lit(which), F.col(value))
    per = rows.groupBy(interval).agg(F.median(side(True)).alias("mine"), F.median(side(False)).alias("theirs"), F.count(side(True)).alias("n_mine"), F.count(side(False)).alias("n_theirs"))
    order = Window.orderBy(interval)
    enough = (F.least("n_mine", "n_theirs") >= least) & (F.col(interval) == F.row_number().over(order) - 1)
    kept = per.withColumn("_enough", enough).withColumn("_all", F.bool_and("_enough").over(order)).where("_all").drop("_enough", "_all")
    gap = F.col("mine") - F.col("theirs")
    out = kept.withColumn("gap", gap).withColumn("running_gap", F.sum("gap").over(order))
    behind = F.col("gap") if lower_is_better else -F.col("gap")
    return out.withColumn("worst", (F.row_number().over(Window.orderBy(F.desc(behind), interval)) == 1) & (behind > 0))


def milestone_medians(times: DataFrame, target: str, minutes: str, targets: Sequence[float], least: int = 3) -> DataFrame:
    """Median time to each target; it ends before the first target that fewer than ``least`` games reach."""
    per = times.groupBy(target).agg(F.median(minutes).alias("minutes"), F.count(F.lit(1)).alias("games"))
    asked = times.sparkSession.createDataFrame([(t,) for t in sorted(targets)], f"{target} {times.schema[target].dataType.simpleString()}")
    out = asked.join(per, target, "left").withColumn("_all", F.bool_and(F.coalesce("games", F.lit(0)) >= least).over(Window.orderBy(target)))
    return out.where("_all").drop("_all")


def item_attribution(events: DataFrame, damage: DataFrame, class_name: str, source: str) -> DataFrame:
    """``proc`` for items that ever deal damage under their own name, ``stat`` for the others."""
    procs = damage.where(F.col(source).startswith("upgrade_")).select(F.col(source).alias(class_name)).distinct().withColumn("_proc", F.lit(True))
    return events.join(procs, class_name, "left").withColumn("attribution", F.when(F.col("_proc"), "proc").otherwise("stat")).drop("_proc")


def item_value(windows: DataFrame, damage: DataFrame, keys: Sequence[str], value: str, dealt: str) -> DataFrame:
    """One row about an item: games with it, seconds owned, its damage, that per minute and in percent of all dealt while owned.

    ``windows``: keys, owned_from, owned_to and ``dealt`` of each time of ownership; ``damage``: keys and ``value`` per game.
    """
    per = windows.groupBy(*keys).agg(F.sum(F.col("owned_to") - F.col("owned_from")).alias("owned_s"), F.sum(dealt).alias("_dealt"))
    sums = per.join(damage.groupBy(*keys).agg(F.sum(value).alias("_damage")), list(keys), "left")
    out = sums.agg(F.count(F.lit(1)).alias("builds"), zero_sum(F.col("_damage")).alias("damage"), zero_sum(F.col("owned_s")).alias("owned_s"), zero_sum(F.col("_dealt")).alias("dealt_after_buy"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.withColumns({"per_min": zero(ratio(60.0 * F.col("damage"), F.col("owned_s"))), "percent_of_dealt": zero(ratio(100.0 * F.col("damage"), F.col("dealt_after_buy")))})


def farm_pace(movement: DataFrame, farm: DataFrame, games: DataFrame, keys: Sequence[str], source: str, value: str, sources: Sequence[str]) -> DataFrame:
    """Adds the souls farmed to a game's movement: per minute, and per 1,000 units of way."""
    finals = farm.where(F.col(source).isin(list(sources))).groupBy(*keys, source).agg(F.max(value).alias(value))
    souls = finals.groupBy(*keys).agg(F.sum(value).alias("farm_souls"))
    out = movement.join(souls, list(keys), "left").join(games.select(*keys, "duration_s"), list(keys))
    return out.withColumns({"farm_min": ratio(60.0 * F.col("farm_souls"), F.col("duration_s")), "souls_per_1000_units": ratio(1000.0 * F.col("farm_souls"), F.col("distance"))})


def kill_log(deaths: DataFrame, sides: DataFrame, match: str, victim: str, killer: str, here: Sequence[str], there: Sequence[str], unit: float) -> DataFrame:
    """Deaths with both sides' columns and the way between them in ``unit``s, null where a place is missing.

    ``sides``: match, account_id and further columns, which come as ``victim_...`` and ``killer_...``.
    """
    out = deaths
    for key, prefix in ((victim, "victim"), (killer, "killer")):
        more = [c for c in sides.columns if c not in (match, "account_id")]
        out = out.join(sides.select(match, F.col("account_id").alias(key), *(F.col(c).alias(f"{prefix}_{c}") for c in more)), [match, key], "left")
    return out.withColumn("killer_distance", distance([F.col(c) for c in here], [F.col(c) for c in there], unit))


def tracked_games(downloads: DataFrame, players: DataFrame, names: Sequence[str], keys: Sequence[str], name: str = "player") -> DataFrame:
    """Games of the players named, in any case, each once per player and game."""
    asked = downloads.where(F.lower(name).isin([n.lower() for n in names])).select(*keys, name).distinct()
    return asked.join(players, list(keys))
