"""Totals by source and per game: damage, healing, souls, counters, and what an item or a hero made of them.

A game is a match and an account (``keys``); ``games`` has one row per game with its length ``duration_s``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import ratio, zero_sum


def final_values(samples: DataFrame, keys: Sequence[str], source: str, value: str) -> DataFrame:
    """Each source's largest total in a game; sources that stayed at 0 are left out."""
    return samples.groupBy(*keys, source).agg(F.max(value).alias(value)).where(F.col(value) != 0)


def game_split(finals: DataFrame, games: DataFrame, keys: Sequence[str], kind: Column, kinds: Sequence[str], value: str) -> DataFrame:
    """One row per game: its total, the part of each kind, and the kinds' percents, null where the total is 0."""
    per = finals.withColumn("_kind", kind).groupBy(*keys).agg(zero_sum(F.col(value)).alias("total"), *(zero_sum(F.col(value), F.col("_kind") == k).alias(k) for k in kinds))
    joined = games.select(*keys).join(per, list(keys), "left")
    filled = joined.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", *kinds)))
    return filled.select("*", *(ratio(100.0 * F.col(k), F.col("total")).alias(f"{k}_percent") for k in kinds))


def healing_split(healing: DataFrame, prevented: DataFrame, keys: Sequence[str], own: Column, value: str) -> DataFrame:
    """Per game: healing, of it on oneself, and prevented damage; a game with only one of both is kept."""
    healed = healing.groupBy(*keys).agg(zero_sum(F.col(value)).alias("healing"), zero_sum(F.col(value), own).alias("self_healing"))
    kept = prevented.groupBy(*keys).agg(zero_sum(F.col(value)).alias("prevented"))
    out = healed.join(kept, list(keys), "full")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("healing", "self_healing", "prevented")))


def souls_by_source(finals: DataFrame, games: DataFrame, keys: Sequence[str], source: str, souls: str, orbs: str, match: Sequence[str] | None = None) -> DataFrame:
    """Per income source: games, souls (orbs included), orbs, minutes of its games, percent of all and share of orbs.

    With ``match`` the minutes count a match once in a source, however many of its players are among the games.
    """
    rows, match = finals.join(games.select(*keys, "duration_s"), list(keys)), list(match or keys)
    one = rows.groupBy(source, *(F.col(k).alias(f"_{k}") for k in match)).agg(
        F.count(F.lit(1)).alias("games"), F.sum(F.col(souls) + F.col(orbs)).alias("souls"), F.sum(orbs).alias("orbs"), F.max("duration_s").alias("duration_s")
    )
    per = one.groupBy(source).agg(F.sum("games").alias("games"), F.sum("souls").alias("souls"), F.sum("orbs").alias("secured_orbs"), (F.sum("duration_s") / 60.0).alias("minutes"))
    whole = per.agg(F.sum("souls").alias("_all"))
    out = per.crossJoin(F.broadcast(whole))  # one row
    return out.withColumns({"percent": ratio(100.0 * F.col("souls"), F.col("_all")), "orb_share": ratio(100.0 * F.col("secured_orbs"), F.col("souls"))}).drop("_all")


def counter_totals(counters: DataFrame, by: Sequence[str], name: str, value: str, wanted: Sequence[str], shares: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Sums of the wanted counters by key, and percents of one sum in another (``shares``: name to part and whole)."""
    sums = counters.where(F.col(name).isin(list(wanted))).groupBy(*by).agg(*(zero_sum(F.col(value), F.col(name) == w).alias(w) for w in wanted))
    return sums.select("*", *(ratio(100.0 * F.col(a), F.col(b)).alias(n) for n, (a, b) in shares.items()))


def custom_totals(finals: DataFrame, games: Sequence[str], group: str, stat: str, value: str) -> DataFrame:
    """Per group and stat: games, sum and mean of the games' final values."""
    per = finals.groupBy(*games, group, stat).agg(F.max(value).alias(value))
    return per.groupBy(group, stat).agg(F.count(F.lit(1)).alias("games"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def dealt_and_taken(hits: DataFrame, players: DataFrame, match: Sequence[str], by: str, target: str, value: str) -> DataFrame:
    """Per player of a match: what was dealt to and taken from others, 0 where there was nothing."""
    dealt = hits.groupBy(*match, F.col(by).alias("account_id")).agg(F.sum(value).alias("dealt"))
    taken = hits.groupBy(*match, F.col(target).alias("account_id")).agg(F.sum(value).alias("taken"))
    out = players.join(dealt, [*match, "account_id"], "left").join(taken, [*match, "account_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dealt", "taken")})


def item_games(games: DataFrame, buys: DataFrame, gained: DataFrame, keys: Sequence[str], item: Column, at: Sequence[str], tier: int | Column | None = None, costs: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """One row per game, also of games without the item: whether it was built, its first buy, that buy's place among all
    buys and among those of its tier, and what was gained while it was owned.

    ``buys``: keys, ``at``, ``tier``; ``gained``: keys and ``gained``.  With ``name``, the buys' column of names, also what
    was bought first of the item's tier (``tier`` in games without it) and whether that was the item; with ``costs`` (keys,
    ``effective_cost``) the souls put into it, null without a buy.
    """
    from tallyforge.operators.items import buy_order

    placed = buy_order(buy_order(buys, keys, at, "buy_n"), [*keys, "tier"], at, "tier_buy_n").withColumn("_is", item)
    buy = F.struct(F.col(at[0]).alias("bought_at"), "buy_n", "tier_buy_n", F.col("tier").alias("item_tier"))
    first = placed.where("_is").groupBy(*keys).agg(F.min_by(buy, F.struct(*at)).alias("_f")).select(*keys, "_f.*")
    out = games.join(first, list(keys), "left").join(gained, list(keys), "left")
    out = out.withColumn("built", F.col("bought_at").isNotNull()).withColumn("gained", F.coalesce("gained", F.lit(0)))
    if costs is not None:
        out = out.join(costs.groupBy(*keys).agg(F.sum("effective_cost").alias("effective_cost")), list(keys), "left")
    if name is not None:
        of_tier = placed.where("tier_buy_n = 1").select(*keys, F.col("tier").alias("item_tier"), F.col(name).alias("first_of_tier"), F.col(at[0]).alias("first_of_tier_at"), F.col("_is").alias("is_first_of_tier"))
        out = out.withColumn("item_tier", F.coalesce("item_tier", F.lit(tier) if not isinstance(tier, Column) else tier)).join(of_tier, [*keys, "item_tier"], "left")
    return out if name is not None else out.drop("item_tier")


def built_summary(rows: DataFrame, won: Column) -> DataFrame:
    """Games with and without the item: number, wins, win percent, mean gain and gain per owned minute."""
    out = rows.groupBy("built").agg(F.count(F.lit(1)).alias("games"), F.sum(won.cast("long")).alias("wins"), F.avg("gained").alias("mean_gained"), zero_sum(F.col("gained")).alias("_g"), zero_sum(F.col("owned_s")).alias("_s"))
    return out.select("built", "games", "wins", ratio(100.0 * F.col("wins"), F.col("games")).alias("win_percent"), "mean_gained", ratio(60.0 * F.col("_g"), F.col("_s")).alias("per_min_owned"))


def item_core(builds: DataFrame, build: Sequence[str], item: str, won: Column, least: float, at: str | None = None, facts: Sequence[str] = ()) -> DataFrame:
    """Items in ``least`` percent or more of the won builds, with their percent of the lost ones, 0 where in none.

    With ``at`` also the median of an item's latest time in won builds; ``facts`` are columns of the item, as its slot.
    """
    latest = [F.max(at).alias("at")] if at else []
    one = builds.groupBy(*build, F.col(item).alias("item"), won.alias("won")).agg(*latest, *(F.max(f).alias(f) for f in facts), F.lit(1).alias("_n")).drop("_n")
    n = builds.select(*build, won.alias("won")).distinct().agg(zero_sum(F.col("won").cast("long")).alias("_w"), zero_sum((~F.col("won")).cast("long")).alias("_l"))
    times = [F.median(F.when(F.col("won"), F.col("at"))).alias("median_at")] if at else []
    per = one.groupBy("item").agg(zero_sum(F.col("won").cast("long")).alias("wins"), zero_sum((~F.col("won")).cast("long")).alias("losses"), *times, *(F.max(f).alias(f) for f in facts))
    out = per.crossJoin(F.broadcast(n))  # one row
    loss = F.coalesce(ratio(100.0 * F.col("losses"), F.col("_l")), F.lit(0.0))
    out = out.select("item", ratio(100.0 * F.col("wins"), F.col("_w")).alias("win_share"), loss.alias("loss_share"), *(["median_at"] if at else []), *facts)
    return out.where(F.col("win_share") >= least)


def consumed_into(consumed: DataFrame, buys: DataFrame, closure: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """For each component used up, the item bought at that moment that is made of it: the closest, then the lowest."""
    hit = consumed.join(closure, "component").join(buys.select(*keys, at, "item"), [*keys, at, "item"])
    return hit.groupBy(*keys, at, "component").agg(F.min_by("item", F.struct("depth", "item")).alias("item"))


def first_choice_split(events: DataFrame, games: DataFrame, keys: Sequence[str], choice: str, order: Sequence[str], won: Column) -> DataFrame:
    """Games by the first of their choices: number and win percent; games without any have the choice null."""
    first = events.groupBy(*keys).agg(F.min_by(choice, F.struct(*order)).alias(choice))
    return games.join(first, list(keys), "left").groupBy(choice).agg(F.count(F.lit(1)).alias("games"), (100.0 * F.avg(won.cast("double"))).alias("win_percent"))


def bucket_rates(rows: DataFrame, bucket: str, hero: Column, won: Column) -> DataFrame:
    """Per bucket: all picks, the hero's picks and wins, pick percent and win percent."""
    out = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("picks"), zero_sum(F.lit(1), hero).alias("hero_picks"), zero_sum(F.lit(1), hero & won).alias("hero_wins"))
    return out.withColumns({"pick_percent": ratio(100.0 * F.col("hero_picks"), F.col("picks")), "win_percent": ratio(100.0 * F.col("hero_wins"), F.col("hero_picks"))})
