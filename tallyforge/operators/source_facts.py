"""Damage or healing by source over a hero's games, with what was paid for the items among the sources.

``games``: keys, ``game_minutes``, one row per game; ``detail``: keys, ``source_class``, ``source_name``, ``delivery``,
``amount``, ``self_amount``, one row per game and source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import ratio, zero_sum


def owned_minutes(windows: DataFrame, keys: Sequence[str], source: str = "source_class") -> DataFrame:
    """Minutes for which each item source was owned in a game, all its buys together; ``windows``: owned_from, owned_to."""
    return windows.groupBy(*keys, source).agg((F.sum(F.col("owned_to") - F.col("owned_from")) / 60.0).alias("owned_minutes"))


def outlay(costs: DataFrame, keys: Sequence[str], source: str = "source_class") -> DataFrame:
    return costs.groupBy(*keys, source).agg(F.sum("effective_cost").alias("effective_cost"))


def source_rows(detail: DataFrame, games: DataFrame, owned: DataFrame, costs: DataFrame, keys: Sequence[str], named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The detail rows with each item's ``owned_minutes`` and ``effective_cost``, and rows for games where it was silent.

    Only sources that dealt something in some game take part, in the games of ``games``.  An item that was owned in a game
    and dealt nothing there has a row with the amount 0, labelled by ``named`` (adds ``source_name`` and ``delivery``).
    Every row carries its game's length; sources without buys have 0 minutes and souls.  Null sources and null keys are
    values like others.
    """
    on = [*keys, "source_class"]
    dealt = detail.select("source_class").distinct()
    of_games = lambda facts: facts.join(dealt, "source_class", "left_semi").join(games.select(*keys), list(keys), "left_semi")
    facts = None
    for part in (of_games(owned).withColumn("effective_cost", F.lit(None).cast("long")), of_games(costs).withColumn("owned_minutes", F.lit(None).cast("double"))):
        facts = part if facts is None else facts.unionByName(part)
    facts = facts.groupBy(*on).agg(F.sum("owned_minutes").alias("owned_minutes"), F.sum("effective_cost").alias("effective_cost"))
    facts = named(facts).select(*(F.col(c).alias(f"_{c}") for c in on), "owned_minutes", "effective_cost", F.col("source_name").alias("_name"), F.col("delivery").alias("_delivery"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    rows = detail.join(facts, same, "full").select(
        *(F.coalesce(c, f"_{c}").alias(c) for c in on), F.coalesce("source_name", "_name").alias("source_name"), F.coalesce("delivery", "_delivery").alias("delivery"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("amount", "self_amount", "owned_minutes", "effective_cost")),
    )
    return rows.join(games, list(keys), "left")


def by_grain(rows: DataFrame, games: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Measures of ``source_rows`` by any of its columns.

    A game counts once in a group, with its length, and only if something was dealt in it: rows are first summed by group
    and game, then by group.  Shares are of everything dealt, ``per_window_game`` and ``per_window_min`` of all games.
    """
    dealt = F.col("amount") != 0
    one = rows.groupBy(*by, *(F.col(k).alias(f"_{k}") for k in keys)).agg(
        zero_sum(F.col("amount")).alias("amount"), zero_sum(F.col("self_amount")).alias("self_amount"), zero_sum(F.col("owned_minutes")).alias("owned_minutes"),
        zero_sum(F.col("effective_cost")).alias("effective_cost"), F.max(F.when(dealt, F.col("game_minutes"))).alias("_minutes"), F.max(F.when(dealt, 1)).alias("_dealt"),
    )
    per = one.groupBy(*by).agg(
        F.count("_dealt").alias("games"), F.sum("amount").alias("total"), zero_sum(F.col("_minutes")).alias("minutes"),
        F.sum("owned_minutes").alias("owned_minutes"), F.sum("effective_cost").alias("outlay"), F.sum("self_amount").alias("self"),
    )
    window = games.select(*keys, "game_minutes").distinct().agg(F.count(F.lit(1)).alias("_games"), F.sum("game_minutes").alias("_all_minutes"))
    whole = rows.agg(F.sum("amount").alias("_all"))
    out = per.crossJoin(F.broadcast(window)).crossJoin(F.broadcast(whole))  # one row each
    total = F.col("total")
    return out.select(
        *by, "games", "total", "minutes", "owned_minutes", "outlay", "self", ratio(total, F.col("games")).alias("per_game"), ratio(total, F.col("minutes")).alias("per_min"),
        ratio(total, F.col("owned_minutes")).alias("per_min_owned"), ratio(1000.0 * total, F.col("outlay")).alias("per_1k"), ratio(100.0 * total, F.col("_all")).alias("percent"),
        ratio(total, F.col("_games")).alias("per_window_game"), ratio(total, F.col("_all_minutes")).alias("per_window_min"),
    )


def by_source(rows: DataFrame, games: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per source that dealt anything in all, by name, class and delivery."""
    return by_grain(rows, games, ["source_name", "source_class", "delivery"], keys).where("total != 0")
