"""Ratings and archives: change of points, season standing, eligibility, coverage, records by mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import zero_sum

#: Points in a subrank, in the sixth of a tier, and in a tier; the tier whose levels are no matter of points.
SUBRANK, LAST_SUBRANK, TIER, TOP_TIER = 1000, 2000, 7000, 11


def points_change(start: Column, end: Column, placing: Column) -> Column:
    """The points a match gave, null while placing or where one side is unknown."""
    return F.when(~placing, end - start)


def subrank_span(badge: Column) -> Column:
    """Points that a badge's subrank takes; null in the top tier and without a badge."""
    return F.when((badge > 0) & (F.floor(badge / 10) != TOP_TIER), F.when(badge % 10 == 6, LAST_SUBRANK).otherwise(SUBRANK))


def subrank_floor(badge: Column) -> Column:
    """Points at which a badge's subrank begins; null as of ``subrank_span``."""
    return F.when(subrank_span(badge).isNotNull(), (F.floor(badge / 10) - 1) * TIER + (badge % 10 - 1) * SUBRANK)


def season_standing(games: DataFrame, by: Sequence[str], order: Sequence[str], badge: str, points: str, change: Column, won: Column) -> DataFrame:
    """Newest badge and points, how far these are into the subrank and what it takes, won and lost games, net points.

    The net counts games with a badge only: placing moves no rating.  Without a badge there are no points either.
    """
    newest = F.max_by(F.struct(badge, points), F.struct(*order)).alias("_r")
    placed = F.col(badge) > 0
    out = games.groupBy(*by).agg(
        newest, F.sum(won.cast("long")).alias("wins"), F.sum((~won).cast("long")).alias("losses"), zero_sum(change, placed).alias("net_points"), zero_sum(F.lit(1), placed).alias("placed_games")
    )
    held, reached = F.col(f"_r.{badge}"), F.when(F.col(f"_r.{badge}") > 0, F.col(f"_r.{points}"))
    return out.select(*by, held.alias(badge), reached.alias(points), (reached - subrank_floor(held)).alias("into_subrank"), subrank_span(held).alias("subrank_points"), "wins", "losses", "net_points", "placed_games")


def eligibility(games: DataFrame, account: str, hero: str, won: Column, bar: int) -> DataFrame:
    """Heroes with at least ``bar`` won games per account, and all its wins."""
    per = games.groupBy(account, hero).agg(zero_sum(won.cast("long")).alias("wins"))
    return per.groupBy(account).agg(zero_sum(F.lit(1), F.col("wins") >= bar).alias("heroes"), F.sum("wins").alias("wins"))


def coverage(games: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    return games.groupBy(*by).agg(F.count(F.lit(1)).alias("games"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def record_without(games: DataFrame, by: Sequence[str], won: Column, left: Column) -> DataFrame:
    """Wins and losses, and the same without the games that somebody left."""
    lost = ~won
    return games.groupBy(*by).agg(
        zero_sum(won.cast("long")).alias("wins"), zero_sum(lost.cast("long")).alias("losses"), zero_sum((won & ~left).cast("long")).alias("wins_without"), zero_sum((lost & ~left).cast("long")).alias("losses_without")
    )
