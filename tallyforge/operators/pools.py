"""Pools of tracked players: their games, their summary, their builds, and ladder positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool_games(ledger: DataFrame, watchlist: DataFrame, games: DataFrame, wanted: Column, match: str, account: str) -> DataFrame:
    """Ledger rows (``rank``, ``at``) of watched accounts in games of the wanted mode, one per match and account.

    Of repeated rows the best rank and the newest time stay.
    """
    kept = ledger.join(watchlist.select(account), account, "left_semi").join(games.where(wanted).select(match), match, "left_semi")
    return kept.groupBy(match, account).agg(F.min("rank").alias("rank"), F.max("at").alias("at"))


def pool_members(watchlist: DataFrame, pool: DataFrame, account: str) -> DataFrame:
    """Every watched account with its games, best rank and newest time; without games 0, null and null."""
    found = pool.groupBy(account).agg(F.count(F.lit(1)).alias("games"), F.min("rank").alias("rank"), F.max("at").alias("at"))
    return watchlist.join(found, account, "left").na.fill(0, ["games"])


def pool_builds(pool: DataFrame, events: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each pool game's purchases in order, as the array ``seq`` of ``fields``; a game's purchases are bounded."""
    seq = F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))
    rows = events.join(pool.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(seq.alias("seq"))
    return rows.withColumn("seq", F.transform("seq", lambda e: F.struct(*(e[f].alias(f) for f in fields))))


def ladder_positions(boards: DataFrame, ids: str, board: str, rank: str, account: str) -> DataFrame:
    """Each account's best place over all boards; entries whose name fits several accounts, or none, are left out."""
    sure = boards.where(F.size(ids) == 1).select(F.element_at(ids, 1).alias(account), F.struct(F.col(rank).alias("rank"), F.col(board).alias("board")).alias("place"))
    return sure.groupBy(account).agg(F.min("place").alias("place")).select(account, "place.rank", "place.board")
