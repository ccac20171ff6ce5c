"""The laning phase: every player at a mark, lanes side against side, and one player's record of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import any_true, zero_sum


def laning_stats(players: DataFrame, samples: DataFrame, deaths: DataFrame, mark: float, values: Sequence[str], order: Sequence[str], match: str = "match_id", account: str = "account_id") -> DataFrame:
    """Every player with the last sample at or before the mark, and the kills and deaths up to it.

    ``samples`` and ``deaths`` have ``t``; ``deaths`` has ``killer``.  Values without a sample are 0, ``snap_t`` null.
    """
    keys = [match, account]
    last = F.max_by(F.struct(*values, F.col("t").alias("snap_t")), F.struct(*order))
    snaps = samples.where(F.col("t") <= mark).groupBy(*keys).agg(last.alias("s")).select(*keys, "s.*")
    died = deaths.where(F.col("t") <= mark)
    fell = died.groupBy(*keys).agg(F.count(F.lit(1)).alias("deaths"))
    killed = died.where("killer IS NOT NULL").groupBy(match, F.col("killer").alias(account)).agg(F.count(F.lit(1)).alias("kills"))
    out = players
    for part in (snaps, killed, fell):
        out = out.join(part, keys, "left")
    return out.na.fill(0, [*values, "kills", "deaths"])


def lane_sums(laned: DataFrame, values: Sequence[str], match: str = "match_id", lane: str = "lane", team: str = "team") -> DataFrame:
    """Sums of each side of each lane and, for two teams 0 and 1, its lead over the other side (``<value>_gap``)."""
    sums = [zero_sum(F.col(v), F.col(team) == side).alias(f"{v}{side}") for v in values for side in (0, 1)]
    both = laned.groupBy(match, lane).agg(*sums)
    return both.select(match, lane, *(c for v in values for c in (F.col(f"{v}0"), F.col(f"{v}1"), (F.col(f"{v}0") - F.col(f"{v}1")).alias(f"{v}_gap"))))


def lane_records(mine: DataFrame, players: DataFrame, laned: DataFrame, value: str, left: str, match: str = "match_id", account: str = "account_id") -> DataFrame:
    """One row per match of ``mine`` (one own player each): how the own lane stood at the mark.

    ``laned`` is what ``laning_stats`` gives.  ``lane_net`` is own side less enemy side; a match where a laner has no
    sample is left out.  ``worst_early`` is the most deaths of one team mate, ``ally_left`` whether one has ``left``.
    The lobby is read in one pass: its rows meet the own player's by the match, then one aggregation tells all.
    """
    own = mine.select(match, F.col(account).alias("_me"), F.col("team").alias("_team"), F.col("lane").alias("_lane"))
    lobby = players.select(match, account, left).join(laned, [match, account]).join(own, match)
    mate = (F.col("team") == F.col("_team")) & (F.col(account) != F.col("_me"))
    in_lane = F.col("lane") == F.col("_lane")
    same = F.col("team") == F.col("_team")
    found = lobby.groupBy(match).agg(
        (zero_sum(F.col(value), in_lane & same) - zero_sum(F.col(value), in_lane & ~same)).alias("lane_net"),
        F.max(F.when(F.col(account) == F.col("_me"), F.col("deaths"))).alias("my_early"),
        F.coalesce(F.max(F.when(mate, F.col("deaths"))), F.lit(0)).alias("worst_early"),
        any_true(mate & F.col(left).isNotNull()).alias("ally_left"),
        any_true(in_lane & F.col("snap_t").isNull()).alias("_missing"),
    )
    return mine.join(found.where("NOT _missing").drop("_missing"), match)
