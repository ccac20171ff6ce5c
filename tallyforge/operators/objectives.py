"""Rift wins and urn deliveries, read off the souls that a team's players gain in one snapshot.

A rift pays all players of a team alike, by a formula of the minute it is won in; an urn pays the one who brings it, by a
formula of the minute it appeared in.  Both are found by solving the formula for the minute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the game: payouts by minute, first minutes, and when these rules began.
RIFT_BASE, RIFT_PER_MINUTE, RIFT_FIRST_MINUTE = 247, 37, 13
URN_BASE, URN_PER_MINUTE, URN_FIRST_MINUTE = 250, 70, 10
RULES_FROM = "2026-06-30 10:07:19"
#: How far from a whole minute a payout may lie, how many players must share it, and what a clock may be off by.
MINUTE_TOLERANCE, LEAST_SHARING, CLOCK_TOLERANCE = 0.05, 5, 0.5


def rift_minute(share: Column) -> Column:
    return (share - RIFT_BASE) / F.lit(float(RIFT_PER_MINUTE)) + RIFT_FIRST_MINUTE


def urn_minute(bounty: Column) -> Column:
    return (bounty - URN_BASE) / F.lit(float(URN_PER_MINUTE))


def increases(samples: DataFrame, keys: Sequence[str], at: str, total: Column, name: str) -> DataFrame:
    """What each sample of a running total adds to the one before, or to nothing; only increases."""
    before = F.lag("_total").over(Window.partitionBy(*keys).orderBy(at))
    rows = samples.withColumn("_total", total)
    return rows.withColumn(name, F.col("_total") - F.coalesce(before, F.lit(0))).drop("_total").where(F.col(name) > 0)


def comebacks(samples: DataFrame, roster: DataFrame, match: Sequence[str], player: str, at: str, value: str) -> DataFrame:
    """The comeback bonus of a team's snapshot: what it added for the team's first player (by number) with any."""
    gained = increases(samples, [*match, player], at, F.col(value), "_gain").join(roster.select(*match, player, "team"), [*match, player])
    return gained.groupBy(*match, "team", at).agg(F.min_by("_gain", player).alias("comeback"))


def rift_wins(gains: DataFrame, games: DataFrame, sizes: DataFrame, bonus: DataFrame, match: Sequence[str], at: str) -> DataFrame:
    """Snapshots in which a team won a rift: its ``payout``, ``comeback`` and ``minute``.

    ``gains``: match, team, ``at``, gain; ``games``: match, duration_s; ``sizes``: match, team, players; ``bonus`` as of
    ``comebacks``.  The payout is the gain that most players share (of several the largest), five at least and all but one
    of the team; less the comeback bonus it must be the formula's of a whole minute, not before the first rift and not
    more than a minute after the game's end.
    """
    group = [*match, "team", at]
    shared = gains.groupBy(*group, "gain").agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.max(F.struct("n", "gain")).alias("_m"))
    rows = shared.select(*group, F.col("_m.n").alias("n"), F.col("_m.gain").alias("payout")).join(sizes, [*match, "team"], "left").join(games.select(*match, "duration_s"), list(match)).join(bonus, group, "left")
    rows = rows.withColumn("comeback", F.coalesce("comeback", F.lit(0))).withColumn("minute", rift_minute(F.col("payout") - F.col("comeback")))
    enough = (F.col("n") >= LEAST_SHARING) & (F.col("n") >= F.coalesce("players", F.lit(6)) - 1)
    whole = F.abs(F.col("minute") - F.round("minute")) <= MINUTE_TOLERANCE
    played = F.col("minute").between(RIFT_FIRST_MINUTE - CLOCK_TOLERANCE, F.col("duration_s") / 60.0 + 1)
    return rows.where(enough & whole & played).select(*group, "payout", "comeback", "minute")


def urn_deliveries(gains: DataFrame, rifts: DataFrame, games: DataFrame, match: Sequence[str], at: str, runner: str) -> DataFrame:
    """Snapshots in which a team brought an urn: ``runner``, ``bounty`` and ``minute``.

    The runner has the largest gain (of several, the last by ``runner``); the bounty is that gain less a rift's payout in
    the same snapshot.  It must be one of an urn that can have appeared: not before the first, and not more than two
    minutes after the game's end.
    """
    group = [*match, "team", at]
    top = gains.groupBy(*group).agg(F.max(F.struct("gain", runner)).alias("_top"))
    rows = top.join(rifts.select(*group, "payout"), group, "left").join(games.select(*match, "duration_s"), list(match))
    rows = rows.select(*group, "duration_s", F.col(f"_top.{runner}").alias(runner), (F.col("_top.gain") - F.coalesce("payout", F.lit(0))).alias("bounty")).withColumn("minute", urn_minute(F.col("bounty")))
    first = URN_BASE + URN_PER_MINUTE * (URN_FIRST_MINUTE - CLOCK_TOLERANCE)
    return rows.where((F.col("bounty") >= first) & (F.col("minute") <= F.col("duration_s") / 60.0 + 2)).drop("duration_s")


def income_events(treasure: DataFrame, koth: DataFrame, roster: DataFrame, games: DataFrame, match: Sequence[str], player: str, at: str, total: Column, value: str, runner: str) -> DataFrame:
    """All rift wins and urn deliveries of games under these rules: match, team, ``at``, kind, amount, runner, behind.

    ``treasure``: samples of the income from treasure; ``koth``: samples of the comeback counter; ``roster``: match,
    player, team and ``runner``'s label; ``games``: match, start_time, duration_s.
    """
    ruled = games.where(F.col("start_time") >= F.lit(RULES_FROM).cast("timestamp"))
    gains = increases(treasure.join(ruled.select(*match), list(match), "left_semi"), [*match, player], at, total, "gain").join(roster.select(*match, player, "team", runner), [*match, player])
    sizes = roster.groupBy(*match, "team").agg(F.count(F.lit(1)).alias("players"))
    rifts = rift_wins(gains, ruled, sizes, comebacks(koth, roster, match, player, at, value), match, at)
    urns = urn_deliveries(gains, rifts, ruled, match, at, runner)
    won = rifts.select(*match, "team", at, F.lit("rift").alias("kind"), F.col("payout").alias("amount"), F.lit(None).cast("string").alias(runner), (F.col("comeback") != 0).alias("behind"), "minute")
    brought = urns.select(*match, "team", at, F.lit("urn").alias("kind"), F.col("bounty").alias("amount"), F.col(runner).cast("string").alias(runner), F.lit(False).alias("behind"), "minute")
    return won.unionByName(brought)


def objective_log(objectives: DataFrame, bosses: DataFrame, income: DataFrame, mine: DataFrame, match: str) -> DataFrame:
    """What fell and who gained, from one team's side, in order of time, each as a line of text.

    ``objectives``: match, team (that lost it), at, objective, lane; ``bosses``: match, at, team_killed, team_claimed;
    ``income`` as of ``income_events`` with ``at`` and ``runner``; ``mine``: match, team.
    """
    own = mine.select(match, F.col("team").alias("_mine"))
    side = lambda team: F.when(F.col(team) == F.col("_mine"), "your team").otherwise("enemy team")
    lane = F.when(F.coalesce("lane", F.lit("")) != "", F.concat(F.lit(" ("), "lane", F.lit(")"))).otherwise("")
    lost = F.col("team") == F.col("_mine")
    fell = objectives.where("at IS NOT NULL").join(own, match).select(
        match, "at", F.concat(F.when(lost, "enemy team").otherwise("your team"), F.lit(" destroys "), F.when(lost, "your").otherwise("the enemy"), F.lit(" "), "objective", lane).alias("line")
    )
    claimed = F.when(F.col("team_claimed") == F.col("team_killed"), F.lit(" and claims the Rejuvenator")).otherwise(F.concat(F.lit(", "), side("team_claimed"), F.lit(" steals the Rejuvenator")))
    killed = bosses.join(own, match).select(match, "at", F.concat(side("team_killed"), F.lit(" kills the mid boss"), claimed).alias("line"))
    amount = F.format_number("amount", 0)
    rift = F.concat(side("team"), F.lit(" wins an Unstable Rift"), F.when(F.col("behind"), " while behind").otherwise(""), F.lit(" (+"), amount, F.lit(" souls each)"))
    urn = F.concat(side("team"), F.lit(" delivers the Soul Urn ("), "runner", F.lit(", +"), amount, F.lit(" souls)"))
    gained = income.join(own, match).select(match, "at", F.when(F.col("kind") == "rift", rift).otherwise(urn).alias("line"))
    place = F.row_number().over(Window.partitionBy(match).orderBy("at", "line"))
    return fell.unionByName(killed).unionByName(gained).withColumn("n", place)
