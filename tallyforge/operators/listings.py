"""Lists and tables of games: histories, ranked games, scoreboards, deaths, aim, rates by bucket, two pools side by side.

A game is a match and an account (``keys``); ``games`` has one row per game with its length ``duration_s``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import ratio, share_of, zero_sum
from tallyforge.functions.labels import with_hero_name, with_lane_name, with_objective_labels
from tallyforge.operators.items import buy_order
from tallyforge.operators.levels import with_rank_label

# Players and games


def player_rows(players: DataFrame, heroes: DataFrame, ranks: DataFrame | None = None, badge: str = "badge", at: str = "start_time") -> DataFrame:
    """Players with the names of hero and lane and, where the history of ranks is given, the rank of their time."""
    out = with_lane_name(with_hero_name(players, heroes))
    return out if ranks is None else with_rank_label(out, ranks, badge, at)


def with_side(rows: DataFrame, mine: DataFrame, match: str, team: str = "team") -> DataFrame:
    """Adds ``side``: ``ally`` or ``enemy`` of the team that ``mine``, one row per match, names."""
    own = mine.select(match, F.col(team).alias("_mine"))
    return rows.join(own, match).withColumn("side", F.when(F.col(team) == F.col("_mine"), "ally").otherwise("enemy")).drop("_mine")


def match_players(players: DataFrame, matches: DataFrame, match: str, ids: Sequence[int] | None = None, hero: int | None = None, accounts: Sequence[int] = ()) -> DataFrame:
    """The players meant in matches: those on a hero, or else those of one's own accounts, with their match's columns."""
    meant = F.col("hero_id") == hero if hero is not None else F.col("account_id").isin(*accounts) if accounts else F.lit(False)
    rows = players.where(meant) if ids is None else players.where(meant & F.col(match).isin(*ids))
    return rows.join(matches.select(match, *(c for c in matches.columns if c not in players.columns)), match)


def newest(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows, the feature of a listing; Spark keeps ``n`` rows of each task and merges those."""
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def match_history(games: DataFrame, finals: DataFrame, keys: Sequence[str], damage: str, order: Sequence[str], n: int | None = None) -> DataFrame:
    """Games with their final damage, 0 where none was sampled; the last ``n`` only, if given."""
    last = games if n is None else newest(games, order, n)
    return last.join(finals.select(*keys, damage), list(keys), "left").withColumn(damage, F.coalesce(damage, F.lit(0)))


def ranked_games(games: DataFrame, badge: str, label: str, start: str, end: str) -> DataFrame:
    """Adds ``rating``, the rank's label or "Placing" at badge 0, and ``applied``, how far the points moved."""
    rating = F.when(F.col(badge) == 0, "Placing").otherwise(F.col(label))
    return games.withColumns({"rating": rating, "applied": F.col(end) - F.col(start)})


def unscored(games: DataFrame, flag: str = "not_scored") -> DataFrame:
    return games.where(F.coalesce(F.col(flag), F.lit(False)))


def rate_tables(games: DataFrame, buckets: Mapping[str, Column], won: Column) -> DataFrame:
    """Won and lost games by each way of bucketing, in one pass; a game of unknown result counts as a game alone."""
    each = F.array(*(F.struct(F.lit(name).alias("split"), bucket.cast("string").alias("bucket")) for name, bucket in buckets.items()))
    rows = games.select(won.cast("long").alias("_won"), F.explode(each).alias("_b"))
    out = rows.groupBy("_b.split", "_b.bucket").agg(F.count(F.lit(1)).alias("games"), zero_sum(F.col("_won")).alias("wins"))
    return out.withColumns({"losses": F.col("games") - F.col("wins"), "win_percent": ratio(100.0 * F.col("wins"), F.col("games"))})


# Deaths and objectives


def game_deaths(deaths: DataFrame, games: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deaths of the given games with the games' columns."""
    return deaths.join(games, list(keys))


def top_killers(deaths: DataFrame, by: Sequence[str], killer: str, top: int = 5) -> DataFrame:
    """The ``top`` killers of each group by deaths, ties to the smaller killer; counted before they are ranked."""
    per = deaths.groupBy(*by, killer).agg(F.count(F.lit(1)).alias("deaths"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("deaths").desc(), killer))
    return per.withColumn("place", place).where(F.col("place") <= top)


def objective_falls(objectives: DataFrame, mine: DataFrame, match: str, at: str, mark: int, objective: str = "Guardian", team: str = "team") -> DataFrame:
    """Falls of one kind of objective up to ``mark``, with lane and side; ``objective_id`` and the losing team are given."""
    fallen = with_objective_labels(objectives).where((F.col("objective") == objective) & (F.col(at) <= mark))
    return with_side(fallen, mine, match, team)


# Aim


def lobby_aim(counters: DataFrame, players: DataFrame, gun: DataFrame, keys: Sequence[str], name: str, value: str, shots: str, hits: str, headshots: str) -> DataFrame:
    """Each player's shots, hits and headshots on heroes, their rates and the gun's damage (null where it has none)."""
    wanted = {"shots": shots, "hits": hits, "headshots": headshots}
    wide = counters.where(F.col(name).isin(list(wanted.values()))).groupBy(*keys).agg(*(zero_sum(F.col(value), F.col(name) == w).alias(c) for c, w in wanted.items()))
    out = wide.join(players, list(keys)).join(gun, list(keys), "left")
    one = F.lit(1)
    return out.withColumns({"hit_rate": 100.0 * F.col("hits") / F.greatest("shots", one), "headshot_rate": 100.0 * F.col("headshots") / F.greatest("hits", one)})


def accuracy(finals: DataFrame, by: Sequence[str], hit: str, missed: str) -> DataFrame:
    """Whole percent of shots that hit any target over a group's games, null where nothing was fired."""
    sums = finals.groupBy(*by).agg(zero_sum(F.col(hit)).alias(hit), zero_sum(F.col(missed)).alias(missed))
    return sums.withColumn("accuracy", F.bround(ratio(100.0 * F.col(hit), F.col(hit) + F.col(missed))).cast("long"))


def aim_totals(counters: DataFrame, by: Sequence[str], game: Sequence[str], name: str, value: str, shots: str, hits: str, headshots: str) -> DataFrame:
    """A group's counters over its games, per game, and the shares of hits and headshots."""
    each = counters.groupBy(*by, *(k for k in game if k not in by)).agg(*(zero_sum(F.col(value), F.col(name) == w).alias(c) for c, w in (("shots", shots), ("hits", hits), ("headshots", headshots))))
    out = each.groupBy(*by).agg(F.count(F.lit(1)).alias("games"), *(F.sum(c).alias(c) for c in ("shots", "hits", "headshots")))
    per = {f"{c}_per_game": F.col(c) / F.col("games") for c in ("shots", "hits", "headshots")}
    return out.withColumns(per | {"hit_percent": ratio(100.0 * F.col("hits"), F.col("shots")), "headshot_percent": ratio(100.0 * F.col("headshots"), F.col("hits"))})


def combat_totals(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counters of both sides over a group's games: sums, per game, shares of hits and headshots, and parries.

    ``rows``: by and, one row per game, shots, hits, headshots, incoming_shots, incoming_hits, parries, missed_parries.
    """
    names = ("shots", "hits", "headshots", "incoming_shots", "incoming_hits", "parries", "missed_parries")
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("games"), *(zero_sum(F.col(n)).alias(n) for n in names))
    share = lambda part, whole: ratio(100.0 * F.col(part), F.col(whole))
    return out.withColumns({
        **{f"{n}_per_game": F.col(n) / F.col("games") for n in names},
        "hit_percent": share("hits", "shots"), "headshot_percent": share("headshots", "hits"), "incoming_hit_percent": share("incoming_hits", "incoming_shots"),
        "parry_percent": ratio(100.0 * F.col("parries"), F.col("parries") + F.col("missed_parries")),
    })


# Sources


def game_sources(finals: DataFrame, keys: Sequence[str], source: str, value: str) -> DataFrame:
    """All sources of each game with their percent of it."""
    return finals.select(*keys, source, value).withColumn("percent", share_of(F.col(value), *keys))


def one_source(finals: DataFrame, games: DataFrame, keys: Sequence[str], source: str, wanted: str, value: str) -> DataFrame:
    """What one source made in each game, 0 where it made nothing."""
    part = finals.where(F.col(source) == wanted).groupBy(*keys).agg(F.sum(value).alias(value))
    return games.select(*keys).join(part, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def group_block(finals: DataFrame, games: DataFrame, keys: Sequence[str], group: Column, value: str) -> DataFrame:
    """Sources rolled up to groups: total, per game and per minute of all games, percent of all."""
    window = games.agg(F.count(F.lit(1)).alias("_games"), (F.sum("duration_s") / 60.0).alias("_minutes"))
    per = finals.join(games.select(*keys), list(keys)).groupBy(group.alias("block")).agg(F.sum(value).alias("total"))
    whole = per.agg(F.sum("total").alias("_all"))
    out = per.crossJoin(F.broadcast(window)).crossJoin(F.broadcast(whole))  # one row each
    total = F.col("total")
    return out.select("block", "total", ratio(total, F.col("_games")).alias("per_game"), ratio(total, F.col("_minutes")).alias("per_min"), ratio(100.0 * total, F.col("_all")).alias("percent"))


def pool_gap(finals: DataFrame, games: DataFrame, mine: Column, by: Sequence[str], value: str) -> DataFrame:
    """A value per game of two pools, and their gap; ``mine`` tells the pools apart on both tables."""
    sides = games.agg(zero_sum(F.lit(1), mine).alias("_m"), zero_sum(F.lit(1), ~mine).alias("_t"))
    per = finals.groupBy(*by).agg(zero_sum(F.col(value), mine).alias("mine"), zero_sum(F.col(value), ~mine).alias("theirs"))
    out = per.crossJoin(F.broadcast(sides))  # one row
    both = out.select(*by, ratio(F.col("mine"), F.col("_m")).alias("mine"), ratio(F.col("theirs"), F.col("_t")).alias("theirs"))
    return both.withColumn("gap", F.col("mine") - F.col("theirs"))


def mark_medians(values: DataFrame, mine: Column, by: Sequence[str], value: str) -> DataFrame:
    """Medians of two pools by source and mark, and their gap, null where a pool has no game there."""
    out = values.groupBy(*by).agg(F.median(F.when(mine, F.col(value))).alias("mine"), F.median(F.when(~mine, F.col(value))).alias("theirs"))
    return out.withColumn("gap", F.col("mine") - F.col("theirs"))


def interval_table(intervals: DataFrame, keys: Sequence[str], source: str, group: Column, value: str, n: int) -> DataFrame:
    """Sources and, as rows of their own, their groups, with a column ``i<k>`` for each of ``n`` intervals and ``total``."""
    labels = F.array(F.struct(F.lit("source").alias("kind"), F.col(source).alias("label")), F.struct(F.lit("group").alias("kind"), group.alias("label")))
    rows = intervals.select(*keys, "interval", F.col(value).alias("_v"), F.explode(labels).alias("_l"))
    cells = (zero_sum(F.col("_v"), F.col("interval") == i).alias(f"i{i}") for i in range(n))
    return rows.groupBy(*keys, F.col("_l.kind").alias("kind"), F.col("_l.label").alias("label")).agg(zero_sum(F.col("_v")).alias("total"), *cells)


# Scoreboards, awards, items


def scoreboard(players: DataFrame, finals: DataFrame, buffs: DataFrame, keys: Sequence[str], team: Sequence[str], worth: str, count: str = "count") -> DataFrame:
    """Players with their last sample and the buffs they hold (``count`` of each row), placed in their team by worth; missing figures are 0."""
    held = buffs.groupBy(*keys).agg(F.sum(count).alias("buffs"))
    out = players.join(finals, list(keys), "left").join(held, list(keys), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("buffs", *(c for c in finals.columns if c not in keys))})
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*team).orderBy(F.col(worth).desc(), *keys)))


def awards(accolades: DataFrame, names: DataFrame, key: str, name: str, threshold: str) -> DataFrame:
    """Accolades with their label, ``id<n>`` where it is unknown, and stars, one more than the threshold's number."""
    label = F.regexp_replace(F.coalesce(name, F.concat(F.lit("id"), F.col(key).cast("string"))), "_", " ")
    return accolades.join(names.select(key, name), key, "left").withColumns({"label": label, "stars": F.col(threshold) + 1}).drop(name)


def item_buys(buys: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Column) -> DataFrame:
    """Purchases that ``wanted`` picks, by item, tier or a fixed set, numbered among all purchases of their game."""
    return buy_order(buys, keys, order).where(wanted)


def cost_efficiency(rows: DataFrame, item: str, cost: str, at: str, owned: str, damage: str) -> DataFrame:
    """Per item over the games that owned it: mean minutes of purchase and ownership, damage a minute, and that per 1000 of its highest cost."""
    per = rows.where(F.col(owned) > 0).groupBy(item).agg(
        F.count(F.lit(1)).alias("games"), F.sum(damage).alias("total"), F.max(cost).alias("cost"), (F.avg(at) / 60).alias("buy_min"), (F.avg(owned) / 60).alias("owned_min"), ratio(60.0 * F.sum(damage), F.sum(owned)).alias("per_min_owned")
    )
    return per.where("cost <> 0").withColumn("per_1k", 1000.0 * F.col("per_min_owned") / F.col("cost"))


# Movement


def movement_games(games: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every game with its movement figures, null where none was tracked."""
    return games.join(metrics, list(keys), "left")


def mean_metrics(rows: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Means in which each game weighs the same, by group and, with a null group and ``everything``, over all; untracked games stay out of them."""
    out = rows.where(F.col(by).isNotNull()).rollup(by).agg(F.grouping(by).alias("_g"), F.count(F.lit(1)).alias("games"), *(F.avg(m).alias(m) for m in metrics))
    return out.select(by, (F.col("_g") == 1).alias("everything"), "games", *metrics)
