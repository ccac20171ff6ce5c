"""The registered views over the store's fact tables: games, records, snapshots, damage, souls, combat, movement, intervals.

Every builder gives a view over the tables of its context; parameters narrow or shape it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import any_true, badge_index, badge_of, iso_week, month_text, ratio, zero_sum
from tallyforge.functions.labels import SOUL_COMPOSITES, buff_family, buff_level, composite_sources, damage_category, soul_group, soul_source_name, with_stack_labels
from tallyforge.operators import delivery, items, snapshots, source_facts, timeline
from tallyforge.operators.levels import with_rank_label
from tallyforge.plans.metrics import Context, Dimension, Lookup, Measure, MetricView, Series, summarize
from tallyforge.plans.registry import build, view
from tallyforge.schemas import TABLES

GAME = ("match_id", "account_id")
MATCH = Lookup("game", "matches", {"match_id": "match_id"})
PLAYER = Lookup("player", "players", {"match_id": "match_id", "account_id": "account_id"})


def _plain(*names: str) -> dict[str, Dimension]:
    return {n: Dimension(lambda c, n=n: c[n]) for n in names}


def _calendar() -> dict[str, Dimension]:
    return {
        "day": Dimension(lambda c: F.to_date(c["start_time"])),
        "week": Dimension(lambda c: iso_week(F.to_date(c["start_time"]))),
        "month": Dimension(lambda c: month_text(F.to_date(c["start_time"]))),
    }


def _who() -> dict[str, Dimension]:
    return {"match": Dimension(lambda c: c["match_id"]), "account": Dimension(lambda c: c["account_id"]), "hero": Dimension(lambda c: c["hero_id"])}


def _games() -> Measure:
    return Measure(lambda c: F.count_distinct(c["match_id"], c["account_id"]), missing="zero")


def _sums(*names: str) -> dict[str, Measure]:
    return {n: Measure(lambda c, n=n: zero_sum(c[n]), missing="zero") for n in names}


def _accounts(accounts: Sequence[int] | None):
    return None if accounts is None else (lambda c: c["account_id"].isin(*accounts) if accounts else F.lit(False))


def _rate(part: str, whole: str, factor: float = 1.0) -> Measure:
    return Measure(composed=lambda m: ratio(factor * m[part], m[whole]))


@view
def my_games(accounts: Sequence[int] | None = None, match_mode: int | None = None) -> MetricView:
    """One row per player of a match, with the match's mode."""
    mine = _accounts(accounts)

    def keep(c):
        both = [f for f in (mine(c) if mine else None, c["game.match_mode"] == match_mode if match_mode is not None else None) if f is not None]
        return both[0] & both[1] if len(both) == 2 else both[0] if both else F.lit(True)

    scored = lambda c: ~F.coalesce(c["game.not_scored"], F.lit(False))
    return MetricView(
        "my_games",
        "players",
        dimensions=_who() | _calendar() | _plain("won", "assigned_lane") | {"match_mode": Dimension(lambda c: c["game.match_mode"]), "game_mode": Dimension(lambda c: c["game.game_mode"]), "scored": Dimension(scored)},
        measures={
            "games": Measure(lambda c: F.count(F.lit(1)), missing="zero"),
            "scored_games": Measure(lambda c: zero_sum(F.lit(1), scored(c)), missing="zero"),
            "wins": Measure(lambda c: zero_sum(F.lit(1), c["won"] & scored(c)), missing="zero"),
            "losses": Measure(lambda c: zero_sum(F.lit(1), ~c["won"] & scored(c)), missing="zero", higher_is_better=False),
            "win_rate": _rate("wins", "scored_games", 100.0),
            **_sums("kills", "deaths", "assists", "last_hits", "denies", "net_worth"),
            "kda": Measure(composed=lambda m: ratio(m["kills"] + m["assists"], F.greatest(m["deaths"], F.lit(1)))),
            "net_worth_per_game": _rate("net_worth", "games"),
        },
        lookups=(MATCH,),
        filter=keep,
        grain=GAME,
    )


#: Placed players a lobby's rating is taken from, at least.
LEAST_PLACED = 6


def lobby_facts(players: DataFrame) -> DataFrame:
    """Per match: the mean rating that its placed players began with (null where few are placed), and whether anyone left."""
    index = F.when(F.col("player_rank_initial_display_rank") > 0, badge_index(F.col("player_rank_initial_display_rank")))
    return players.groupBy("match_id").agg(F.when(F.count(index) >= LEAST_PLACED, F.avg(index)).alias("placed_subrank"), any_true(F.col("abandon_time_s").isNotNull()).alias("abandoned"))


def lobby_subrank(team0: Column, team1: Column, placed: Column) -> Column:
    """A lobby's rating: the mean of both teams' published ones where both are there, or else that of its placed players."""
    both = F.when((team0 > 0) & (team1 > 0), (badge_index(team0) + badge_index(team1)) / 2)
    return F.coalesce(both, placed)


@view
def record_games(account: int | Sequence[int], hero: int | None = None) -> MetricView:
    """Matches of one or several accounts: wins along the days, change of points, who left, and the lobbies' rating."""
    accounts = [account] if isinstance(account, int) else list(account)

    def source(spark, table) -> DataFrame:
        players = table("players")
        mine = players.where(F.col("account_id").isin(*accounts) & (F.lit(True) if hero is None else F.col("hero_id") == hero))
        lobbies = lobby_facts(players.join(mine.select("match_id").distinct(), "match_id", "left_semi"))
        return mine.join(lobbies, "match_id", "left")

    scored = lambda c: ~F.coalesce(c["game.not_scored"], F.lit(False))
    change = lambda c: F.when(F.coalesce(c["player_rank_initial_calibration_games"], F.lit(0)) == 0, c["player_rank_final_flat_progress"] - c["player_rank_initial_flat_progress"])
    subrank = lambda c: lobby_subrank(c["game.average_badge_team0"], c["game.average_badge_team1"], c["placed_subrank"])
    return MetricView(
        "record_games",
        source,
        dimensions=_calendar() | _plain("account_id", "hero_id", "won", "team", "abandoned") | {"match_mode": Dimension(lambda c: c["game.match_mode"]), "game_mode": Dimension(lambda c: c["game.game_mode"]), "ranked_type": Dimension(lambda c: c["game.ranked_type"]), "scored": Dimension(scored)},
        measures={
            "games": Measure(lambda c: F.count(F.lit(1)), missing="zero"),
            "scored_games": Measure(lambda c: zero_sum(F.lit(1), scored(c)), missing="zero"),
            "wins": Measure(lambda c: zero_sum(F.lit(1), c["won"] & scored(c)), missing="zero"),
            "losses": Measure(lambda c: zero_sum(F.lit(1), ~c["won"] & scored(c)), missing="zero", higher_is_better=False),
            "net": Measure(composed=lambda m: m["wins"] - m["losses"]),
            "cum_net": Measure(composed=lambda m: m["wins"] - m["losses"], cumulative_over=("day", "week", "month")),
            "win_rate": _rate("wins", "scored_games", 100.0),
            "net_points": Measure(lambda c: F.sum(F.when(scored(c), change(c)))),
            "mvps": Measure(lambda c: zero_sum(F.lit(1), (c["mvp_rank"] == 1) & scored(c)), missing="zero"),
            "key_players": Measure(lambda c: zero_sum(F.lit(1), (c["mvp_rank"] >= 2) & scored(c)), missing="zero"),
            "abandons": Measure(lambda c: zero_sum(F.lit(1), c["abandoned"] & scored(c)), missing="zero", higher_is_better=False),
            "subrank_sum": Measure(lambda c: zero_sum(subrank(c)), missing="zero"),
            "rated_games": Measure(lambda c: F.count(subrank(c)), missing="zero"),
            "lobby_subrank": _rate("subrank_sum", "rated_games"),
            "lobby_badge": Measure(composed=lambda m: badge_of(ratio(m["subrank_sum"], m["rated_games"]))),
            "last_rated_at": Measure(lambda c: F.max(F.when(subrank(c).isNotNull(), c["start_time"]))),
        },
        lookups=(MATCH,),
        grain=GAME,
    )


RECORD = ("games", "wins", "losses", "net", "cum_net", "win_rate", "mvps", "key_players", "abandons", "subrank_sum", "rated_games", "lobby_badge", "last_rated_at", "net_points")


def daily_record(context: Context, account: int | Sequence[int], by: str = "day", ranks: DataFrame | None = None, hero: int | None = None, since: str | None = None) -> DataFrame:
    """The scored games' record by day, week or month, with the label of the lobbies' mean rating.

    ``ranks`` gives the names of ranks by era; the label is that of the newest rated game of the bucket.
    """
    made = build("record_games", account=account, hero=hero)
    filters = {"scored": True} | ({} if since is None else {"day": F.col("day") >= F.to_date(F.lit(since))})
    out = summarize(context, made, by, RECORD, filters)
    return out if ranks is None else with_rank_label(out, ranks, "lobby_badge", "last_rated_at", "lobby")


@view
def stat_snapshots() -> MetricView:
    """A player's samples in a match; the last one counts."""
    return MetricView(
        "stat_snapshots",
        "stats",
        dimensions=_who() | _calendar() | {"team": Dimension(lambda c: c["player.team"]), "won": Dimension(lambda c: c["player.won"])},
        measures={
            "games": _games(),
            **_sums("net_worth", "kills", "deaths", "assists", "denies", "player_damage", "boss_damage", "player_healing", "heal_prevented", "damage_mitigated", "shots_hit", "shots_missed", "hero_bullets_hit", "hero_bullets_hit_crit"),
            "accuracy": Measure(composed=lambda m: ratio(100.0 * m["shots_hit"], m["shots_hit"] + m["shots_missed"])),
            "headshot_rate": _rate("hero_bullets_hit_crit", "hero_bullets_hit", 100.0),
        },
        lookups=(PLAYER,),
        series=Series(GAME, "time_stamp_s"),
    )


@view
def hero_damage_games(stat: str | None = None) -> MetricView:
    """Damage of heroes to heroes by target and source."""
    return MetricView(
        "hero_damage_games",
        "damage",
        dimensions=_who() | _calendar() | {"target": Dimension(lambda c: c["target_account_id"]), "source": Dimension(lambda c: c["source_class"]), "category": Dimension(lambda c: damage_category(c["source_class"]))},
        measures={
            "total": Measure(lambda c: zero_sum(c["damage"]), missing="zero"),
            "games": _games(),
            "targets": Measure(lambda c: F.count_distinct(c["match_id"], c["account_id"], c["target_account_id"]), missing="zero"),
            "per_game": _rate("total", "games"),
            "gun": Measure(lambda c: zero_sum(c["damage"], damage_category(c["source_class"]) == "gun"), missing="zero"),
            "gun_headshot": Measure(lambda c: zero_sum(c["damage"], (damage_category(c["source_class"]) == "gun") & c["source_class"].endswith("_crit")), missing="zero"),
            "gun_body": Measure(composed=lambda m: m["gun"] - m["gun_headshot"]),
            "headshot_share": _rate("gun_headshot", "gun", 100.0),
        },
        filter=lambda c: c["target_account_id"].isNotNull() & (c["damage"] != 0) & (F.lit(True) if stat is None else c["stat"] == stat),
    )


def _dimension(spark, table, name: str) -> DataFrame:
    """A dimension table, or an empty one where the context has none of it."""
    try:
        return table(name)
    except KeyError:
        return spark.createDataFrame([], TABLES[name])


def item_facts(spark, table) -> tuple[DataFrame, DataFrame]:
    """Minutes that each item was owned in a game, and the souls put into it, by its class name.

    Prices are those of the match's time, less the components used up.  Items whose class no era knows are left out.
    """
    events, eras, parts = table("item_events"), _dimension(spark, table, "item_history"), _dimension(spark, table, "item_component_history")
    # an item keeps its class; of several the last one counts
    classes = eras.where("class_name IS NOT NULL").groupBy("item_id").agg(F.max_by("class_name", "era_from").alias("source_class"))
    bought = items.priced(events, eras).join(classes, "item_id").join(table("matches").select("match_id", "duration_s"), "match_id", "left")
    windows = items.ownership_windows(bought.withColumn("owned_from", F.col("game_time_s")), "sold_time_s", "duration_s")
    edges = parts.join(classes.select(F.col("source_class").alias("component_class_name"), F.col("item_id").alias("component_id")), "component_class_name").select("item_id", "component_id", "era_from")
    closure = items.component_closure(edges, "item_id", "component_id", by=["era_from"])
    buys = bought.select(*GAME, "game_time_s", F.col("item_id").alias("item"), "source_class", "start_time", "cost")
    used = bought.where("flags = 1 AND sold_time_s > 0").select(*GAME, F.col("sold_time_s").alias("game_time_s"), F.col("item_id").alias("component"), F.col("cost").alias("price"))
    costs = items.effective_cost(buys, used, closure, GAME, "game_time_s", time="start_time")
    return source_facts.owned_minutes(windows, GAME), source_facts.outlay(costs, GAME)


def damage_source_rows(spark, table, stat: str, hero: int | None = None, accounts: Sequence[int] | None = None) -> DataFrame:
    """Final damage of a stat to players, by game and source, with item facts; see ``source_facts.source_rows``."""
    players = table("players").where((F.lit(True) if hero is None else F.col("hero_id") == hero) & (F.lit(True) if accounts is None else F.col("account_id").isin(*accounts)))
    games = players.select(*GAME, F.col("hero_id").alias("hero"), "won").join(table("matches").select("match_id", "start_time", (F.col("duration_s") / 60.0).alias("game_minutes")), "match_id")
    eras = _dimension(spark, table, "item_history").where("class_name IS NOT NULL")
    slots = eras.select(F.col("class_name").alias("source_class"), "era_from", "slot")
    labels = delivery.source_labels(_dimension(spark, table, "ability_history").select(F.col("ability_class").alias("class_name"), "name").distinct(), eras.groupBy("class_name").agg(F.max_by("name", "era_from").alias("name")))

    def named(rows: DataFrame) -> DataFrame:
        of_match = games.select("match_id", "start_time").distinct()
        return delivery.with_source_name(delivery.with_delivery(rows, of_match, slots, "match_id", "source_class", "start_time"), labels, "source_class")

    hits = table("damage").where((F.col("stat") == stat) & F.col("target_account_id").isNotNull() & (damage_category(F.col("source_class")) != "total"))
    per = hits.join(games.select(*GAME), list(GAME), "left_semi").groupBy(*GAME, "source_class").agg(F.sum("damage").alias("amount"), zero_sum(F.col("damage"), F.col("target_account_id") == F.col("account_id")).alias("self_amount"))
    return source_facts.source_rows(named(per).drop("category"), games, *item_facts(spark, table), GAME, named)


@view
def damage_source_games(stat: str = "damage", hero: int | None = None, accounts: Sequence[int] | None = None) -> MetricView:
    """A game's final damage by source, silent items included: what it dealt, how long it was owned and what it cost."""
    dealt = lambda c: c["amount"] != 0
    by = lambda kind: Measure(lambda c: zero_sum(c["amount"], c["delivery"].isin(*kind)), missing="zero")
    return MetricView(
        "damage_source_games",
        lambda spark, table: damage_source_rows(spark, table, stat, hero, accounts),
        dimensions={
            "match": Dimension(lambda c: c["match_id"]), "account": Dimension(lambda c: c["account_id"]), **_plain("hero", "source_name", "delivery", "won"), **_calendar(),
            "source": Dimension(lambda c: c["source_class"], synonyms=("source_class",)), "category": Dimension(lambda c: damage_category(c["source_class"])),
        },
        measures={
            "total": Measure(lambda c: zero_sum(c["amount"]), missing="zero"),
            "games": Measure(lambda c: F.when(dealt(c), 1), once_per=GAME, missing="zero"),
            "minutes": Measure(lambda c: F.when(dealt(c), c["game_minutes"]), once_per=GAME, missing="zero"),
            "per_game": _rate("total", "games"),
            "per_min": _rate("total", "minutes"),
            "owned_minutes": Measure(lambda c: zero_sum(c["owned_minutes"]), missing="zero"),
            "per_min_owned": _rate("total", "owned_minutes"),
            "outlay": Measure(lambda c: zero_sum(c["effective_cost"]), missing="zero"),
            "per_1k": _rate("total", "outlay", 1000.0),
            "gun": by(("gun",)),
            "abilities": by(("ability",)),
            "items": by(("gun_proc", "spirit_proc")),
            "self": Measure(lambda c: zero_sum(c["self_amount"]), missing="zero"),
        },
        grain=(*GAME, "source_class"),
    )


@view
def soul_source_games() -> MetricView:
    """A game's final income by source, with the sources' groups."""

    def source(spark, table) -> DataFrame:
        per = table("soul_sources").groupBy(*GAME, "start_time", "hero_id", "source").agg(F.max("souls").alias("plain"), F.max("souls_orbs").alias("orbs"))
        return per.where("plain + orbs <> 0")

    of = lambda group: Measure(lambda c: zero_sum(c["plain"] + c["orbs"], soul_group(c["source"]) == group), missing="zero")
    return MetricView(
        "soul_source_games",
        source,
        dimensions=_who() | _calendar() | _plain("source") | {"source_name": Dimension(lambda c: soul_source_name(c["source"])), "group": Dimension(lambda c: soul_group(c["source"]))},
        measures={
            "souls": Measure(lambda c: zero_sum(c["plain"] + c["orbs"]), missing="zero"),
            "secured_orbs": Measure(lambda c: zero_sum(c["orbs"]), missing="zero"),
            "games": Measure(lambda c: F.count_distinct(c["match_id"]), missing="zero"),
            "souls_per_game": _rate("souls", "games"),
            "orb_share": _rate("secured_orbs", "souls", 100.0),
            **{g: of(g) for g in ("waves", "roaming", "combat", "objectives")},
        },
        grain=(*GAME, "source"),
    )


#: Groups and names of the counters of a fight, and what they are called here.
COMBAT_COUNTERS = (
    ("Enemy Hero Accuracy", "Shots", "shots"), ("Enemy Hero Accuracy", "Hits", "hits"), ("Enemy Hero Accuracy", "Headshots", "headshots"), (None, "Parry Success", "parries"), (None, "Parry Miss", "missed_parries"),
    ("Enemy Hero Accuracy - Incoming", "Shots", "incoming_shots"), ("Enemy Hero Accuracy - Incoming", "Hits", "incoming_hits"),
)


def combat_game_rows(table, hero: int | None = None, counters: Sequence[tuple] = COMBAT_COUNTERS) -> DataFrame:
    """Every game (of a hero) with its final counters of fights and the gun's damage to players, 0 where there is none."""
    games = table("players").where(F.lit(True) if hero is None else F.col("hero_id") == hero).select(*GAME, "hero_id", "won", "start_time")
    known = table("custom_stats").where(F.col("stat").isin(*{s for _, s, _ in counters}))
    finals = known.groupBy(*GAME, "group", "stat").agg(F.max_by("value", "time_stamp_s").alias("value"))
    is_it = lambda group, stat: (F.col("stat") == stat) & (F.col("group").isNull() if group is None else F.col("group") == group)
    wide = finals.groupBy(*GAME).agg(*(zero_sum(F.col("value"), is_it(g, s)).alias(n) for g, s, n in counters))
    gun = table("damage").where((F.col("stat") == "damage") & F.col("target_account_id").isNotNull() & (damage_category(F.col("source_class")) == "gun")).groupBy(*GAME).agg(F.sum("damage").alias("gun_damage"))
    rows = games.join(wide, list(GAME), "left").join(gun, list(GAME), "left")
    return rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in (*(n for _, _, n in counters), "gun_damage")})


@view
def combat_games(hero: int | None = None) -> MetricView:
    """Every game with its final counters of shooting, of being shot at and of parries."""
    names = [n for _, _, n in COMBAT_COUNTERS]
    return MetricView(
        "combat_games",
        lambda spark, table: combat_game_rows(table, hero),
        dimensions=_who() | _calendar() | _plain("won"),
        measures={
            "games": Measure(lambda c: F.count(F.lit(1)), missing="zero"), **_sums(*names, "gun_damage"),
            "hit_rate": _rate("hits", "shots", 100.0), "headshot_rate": _rate("headshots", "hits", 100.0),
            "incoming_hit_rate": Measure(composed=lambda m: ratio(100.0 * m["incoming_hits"], m["incoming_shots"]), higher_is_better=False),
            "shots_per_game": _rate("shots", "games"), "gun_damage_per_game": _rate("gun_damage", "games"), "gun_damage_per_hit": _rate("gun_damage", "hits"),
            "parries_per_game": _rate("parries", "games"), "missed_parries_per_game": Measure(composed=lambda m: ratio(m["missed_parries"], m["games"]), higher_is_better=False),
        },
        grain=GAME,
    )


STATES = ("stationary_s", "slide_s", "in_air_s", "zipline_s", "combat_s")


@view
def movement_games() -> MetricView:
    """A game's movement: means of the games' own percents and paces."""

    def source(spark, table) -> DataFrame:
        return timeline.movement_totals(table("movement_intervals"), [*GAME, "start_time", "hero_id"], STATES, ["dashes"])

    shares = [f"{s.removesuffix('_s')}_percent" for s in STATES]
    return MetricView(
        "movement_games",
        source,
        dimensions=_who() | _calendar() | {"won": Dimension(lambda c: c["player.won"])},
        measures={"games": _games(), **{f"mean_{n}": Measure(lambda c, n=n: F.avg(c[n])) for n in (*shares, "pace", "dashes_per_min", "distance")}},
        lookups=(PLAYER,),
        grain=GAME,
    )


@view
def buff_games() -> MetricView:
    return MetricView(
        "buff_games",
        "buffs",
        dimensions=_who() | _plain("type") | {"buff": Dimension(lambda c: buff_family(c["type"])), "level": Dimension(lambda c: buff_level(c["type"])), "team": Dimension(lambda c: c["player.team"]), "won": Dimension(lambda c: c["player.won"])},
        measures={"held": Measure(lambda c: zero_sum(c["count"]), missing="zero"), "permanent": Measure(lambda c: zero_sum(c["count"], c["permanent"]), missing="zero"), "games": _games()},
        lookups=(PLAYER,),
        grain=(*GAME, "type"),
    )


@view
def stack_games() -> MetricView:
    def source(spark, table) -> DataFrame:
        abilities = _dimension(spark, table, "ability_history").groupBy("id").agg(F.max_by(F.struct(F.col("ability_class").alias("class_name"), "name"), "era_from").alias("_a")).select("id", "_a.*")
        known = _dimension(spark, table, "item_history").groupBy(F.col("item_id").alias("id")).agg(F.max_by(F.struct("class_name", "name"), "era_from").alias("_i")).select("id", "_i.*")
        return with_stack_labels(table("stacks"), abilities, known)

    return MetricView(
        "stack_games",
        source,
        dimensions=_who() | _plain("ability_id", "class_name", "name") | {"team": Dimension(lambda c: c["player.team"])},
        measures={"total": Measure(lambda c: zero_sum(c["value"]), missing="zero"), "games": _games(), "mean": _rate("total", "games"), "most": Measure(lambda c: F.max(c["value"]))},
        lookups=(PLAYER,),
        grain=(*GAME, "ability_id"),
    )


#: Figures that are columns of samples, and those where less is better.
SAMPLED = {
    "souls": "net_worth", "assists": "assists", "damage": "player_damage", "damage_taken": "player_damage_taken", "obj_damage": "boss_damage", "healing": "player_healing",
    "heal_prevented": "heal_prevented", "creeps": "creep_kills", "neutrals": "neutral_kills", "denies": "denies",
}
LESS_IS_BETTER = ("deaths", "damage_taken")


def known_stats() -> list[str]:
    return sorted({*SAMPLED, *SOUL_COMPOSITES, "kills", "deaths"})


def _death_events(table, kills: bool) -> DataFrame:
    """Deaths by the one who died, or by the one who killed."""
    rows = table("deaths")
    if kills:
        rows = rows.where("killer_account_id IS NOT NULL").withColumn("account_id", F.col("killer_account_id"))
    return rows.select(*GAME, "game_time_s")


def _running(table, stat: str) -> DataFrame:
    """Samples of a figure as a running total: ``time_stamp_s`` and ``value``; income is the sum of its sources so far.

    Every source keeps its last sample until its next one, so a composite changes with each of its sources.
    """
    if stat in ("kills", "deaths"):
        so_far = Window.partitionBy(*GAME).orderBy("game_time_s").rowsBetween(Window.unboundedPreceding, 0)
        return _death_events(table, stat == "kills").select(*GAME, F.col("game_time_s").alias("time_stamp_s"), F.count(F.lit(1)).over(so_far).alias("value"))
    if stat in SOUL_COMPOSITES:
        rows = table("soul_sources").where(F.col("source").isin(*composite_sources(stat))).withColumn("_v", F.col("souls") + F.col("souls_orbs"))
        step = F.col("_v") - F.coalesce(F.lag("_v").over(Window.partitionBy(*GAME, "source").orderBy("time_stamp_s")), F.lit(0))
        steps = rows.withColumn("_step", step).groupBy(*GAME, "time_stamp_s").agg(F.sum("_step").alias("_step"))
        so_far = Window.partitionBy(*GAME).orderBy("time_stamp_s").rowsBetween(Window.unboundedPreceding, 0)
        return steps.select(*GAME, "time_stamp_s", F.sum("_step").over(so_far).alias("value"))
    return table("stats").select(*GAME, "time_stamp_s", F.col(SAMPLED.get(stat, stat)).alias("value"))


def _lengths(table) -> DataFrame:
    return table("players").select(*GAME).join(table("matches").select("match_id", "duration_s"), "match_id")


@view
def compare_intervals(stat: str = "net_worth", width: int = 300) -> MetricView:
    """What each interval adds to a figure: a sampled total, a sum of income sources, or kills or deaths."""
    better = stat not in LESS_IS_BETTER

    def source(spark, table) -> DataFrame:
        games = _lengths(table)
        if stat in ("kills", "deaths"):
            return snapshots.event_gains(_death_events(table, stat == "kills"), games, list(GAME), "game_time_s", width, "gain")
        if stat in SOUL_COMPOSITES:
            rows = table("soul_sources").where(F.col("source").isin(*composite_sources(stat))).withColumn("gain", F.col("souls") + F.col("souls_orbs"))
            return snapshots.source_gains(rows, games, list(GAME), "source", "time_stamp_s", ["time_stamp_s"], "gain", width)
        column = SAMPLED.get(stat, stat)
        return snapshots.column_gains(table("stats"), games, list(GAME), "time_stamp_s", ["time_stamp_s"], [column], width).withColumnRenamed(column, "gain")

    return MetricView(
        "compare_intervals",
        source,
        dimensions={"match": Dimension(lambda c: c["match_id"]), "account": Dimension(lambda c: c["account_id"]), **_plain("interval")},
        measures={"games": _games(), "total_gain": Measure(lambda c: zero_sum(c["gain"]), missing="zero"), "mean_gain": Measure(lambda c: F.avg(c["gain"]), higher_is_better=better), "median_gain": Measure(lambda c: F.median(c["gain"]), higher_is_better=better)},
        grain=(*GAME, "interval"),
    )


@view
def cumulative_marks(stat: str = "net_worth", marks: Sequence[int] = (360, 600, 900, 1200, 1500)) -> MetricView:
    """A running total at fixed times, for the games that last so long."""

    def source(spark, table) -> DataFrame:
        return snapshots.at_marks(_running(table, stat), _lengths(table), list(GAME), "time_stamp_s", ["time_stamp_s", "value"], "value", list(marks))

    return MetricView(
        "cumulative_marks",
        source,
        dimensions={"match": Dimension(lambda c: c["match_id"]), "account": Dimension(lambda c: c["account_id"]), **_plain("mark_s")},
        measures={"games": _games(), "mean": Measure(lambda c: F.avg(c["value"])), "median": Measure(lambda c: F.median(c["value"]))},
        grain=(*GAME, "mark_s"),
    )


@view
def milestone_games(stat: str = "net_worth", targets: Sequence[float] = tuple(range(5000, 80001, 5000))) -> MetricView:
    """When a running total passes each target."""

    def source(spark, table) -> DataFrame:
        out = snapshots.target_times(_running(table, stat), list(GAME), "time_stamp_s", ["time_stamp_s", "value"], "value", list(targets))
        return out.withColumn("minutes", F.col("reached_s") / 60.0)

    return MetricView(
        "milestone_games",
        source,
        dimensions={"match": Dimension(lambda c: c["match_id"]), "account": Dimension(lambda c: c["account_id"]), **_plain("target")},
        measures={"games": _games(), "minutes": Measure(lambda c: F.median(c["minutes"]), higher_is_better=False)},
        grain=(*GAME, "target"),
    )
