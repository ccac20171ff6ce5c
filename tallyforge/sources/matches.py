"""Nested match documents to fact tables: one narrow select and explode per table.

``MATCH`` is the declared shape of a document; unset fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.labels import COMBAT_NAMES, MOVE_NAMES, STAT_NAMES
from tallyforge.schemas import TABLES

_SNAPSHOT = [c for c in TABLES["stats"].names if c not in ("match_id", "start_time", "account_id", "hero_id")]
#: Snapshot fields of the document are named gold where the tables say souls.
_GOLD = {c: c.replace("souls", "gold", 1) if c.startswith("souls") else c for c in _SNAPSHOT}
_POINT = "struct<x: double, y: double, z: double>"
_RANK = "initial_display_rank initial_flat_progress final_flat_progress desired_progress_change initial_calibration_games initial_demotion_protection_games consumed_demotion_protection initial_win_streak".split()
_PLAYER = "account_id player_slot team hero_id assigned_lane kills deaths assists net_worth last_hits denies mvp_rank party abandon_match_time_s player_match_outcome".split()


def _struct(names: list[str], kind: str = "bigint", **other: str) -> str:
    return "struct<" + ", ".join(f"{n}: {other.get(n, kind)}" for n in [*names, *(k for k in other if k not in names)]) + ">"


MATCH = ", ".join(
    [
        *(f"{n} bigint" for n in "match_id start_time duration_s winning_team match_mode game_mode ranked_type rank_interval average_badge_team0 average_badge_team1".split()),
        "not_scored boolean",
        "players array<"
        + _struct(
            _PLAYER,
            player_rank_data=_struct(_RANK, consumed_demotion_protection="boolean"),
            items=f"array<{_struct(['game_time_s', 'item_id', 'sold_time_s', 'flags', 'imbued_ability_id'])}>",
            death_details=f"array<{_struct(['game_time_s', 'killer_player_slot', 'death_duration_s'], time_to_kill_s='double', death_pos=_POINT, killer_pos=_POINT)}>",
            stats=f"array<{_struct(list(_GOLD.values()), gold_sources=f'array<{_struct(["source", "gold", "gold_orbs"])}>', custom_user_stats=f'array<{_struct(["id", "value"])}>')}>",
            ability_stats=f"array<{_struct(['ability_id', 'ability_value'])}>",
            accolades=f"array<{_struct(['accolade_id', 'accolade_stat_value', 'accolade_threshold_achieved'])}>",
            power_up_buffs=f"array<{_struct(['value'], type='string', is_permanent='boolean')}>",
            hero_xp_rewards=f"array<struct<xp_grant: {_struct(['hero_id', 'xp_grant', 'reason'])}>>",
        )
        + ">",
        f"objectives array<{_struct('team team_objective_id destroyed_time_s first_damage_time_s player_damage player_spirit_damage creep_damage'.split())}>",
        f"mid_boss array<{_struct(['team_killed', 'team_claimed', 'destroyed_time_s'])}>",
        "match_paths "
        + _struct(
            ["x_resolution", "y_resolution"],
            interval_s="double",
            paths="array<" + _struct(["player_slot"], **dict.fromkeys(["x_min", "x_max", "y_min", "y_max"], "double"), **dict.fromkeys(["x_pos", "y_pos", "health", "combat_type", "move_type"], "array<bigint>")) + ">",
        ),
        "damage_matrix "
        + _struct(
            [],
            sample_time_s="array<bigint>",
            source_details="struct<source_name: array<string>, stat_type: array<bigint>>",
            damage_dealers="array<struct<dealer_player_slot: bigint, damage_sources: array<struct<source_details_index: bigint, damage_to_players: array<struct<target_player_slot: bigint, damage: array<bigint>>>>>>>",
        ),
        "custom_user_stats array<struct<id: bigint, name: string>>",
    ]
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCH).json(path)


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with their start as a timestamp and lookups by player slot."""
    by_slot = lambda field: F.map_from_entries(F.transform("players", lambda p: F.struct(p["player_slot"], p[field])))
    return docs.withColumns({"start_time": F.timestamp_seconds("start_time"), "slot_account": by_slot("account_id"), "slot_hero": by_slot("hero_id")})


def _named(value: Column, names: dict[int, str]) -> Column:
    if not names:
        return value.cast("string")
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[value.cast("int")], value.cast("string"))


def normalize(docs: DataFrame, items: DataFrame | None = None, stat_names: dict[int, str] | None = None, combat_names: dict[int, str] | None = None, move_names: dict[int, str] | None = None) -> dict[str, DataFrame]:
    """The fact tables of ``docs``.

    ``items`` (``item_id``, ``name``, ``cost``, ``slot``, ``tier``, ``era_from``) prices item events as of the match's
    start; without it these columns are null.  Enum values without a name are given as their number.
    """
    docs = _numbered(docs)
    head = [F.col("match_id"), F.col("start_time")]
    per = docs.select(*head, "duration_s", "winning_team", "slot_account", "custom_user_stats", F.explode("players").alias("p"))
    who = [*head, F.col("p.account_id").alias("account_id"), F.col("p.hero_id").alias("hero_id")]
    none_if_zero = lambda c: F.nullif(c, F.lit(0))
    out: dict[str, DataFrame] = {"matches": docs.select(*TABLES["matches"].names)}
    outcome = F.col("p.player_match_outcome")
    plain = [c for c in _PLAYER if c not in ("account_id", "hero_id", "abandon_match_time_s")]
    out["players"] = per.select(
        *who,
        *(F.col(f"p.{c}").alias(c) for c in plain),
        F.when(outcome.isNotNull() & (outcome != 0), outcome == 1).otherwise(F.col("p.team") == F.col("winning_team")).alias("won"),
        *(F.col(f"p.player_rank_data.{c}").alias(f"player_rank_{c}") for c in _RANK),
        none_if_zero(F.col("p.abandon_match_time_s")).alias("abandon_time_s"),
    ).select(*TABLES["players"].names)
    each = lambda column, alias: per.select(*who, "custom_user_stats", "slot_account", F.explode(f"p.{column}").alias(alias))
    reward = each("hero_xp_rewards", "x").where("x.xp_grant is not null")
    out["hero_xp_rewards"] = reward.select(*head, "account_id", F.col("x.xp_grant.hero_id").alias("hero_id"), F.col("x.xp_grant.xp_grant").alias("xp_grant"), F.col("x.xp_grant.reason").alias("reason"))
    snapshots = each("stats", "s")
    out["stats"] = snapshots.select(*head, "account_id", "hero_id", *(F.col(f"s.{g}").alias(c) for c, g in _GOLD.items()))
    at = F.col("s.time_stamp_s").alias("time_stamp_s")
    out["soul_sources"] = snapshots.select(*head, "account_id", "hero_id", at, F.explode("s.gold_sources").alias("g")).select("*", F.col("g.source"), F.col("g.gold").alias("souls"), F.col("g.gold_orbs").alias("souls_orbs")).drop("g")
    events = each("items", "i").select(*head, "account_id", "hero_id", *(F.col(f"i.{c}") for c in ("game_time_s", "item_id", "sold_time_s", "flags")), none_if_zero(F.col("i.imbued_ability_id")).alias("imbued_ability_id"))
    if items is None:
        events = events.withColumns({"item": F.lit(None).cast("string"), "cost": F.lit(None).cast("long"), "slot": F.lit(None).cast("string"), "tier": F.lit(None).cast("long")})
    else:
        from tallyforge.operators.eras import asof_join

        events = asof_join(events, items.withColumnRenamed("name", "item"), ["item_id"], "start_time", ["item", "cost", "slot", "tier"]).drop("era_from")
    out["item_events"] = events.select(*TABLES["item_events"].names)
    out["accolades"] = each("accolades", "a").select(*head, "account_id", "hero_id", F.col("a.accolade_id"), F.col("a.accolade_stat_value").alias("value"), F.col("a.accolade_threshold_achieved").alias("threshold"))
    out["buffs"] = each("power_up_buffs", "b").select(*head, "account_id", "hero_id", F.col("b.type"), F.col("b.value").alias("count"), F.col("b.is_permanent").alias("permanent"))
    out["stacks"] = each("ability_stats", "a").select(*head, "account_id", "hero_id", F.col("a.ability_id"), F.col("a.ability_value").alias("value"))
    registry = F.map_from_entries(F.transform("custom_user_stats", lambda c: F.struct(c["id"], c["name"])))
    custom = snapshots.select(*head, "account_id", "hero_id", at, registry.alias("names"), F.explode("s.custom_user_stats").alias("c")).withColumn("name", F.col("names")[F.col("c.id")]).where("name is not null")
    parts = F.split("name", "##", 2)
    out["custom_stats"] = custom.select(*head, "account_id", "hero_id", "time_stamp_s", F.when(F.size(parts) > 1, parts[0]).alias("group"), F.element_at(parts, -1).alias("stat"), F.col("c.value").alias("value"))
    out["deaths"] = each("death_details", "d").select(
        *head, "account_id", "hero_id", F.col("d.game_time_s"), F.col("d.time_to_kill_s"), F.col("d.death_duration_s"), F.col("slot_account")[F.col("d.killer_player_slot")].alias("killer_account_id"),
        *(F.col(f"d.death_pos.{c}").alias(c) for c in "xyz"), *(F.col(f"d.killer_pos.{c}").alias(f"killer_{c}") for c in "xyz"),
    )
    out["mid_boss"] = docs.select(*head, F.explode("mid_boss").alias("b")).select(*head, "b.destroyed_time_s", "b.team_killed", "b.team_claimed")
    out["objectives"] = docs.select(*head, F.explode("objectives").alias("o")).select(
        *head, "o.team", F.col("o.team_objective_id").alias("objective_id"), none_if_zero(F.col("o.destroyed_time_s")).alias("destroyed_time_s"), none_if_zero(F.col("o.first_damage_time_s")).alias("first_damage_time_s"), "o.player_damage", "o.player_spirit_damage", "o.creep_damage"
    )
    out |= _damage(docs, head, STAT_NAMES if stat_names is None else stat_names)
    out |= _movement(docs, head, COMBAT_NAMES if combat_names is None else combat_names, MOVE_NAMES if move_names is None else move_names)
    return out


def _damage(docs: DataFrame, head: list[Column], stat_names: dict[int, str]) -> dict[str, DataFrame]:
    rows = docs.select(*head, "slot_account", "slot_hero", F.col("damage_matrix.sample_time_s").alias("times"), F.col("damage_matrix.source_details").alias("details"), F.explode("damage_matrix.damage_dealers").alias("d"))
    rows = rows.select("*", F.explode("d.damage_sources").alias("s")).select("*", F.explode("s.damage_to_players").alias("t")).where(F.size("t.damage") > 0)
    index = (F.col("s.source_details_index") + 1).cast("int")
    rows = rows.select(
        *head, F.col("slot_account")[F.col("d.dealer_player_slot")].alias("account_id"), F.col("slot_hero")[F.col("d.dealer_player_slot")].alias("hero_id"),
        F.col("slot_account")[F.col("t.target_player_slot")].alias("target_account_id"), F.col("t.target_player_slot").alias("target_player_slot"),
        F.try_element_at("details.source_name", index).alias("source_class"), _named(F.try_element_at("details.stat_type", index), stat_names).alias("stat"), "times", F.col("t.damage").alias("values"),
    )
    final = rows.select("*", F.element_at("values", -1).alias("damage")).select(*TABLES["damage"].names)
    # samples and times are aligned at their ends
    n = F.least(F.size("times"), F.size("values"))
    tail = lambda c: F.slice(c, F.size(c) - n + 1, n)
    series = rows.where(n > 0).select("*", F.explode(F.arrays_zip(tail(F.col("times")).alias("time_stamp_s"), tail(F.col("values")).alias("damage"))).alias("z"))
    series = series.select(*head, "account_id", "hero_id", "target_account_id", "source_class", "stat", F.col("target_account_id").isNotNull().alias("vs_heroes"), F.col("z.time_stamp_s").alias("time_stamp_s"), F.col("z.damage").alias("damage"))
    total = lambda name, df: df.groupBy(*[c for c in TABLES[name].names if c != "damage"]).agg(F.sum("damage").alias("damage"))
    return {"damage": final, "damage_sources": total("damage_sources", series), "damage_targets": total("damage_targets", series.where("vs_heroes"))}


def _movement(docs: DataFrame, head: list[Column], combat_names: dict[int, str], move_names: dict[int, str]) -> dict[str, DataFrame]:
    m = F.col("match_paths")
    rows = docs.select(*head, "duration_s", "slot_account", "slot_hero", F.coalesce(F.nullif(m["interval_s"], F.lit(0)), F.lit(1.0)).alias("step"), m["x_resolution"].alias("xr"), m["y_resolution"].alias("yr"), F.explode(m["paths"]).alias("p"))
    n = F.least(F.size("p.x_pos"), F.floor(F.col("duration_s") / F.col("step")) + 1).cast("int")
    zipped = F.slice(F.arrays_zip(*(F.col(f"p.{c}") for c in ("x_pos", "y_pos", "health", "combat_type", "move_type"))), 1, n)
    rows = rows.where(n > 0).select("*", F.posexplode(zipped).alias("k", "z"))
    world = lambda axis: F.col(f"p.{axis}_min") + F.col(f"z.{axis}_pos") * F.coalesce(F.try_divide(F.col(f"p.{axis}_max") - F.col(f"p.{axis}_min"), F.col(f"{axis}r")), F.lit(0.0))
    movement = rows.select(
        *head, F.col("slot_account")[F.col("p.player_slot")].alias("account_id"), F.col("slot_hero")[F.col("p.player_slot")].alias("hero_id"), F.bround(F.col("k") * F.col("step")).cast("long").alias("game_time_s"),
        world("x").alias("x"), world("y").alias("y"), F.col("z.health").alias("health_percent"), _named(F.col("z.combat_type"), combat_names).alias("combat_type"), _named(F.col("z.move_type"), move_names).alias("move_type"),
    )
    return {"movement": movement, "movement_intervals": movement_intervals(movement)}


def movement_intervals(movement: DataFrame, cap: float = 2500.0, still: float = 40.0) -> DataFrame:
    """Per player and minute: seconds alive and in each way of moving, dashes begun, and the way gone.

    ``moving_s`` are the seconds with a step from the second before, ``stationary_s`` those of them with a short one;
    a dash begins where another state was known before it.
    """
    window = Window.partitionBy("match_id", "account_id").orderBy("game_time_s")
    alive = movement.where("health_percent > 0")
    before = lambda c: F.lag(c).over(window)
    move = F.col("move_type")
    zip_now, zip_before = move == "ziplining", before("move_type") == "ziplining"
    step = F.sqrt(F.pow(F.col("x") - before("x"), 2) + F.pow(F.col("y") - before("y"), 2))
    joined = (F.col("game_time_s") - before("game_time_s") == 1) & ~zip_now & ~zip_before
    rows = alive.withColumn("step", F.when(joined & (step < cap), step)).withColumn("entered", F.when(before("move_type") != move, move))
    count = lambda p: F.count(F.when(p, 1))
    minute = (F.floor(F.col("game_time_s") / 60) * 60).cast("long")
    return rows.groupBy("match_id", "start_time", "account_id", "hero_id", minute.alias("start_s")).agg(
        F.count(F.lit(1)).alias("alive_s"), count(F.col("step").isNotNull()).alias("moving_s"), count(F.col("step") < still).alias("stationary_s"), count(move == "slide").alias("slide_s"), count(move == "in_air").alias("in_air_s"), count(zip_now).alias("zipline_s"),
        count(F.col("combat_type") == "player").alias("combat_s"), count(F.col("entered") == "ground_dash").alias("dashes"), count(F.col("entered") == "air_dash").alias("air_dashes"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance"),
    )


def one_body_each(bodies: DataFrame) -> DataFrame:
    """One body per match: a real salt beats the placeholder 0, then the name decides."""
    first = F.row_number().over(Window.partitionBy("match_id").orderBy((F.col("salt") == 0), "name"))
    return bodies.withColumn("_n", first).where("_n = 1").drop("_n")


def with_accounts(docs: DataFrame, accounts: list[int]) -> DataFrame:
    """Documents of matches in which one of the accounts played."""
    return docs.where(F.exists("players", lambda p: p["account_id"].isin(accounts)))
