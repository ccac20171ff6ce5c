"""Labels of raw enum values and class names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lane numbers and their colours.
LANES = {1: "yellow", 4: "blue", 6: "green"}
#: Ids of income sources.
SOUL_SOURCES = {
    1: "players", 2: "troopers", 3: "jungle", 4: "bosses", 5: "treasure", 6: "assists", 7: "denies", 8: "team_bonus",
    9: "assassinate", 10: "trophy_collector", 11: "cultist_sacrifice", 12: "breakables", 13: "goose_egg",
}
#: Groups of income sources; rare and catch-up sources have none.
SOUL_GROUPS = {"troopers": "waves", "denies": "waves", "jungle": "roaming", "breakables": "roaming", "players": "combat", "assists": "combat", "bosses": "objectives", "treasure": "objectives"}
#: Figures that are sums of income sources.
SOUL_COMPOSITES = {
    "farm": ("troopers", "jungle", "breakables", "treasure", "denies"), "troopers": ("troopers",), "jungle": ("jungle",), "breakables": ("breakables",), "rift_urn": ("treasure",), "deny_souls": ("denies",),
    "combat": ("players", "assists"), "objectives": ("bosses",), "catch_up": ("team_bonus",), "other": ("trophy_collector", "cultist_sacrifice", "assassinate", "goose_egg"),
}
#: Names of match modes and game modes.
MATCH_MODES = {0: "Invalid", 1: "Standard", 2: "Private Lobby", 3: "Coop Bot", 4: "Ranked", 5: "Server Test", 6: "Tutorial", 7: "Hero Labs", 8: "New Player Placement"}
GAME_MODES = {0: "Invalid", 1: "Normal", 2: "1v1Test", 3: "Sandbox", 4: "Street Brawl", 5: "Explore NYC", 6: "Internal"}
#: Names of the damage matrix's figures, and of states on the way.
STAT_NAMES = {0: "damage", 1: "healing", 2: "heal_prevented", 3: "mitigated", 4: "lethal_damage", 5: "regen"}
COMBAT_NAMES = {0: "out", 1: "player", 2: "enemy_npc", 3: "neutral"}
MOVE_NAMES = {0: "normal", 1: "ability", 2: "ability_debuff", 3: "ground_dash", 4: "slide", 5: "rope_climbing", 6: "ziplining", 7: "in_air", 8: "air_dash"}
#: Ids of objectives, and the lanes of those that stand in one; the second lane is retired.
OBJECTIVES = {
    0: "Weakened Patron", 1: "Guardian", 2: "Guardian", 3: "Guardian", 4: "Guardian", 5: "Walker", 6: "Walker", 7: "Walker", 8: "Walker",
    9: "Patron", 10: "Shrine", 11: "Shrine", 12: "Base Guardians", 13: "Base Guardians", 14: "Base Guardians", 15: "Base Guardians",
}
OBJECTIVE_LANES = {1: "yellow", 3: "blue", 4: "green", 5: "yellow", 7: "blue", 8: "green", 12: "yellow", 14: "blue", 15: "green"}
#: Fixed value: class names of statues, with their level unless it is the first; buffs of limited time.
STATUE, TIMED = r"^(\w+?)_permanent_pickup(?:_lv(\d+))?$", r"^(\w+?)_powerup_pickup$"
#: Sources whose damage rows repeat the detail rows.
TOTAL_CLASSES = ("Bullet", "Ability", "Melee", "Misc")

#: Fixed value: how classes of guns themselves begin.
GUN_CLASSES = "^citadel_weapon"


def mapped(value: Column, names: dict) -> Column:
    """The name of a value, null for unknown ones."""
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[value]


def match_mode_name(mode: Column) -> Column:
    return mapped(mode, MATCH_MODES)


def game_mode_name(mode: Column) -> Column:
    return mapped(mode, GAME_MODES)


def soul_group(source: Column) -> Column:
    """The group of an income source's id: waves, roaming, combat or objectives; null for others."""
    return mapped(soul_source_name(source), SOUL_GROUPS)


def composite_sources(name: str) -> list[int]:
    """The ids of the income sources that a composite figure sums."""
    return [k for k, n in SOUL_SOURCES.items() if n in SOUL_COMPOSITES[name]]


def lane_name(lane: Column) -> Column:
    return mapped(lane, LANES)


def mapped_or_number(value: Column, names: dict) -> Column:
    return F.coalesce(mapped(value, names), value.cast("string"))


def name_or_id(df: DataFrame, key: str, names: DataFrame, name: str, prefix: str = "id") -> DataFrame:
    """Adds ``name`` from the table ``names`` (``key``, ``name``); unknown keys become ``id<key>``, null stays null."""
    joined = df.join(names.select(key, name), key, "left")
    return joined.withColumn(name, F.when(F.col(key).isNotNull(), F.coalesce(name, F.concat(F.lit(prefix), F.col(key).cast("string")))))


def soul_source_name(source: Column) -> Column:
    return mapped_or_number(source, SOUL_SOURCES)


def objective_name(objective: Column) -> Column:
    return mapped(objective, OBJECTIVES)


def objective_lane(objective: Column) -> Column:
    """The lane's colour, null for objectives that stand in none."""
    return mapped(objective, OBJECTIVE_LANES)


def buff_family(class_name: Column) -> Column:
    """What a pickup's class name says it raises, null for other classes."""
    return F.when(class_name.rlike(STATUE), F.regexp_extract(class_name, STATUE, 1)).when(class_name.rlike(TIMED), F.regexp_extract(class_name, TIMED, 1))


def buff_level(class_name: Column) -> Column:
    """A statue's level, 1 where its class name has none; null for buffs of limited time and other classes."""
    digits = F.regexp_extract(class_name, STATUE, 2)
    return F.when(class_name.rlike(STATUE), F.when(digits == "", F.lit(1).cast("long")).otherwise(digits.try_cast("long")))


def plain_name(name: Column) -> Column:
    """A display name in lower case without all but letters and digits, for comparison."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def hero_filter(heroes: DataFrame, name: str, key: str = "hero_id", label: str = "name") -> Column:
    """Predicate for the hero of that name, however it is written; an unknown name is an error."""
    found = heroes.where(plain_name(F.col(label)) == plain_name(F.lit(name))).select(F.min(key)).first()[0]
    if found is None:
        raise ValueError(f"no hero is named {name!r}")
    return F.col(key) == found


def with_hero_name(rows: DataFrame, heroes: DataFrame, key: str = "hero_id", label: str = "name") -> DataFrame:
    return name_or_id(rows, key, heroes.select(key, F.col(label).alias("hero")), "hero")


def with_soul_source_name(rows: DataFrame, source: str = "source") -> DataFrame:
    return rows.withColumn("source_name", soul_source_name(F.col(source)))


def with_lane_name(rows: DataFrame, lane: str = "assigned_lane") -> DataFrame:
    return rows.withColumn("lane", lane_name(F.col(lane)))


def with_objective_labels(rows: DataFrame, objective: str = "objective_id") -> DataFrame:
    return rows.withColumns({"objective": objective_name(F.col(objective)), "lane": objective_lane(F.col(objective))})


def with_buff_labels(rows: DataFrame, class_name: str = "type") -> DataFrame:
    return rows.withColumns({"buff": buff_family(F.col(class_name)), "level": buff_level(F.col(class_name))})


def with_stack_labels(rows: DataFrame, abilities: DataFrame, items: DataFrame, key: str = "ability_id") -> DataFrame:
    """Adds ``class_name`` and ``name`` of a stack counter; an item goes before an ability of the same id.

    ``abilities`` and ``items`` have ``id``, ``class_name`` and ``name``; items without a class are left out.
    """
    known = items.where("class_name IS NOT NULL").select("id", "class_name", "name", F.lit(0).alias("_n")).unionByName(abilities.select("id", "class_name", "name", F.lit(1).alias("_n")))
    first = known.groupBy("id").agg(F.min_by(F.struct("class_name", "name"), F.struct("_n", "class_name", "name")).alias("_first"))
    return rows.join(first.withColumnRenamed("id", key), key, "left").withColumns({"class_name": F.col("_first.class_name"), "name": F.col("_first.name")}).drop("_first")


def damage_category(source: Column, gun: str = GUN_CLASSES) -> Column:
    """``total``, ``item``, ``gun`` or ``ability`` by the class name; ``gun`` is the pattern of weapon classes."""
    return (
        F.when(source.isin(*TOTAL_CLASSES), "total")
        .when(source.startswith("upgrade_"), "item")
        .when(source.rlike(gun), "gun")
        .otherwise("ability")
    )


def scored(not_scored: Column, outcome: Column) -> Column:
    return ~F.coalesce(not_scored, F.lit(False)) & ~outcome.eqNullSafe(F.lit(5))


def mode_filter(match_mode=(1, 4), game_mode=(1,), ranked: bool | None = None) -> Column:
    """Predicate on ``match_mode``, ``game_mode`` and ``ranked_type``; None lifts a condition, null ranks as ranked."""
    out = F.lit(True)
    for name, wanted in (("match_mode", match_mode), ("game_mode", game_mode)):
        if wanted is not None:
            out = out & F.col(name).isin(*(wanted if isinstance(wanted, (list, tuple, set)) else [wanted]))
    if ranked is not None:
        is_ranked = F.coalesce(F.col("ranked_type"), F.lit(1)) != 0
        out = out & (is_ranked if ranked else ~is_ranked)
    return out
