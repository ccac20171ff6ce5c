"""Dimension tables from recorded histories: one JSON record per id and era, spread over flat tables.

A history has ``from`` (the era's start as ISO text, UTC where it names no zone), ``build``, ``id`` and ``record``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.schemas import TABLES
from tallyforge.sources.store import Store, conform

ERA = ["era_from", "client_version"]
_WEAPON = [c for c in TABLES["ability_weapon_history"].names if c not in ("ability_class", *ERA)]
ITEM = "id long, name string, class_name string, cost long, slot string, tier long, is_active boolean, description string, components array<string>"
HERO = (
    "id long, name string, class_name string, hero_type string, gun_tag string, complexity long, player_selectable boolean, disabled boolean, "
    "levels array<struct<level: long, required_souls: long, standard_upgrade: boolean, currencies: array<string>>>, stats map<string, string>, level_up map<string, string>, "
    "cost_bonuses map<string, array<struct<souls: long, bonus: double>>>"
)
ABILITY = (
    "class_name string, id long, name string, hero long, kind string, description string, properties map<string, string>, scaling map<string, struct<stat: string, scale: double>>, "
    f"upgrades array<array<struct<property: string, bonus: double, type: string, stat: string>>>, weapon struct<{', '.join(f'`{c}`: double' for c in _WEAPON)}>"
)


def era_start(text: Column) -> Column:
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, text).when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z"))).cast("timestamp")


def decoded(history: DataFrame, record: str) -> DataFrame:
    """The records' fields with their era."""
    rows = history.select(era_start(F.col("from")).alias("era_from"), F.col("build").cast("long").alias("client_version"), F.from_json("record", record).alias("r"))
    return rows.select("r.*", *ERA)


def _flag(name: str) -> Column:
    return F.coalesce(name, F.lit(False)).alias(name)


def item_tables(history: DataFrame) -> dict[str, DataFrame]:
    rec = decoded(history, ITEM).withColumnRenamed("id", "item_id")
    parts = rec.select("item_id", *ERA, F.posexplode("components").alias("position", "component_class_name"))
    return _conformed({"item_history": rec.drop("components").withColumn("is_active", _flag("is_active")), "item_component_history": parts})


def hero_tables(history: DataFrame) -> dict[str, DataFrame]:
    rec = decoded(history, HERO).withColumnRenamed("id", "hero_id")
    reached = rec.select("hero_id", *ERA, F.inline("levels"))
    levels = reached.drop("currencies").withColumns({"required_souls": F.coalesce("required_souls", F.lit(0)), "standard_upgrade": _flag("standard_upgrade")})
    spread = lambda column, value: rec.select("hero_id", *ERA, F.explode(column).alias("stat", value)).withColumn(value, F.col(value).try_cast("double"))
    gained = reached.select("hero_id", "level", *ERA, F.explode("currencies").alias("currency")).groupBy("hero_id", "level", "currency", *ERA).agg(F.count(F.lit(1)).alias("amount"))
    curves = rec.select("hero_id", *ERA, F.explode("cost_bonuses").alias("slot", "_steps")).select("hero_id", *ERA, "slot", F.posexplode("_steps").alias("position", "_s")).select("hero_id", "slot", "position", "_s.*", *ERA)
    heroes = rec.drop("levels", "stats", "level_up", "cost_bonuses").withColumns({c: _flag(c) for c in ("player_selectable", "disabled")})
    return _conformed({
        "hero_history": heroes,
        "hero_level_history": levels,
        "hero_level_currency_history": gained,
        "hero_cost_bonus_history": curves,
        "hero_stat_history": spread("stats", "value"),
        "hero_level_up_history": spread("level_up", "per_level_value"),
    })


def ability_tables(history: DataFrame) -> dict[str, DataFrame]:
    """A property has a row where it has a value, a scaling or both; tiers of upgrades count from 1."""
    rec = decoded(history, ABILITY).withColumnRenamed("class_name", "ability_class")
    keys = lambda column: F.coalesce(F.map_keys(column), F.array().cast("array<string>"))
    names = rec.select("ability_class", *ERA, "properties", "scaling", F.explode(F.array_union(keys("properties"), keys("scaling"))).alias("property"))
    scale = F.col("scaling")[F.col("property")]
    properties = names.select("ability_class", "property", F.col("properties")[F.col("property")].try_cast("double").alias("value"), scale["stat"].alias("scale_stat"), scale["scale"].alias("scale"), *ERA)
    upgrades = rec.select("ability_class", *ERA, F.posexplode("upgrades").alias("_n", "_steps")).select("ability_class", (F.col("_n") + 1).alias("tier"), F.inline("_steps"), *ERA)
    weapons = rec.where("kind = 'weapon'").select("ability_class", *(F.col("weapon")[c].alias(c) for c in _WEAPON), *ERA)
    return _conformed({
        "ability_history": rec.drop("properties", "scaling", "upgrades", "weapon"),
        "ability_property_history": properties,
        "ability_upgrade_history": upgrades,
        "ability_weapon_history": weapons,
    })


def rank_tables(history: DataFrame) -> dict[str, DataFrame]:
    return _conformed({"rank_history": decoded(history, "tier long, name string")})


def statue_tables(history: DataFrame) -> dict[str, DataFrame]:
    """A permanent pickup's name holds its buff and, from 2 on, its level; a power-up's only its buff; other names neither."""
    rec, name = decoded(history, "class_name string, stat string, value double"), F.col("class_name")
    permanent, temporary = r"^(\w+?)_permanent_pickup(?:_lv(\d+))?$", r"^(\w+?)_powerup_pickup$"
    level = F.when(name.rlike(permanent), F.coalesce(F.regexp_extract(name, permanent, 2).try_cast("long"), F.lit(1)))
    buff = F.when(name.rlike(permanent), F.regexp_extract(name, permanent, 1)).when(name.rlike(temporary), F.regexp_extract(name, temporary, 1))
    return _conformed({"statue_history": rec.withColumns({"buff": buff, "level": level})})


def _conformed(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: conform(rows, TABLES[name]) for name, rows in tables.items()}


SPREADS: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {"item": item_tables, "hero": hero_tables, "ability": ability_tables, "rank": rank_tables, "statue": statue_tables}


def refresh(store: Store, histories: Mapping[str, DataFrame]) -> list[str]:
    """Rewrites the dimension tables of the kinds given (keys of ``SPREADS``); the tables written are returned."""
    written = []
    for kind, history in histories.items():
        for table, rows in SPREADS[kind](history).items():
            store.overwrite(table, rows)
            written.append(table)
    return written


# Reading a history


def era_list(history: DataFrame) -> DataFrame:
    return history.select("from", "build").distinct()


def records_asof(history: DataFrame, at: str) -> DataFrame:
    """All records of the era live at a time; before the first era, of the first."""
    start = era_start(F.col("from"))
    live = history.agg(F.coalesce(F.max(F.when(start <= F.lit(at).cast("timestamp"), start)), F.min(start)).alias("_live"))
    return history.join(F.broadcast(live), start == F.col("_live")).drop("_live")  # one row


def leaves(records: DataFrame, keys: list[str], record: str, depth: int = 8) -> DataFrame:
    """One row per scalar of a nested JSON record: its dotted ``path`` and its ``value`` as text.

    What lies deeper than ``depth`` levels stays together as JSON text; empty objects and arrays have no row.
    """
    tvf = records.sparkSession.tvf
    rows, found = records.select(*keys, F.lit("").alias("path"), F.parse_json(record).alias("v")), None
    for level in range(depth + 1):
        nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        ends = rows if level == depth else rows.where(~nested)
        ends = ends.select(*keys, "path", F.when(nested, F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string")).alias("value"))
        found = ends if found is None else found.unionByName(ends)
        if level < depth:
            inner = rows.where(nested).lateralJoin(tvf.variant_explode(F.col("v").outer()))
            step = F.coalesce("key", F.col("pos").cast("string"))
            rows = inner.select(*keys, F.when(F.col("path") == "", step).otherwise(F.concat("path", F.lit("."), step)).alias("path"), F.col("value").alias("v"))
    return found


def record_changes(history: DataFrame, depth: int = 8) -> DataFrame:
    """Per id and era the leaves that differ from the era before: changed, added (``old`` null) and removed (``new`` null)."""
    number = F.row_number().over(Window.partitionBy("id").orderBy("from", "build"))
    eras = history.select("id", "from", "build", "record").withColumn("n", number)
    flat = leaves(eras, ["id", "n"], "record", depth)
    last = eras.groupBy("id").agg(F.max("n").alias("_last"))
    before = flat.join(last, "id").where("n < _last").select("id", (F.col("n") + 1).alias("n"), "path", F.col("value").alias("old"))
    both = flat.where("n > 1").withColumnRenamed("value", "new").join(before, ["id", "n", "path"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).join(eras.drop("record"), ["id", "n"]).select("id", "from", "build", "path", "old", "new")
