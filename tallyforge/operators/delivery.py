"""Damage rows by what delivers them, names of damage sources, and what a match's permanent buffs gave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.labels import damage_category
from tallyforge.operators.eras import asof_join


def with_delivery(rows: DataFrame, games: DataFrame, item_eras: DataFrame, match: str, source: str, at: str, on_hit: Sequence[str] = ()) -> DataFrame:
    """Adds ``category`` and ``delivery``: gun, ability, gun_proc or spirit_proc; total rows have no delivery.

    An item works through the gun where its slot, in the era live at the match's start, is ``weapon``, or where it is
    one of ``on_hit``.  Only distinct items of a match meet the eras, not every damage row.
    """
    rows = rows.withColumn("category", damage_category(F.col(source)))
    pairs = rows.where("category = 'item'").select(match, source).distinct().join(games.select(match, at), match)
    slots = asof_join(pairs, item_eras, [source], at, ["slot"]).select(match, source, "slot")
    by_gun = F.col(source).isin(*on_hit) | F.coalesce(F.col("slot") == "weapon", F.lit(False))
    item = F.when(by_gun, "gun_proc").otherwise("spirit_proc")
    delivery = F.when(F.col("category").isin("gun", "ability"), F.col("category")).when(F.col("category") == "item", item)
    return rows.join(slots, [match, source], "left").withColumn("delivery", delivery).drop("slot")


def source_labels(abilities: DataFrame, items: DataFrame, key: str = "class_name", name: str = "name") -> DataFrame:
    """One label per class: the ability's name before the item's, and for each a critical variant."""
    both = abilities.select(key, name, F.lit(0).alias("_p")).unionByName(items.select(key, name, F.lit(1).alias("_p")))
    both = both.where(F.col(name).isNotNull()).groupBy(key).agg(F.min(F.struct("_p", name)).getField(name).alias(name))
    crit = both.select(F.concat(key, F.lit("_crit")).alias(key), F.concat(name, F.lit(" (crit)")).alias(name))
    return both.unionByName(crit.join(both.select(key), key, "left_anti"))


def with_source_name(rows: DataFrame, labels: DataFrame, source: str, key: str = "class_name", name: str = "name") -> DataFrame:
    """Adds ``source_name``; a class without a label keeps its raw name."""
    dim = labels.select(F.col(key).alias(source), F.col(name).alias("source_name"))
    return rows.join(dim, source, "left").withColumn("source_name", F.coalesce("source_name", source))


def buff_gains(buffs: DataFrame, games: DataFrame, value_eras: DataFrame, match: Sequence[str], family: str, pickup: str, count: Column, at: str) -> DataFrame:
    """Per family its pickups and what they gave, by each pickup's value in the era live at the match's start.

    A family with a pickup of unknown value, taken at least once, is unknown as a whole: null.
    """
    n = buffs.withColumn("_count", count).groupBy(*match, family, pickup).agg(F.sum("_count").alias("_count"))
    valued = asof_join(n.join(games.select(*match, at), list(match)), value_eras, [pickup], at, ["value"])
    unknown = F.coalesce(F.bool_or(F.col("value").isNull() & (F.col("_count") != 0)), F.lit(False))
    gained = F.coalesce(F.sum(F.col("_count") * F.col("value")), F.lit(0))
    return valued.groupBy(*match, family).agg(F.sum("_count").alias("pickups"), F.when(~unknown, gained).alias("gained"))
