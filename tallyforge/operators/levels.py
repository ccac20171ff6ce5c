"""Figures of a hero or an ability at a level or a tier: boons, guns, scaled values, changes by tier; labels of ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.eras import asof_join, folded, highest_reached

#: Base stats and their gain for each standard level.
BASES = {"health": "max_health", "light": "light_melee_damage", "heavy": "heavy_melee_damage"}
GAINS = {"health": "base_health_from_level", "spirit": "tech_power", "bullet": "base_bullet_damage_from_level", "melee": "base_melee_damage_from_level"}
#: What levels give to spend.
CURRENCIES = ("ability_points", "ability_unlocks")
#: Names of the six levels in a rank.
SUBRANKS = ("I", "II", "III", "IV", "V", "VI")


def named_values(rows: DataFrame, by: Sequence[str], name: str, value: str, wanted: Mapping[str, str]) -> DataFrame:
    """Rows of name and value side by side, 0 where a name is missing."""
    return rows.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col(name) == n, F.col(value))), F.lit(0.0)).alias(c) for c, n in wanted.items()))


def boon_stats(levels: DataFrame, stats: DataFrame, gains: DataFrame, by: Sequence[str]) -> DataFrame:
    """What each level of a hero gives: every standard level up to it adds the hero's gains to its base.

    ``levels``: by, level, standard_upgrade; ``stats``: by, stat, value; ``gains``: by, stat, per_level_value.  A melee
    gain counts for heavy hits in the proportion of heavy to light.
    """
    upto = Window.partitionBy(*by).orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("standard_upgrade").cast("long")).over(upto)
    base = named_values(stats, by, "stat", "value", {f"_b_{c}": s for c, s in BASES.items()})
    gain = named_values(gains, by, "stat", "per_level_value", {f"_g_{c}": s for c, s in GAINS.items()})
    rows = levels.withColumn("standard_levels", n).join(base, list(by), "left").join(gain, list(by), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    added = {c: zero(f"_g_{c}") * F.col("standard_levels") for c in GAINS}
    light, heavy = zero("_b_light"), zero("_b_heavy")
    return rows.select(
        *by, "level", "standard_levels", (zero("_b_health") + added["health"]).alias("max_health"), added["spirit"].alias("spirit_power"), added["bullet"].alias("bullet_damage_bonus"),
        (light + added["melee"]).alias("light_melee_damage"), (heavy + F.when(light != 0, added["melee"] * heavy / light).otherwise(0.0)).alias("heavy_melee_damage"),
    )


def with_currencies(levels: DataFrame, currencies: DataFrame, by: Sequence[str], names: Sequence[str] = CURRENCIES) -> DataFrame:
    """Adds how much of each currency all levels up to each one have given; ``currencies``: by, level, currency, amount."""
    at_level = currencies.groupBy(*by, "level").agg(*(F.sum(F.when(F.col("currency") == n, F.col("amount"))).alias(n) for n in names))
    upto = Window.partitionBy(*by).orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    rows = levels.join(at_level, [*by, "level"], "left")
    return rows.withColumns({n: F.coalesce(F.sum(n).over(upto), F.lit(0)) for n in names})


def boons_at_souls(left: DataFrame, levels: DataFrame, boons: DataFrame, by: Sequence[str], souls: str) -> DataFrame:
    """The boons of the highest level whose ``required_souls`` a row's souls reach; level 0 and nulls before the first."""
    reached = highest_reached(left, levels.select(*by, "required_souls", "level"), by, souls, "required_souls", "level")
    return reached.withColumn("level", F.coalesce("level", F.lit(0))).join(boons, [*by, "level"], "left")


def gun_at_level(guns: DataFrame, bonus: str) -> DataFrame:
    """Damage of a bullet with a bonus added, and damage per second in proportion; guns without bullet damage are left out."""
    bullet = F.col("bullet_damage") + F.coalesce(bonus, F.lit(0.0))
    rows = guns.where("bullet_damage != 0")
    return rows.withColumns({"bullet": bullet, "dps": F.coalesce("damage_per_second", F.lit(0.0)) * bullet / F.col("bullet_damage")})


def alternate_gun(guns: DataFrame) -> DataFrame:
    """A second firing mode as it is, for boons don't raise it: bullet, dps, bullets a second for each pellet, and ammo."""
    pellets = F.coalesce(F.nullif("bullets", F.lit(0.0)), F.lit(1.0))
    rate = F.coalesce("bullets_per_second", F.lit(0.0)) / pellets
    return guns.where("bullet_damage <> 0").withColumns({"bullet": F.col("bullet_damage"), "dps": F.coalesce("damage_per_second", F.lit(0.0)), "shots_per_second": rate, "ammo": F.coalesce("clip_size", F.lit(0.0))})


def scaling_asof(left: DataFrame, levels: DataFrame, at: str, values: Sequence[str]) -> DataFrame:
    """What was true of a hero's level at the time of each row."""
    return asof_join(left, levels, ["hero_id", "level"], at, values)


def resolved_values(values: DataFrame, scales: DataFrame, context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A value with its scalings: plus the sum of scale times the context's stat, unknown stats counting as 0.

    ``values``: keys, value; ``scales``: keys, stat, scale; ``context``: stat, amount, one row per stat.
    """
    added = scales.join(context, "stat").groupBy(*keys).agg(F.sum(F.col("scale") * F.col("amount")).alias("_added"))
    return values.join(added, list(keys), "left").withColumn("resolved", F.col("value") + F.coalesce("_added", F.lit(0.0))).drop("_added")


def tier_changes(abilities: DataFrame, keys: Sequence[str], base: str, steps: str) -> DataFrame:
    """The value before and after each tier's upgrades, where they change it; ``steps`` are structs of tier, kind, bonus in order."""
    rows = abilities.select(*keys, base, steps, F.explode(F.array_distinct(F.transform(steps, lambda s: s["tier"]))).alias("tier"))
    upto = lambda keep: folded(F.col(base), F.filter(steps, keep), "kind", "bonus")
    out = rows.select(*keys, "tier", upto(lambda s: s["tier"] < F.col("tier")).alias("before"), upto(lambda s: s["tier"] <= F.col("tier")).alias("after"))
    return out.where("before != after")


def rank_label(badge: Column, tier_name: Column) -> Column:
    """``<tier> <level>`` with the level in Roman digits, the tier alone for tier 0, ``badge<n>`` for an unknown tier."""
    level = F.coalesce(F.try_element_at(F.array(*map(F.lit, SUBRANKS)), F.nullif(badge % 10, F.lit(0)).cast("int")), (badge % 10).cast("string"))
    known = F.when(badge < 10, tier_name).otherwise(F.concat(tier_name, F.lit(" "), level))
    return F.when(tier_name.isNull(), F.concat(F.lit("badge"), badge.cast("string"))).otherwise(known)


def with_rank_label(rows: DataFrame, ranks: DataFrame, badge: str, at: str, name: str = "rank") -> DataFrame:
    """Adds the rank's label by the tier names of each row's own time, of the first era before that."""
    tiers = ranks.select(F.col("tier").cast("long").alias("_tier"), F.col("name").alias("_name"), F.col("era_from").alias("_from"))
    out = asof_join(rows.withColumn("_tier", F.floor(F.col(badge) / 10).cast("long")), tiers, ["_tier"], at, ["_name"], "_from")
    return out.withColumn(name, rank_label(F.col(badge), F.col("_name"))).drop("_tier", "_name", "_from")


def least_badge(ranks: DataFrame, name: str) -> DataFrame:
    """The lowest badge of the rank of a name, in any case; no row for a name that is unknown."""
    return ranks.where(F.lower("name") == name.lower()).select((F.max("tier") * 10 + 1).alias("badge")).where("badge IS NOT NULL")
