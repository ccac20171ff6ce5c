"""Versioned dimensions: as-of joins against eras, compaction of snapshots into eras, change timelines, folds over tiers.

As-of joins are sweeps: rows and the marks they look for are sorted together, and the last mark is carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "0001-01-01"
#: Tasks that the rows of one key are dealt over.
SPREAD = 8


def latest_mark(rows: DataFrame, marks: DataFrame, by: Sequence[str], at: Column, mark_at: Column, tie: Sequence[Column], values: Sequence[str], spread: int = SPREAD) -> DataFrame:
    """Each row with the ``values`` of its key's latest mark at or before it, null where there is none.

    Rows and marks of a key are put in one order of time, and the last mark goes along: one sort, however many marks a
    key has.  A key's rows are dealt over ``spread`` tasks, each with a copy of the (far fewer) marks, so no key is one
    task.  Marks of one time count by ``tie``, the last one.  Rows without a key or a time have nulls, and stay.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    mine = rows.select(*(F.col(b).alias(k) for k, b in zip(keys, by)), F.pmod(F.xxhash64(*hashed), F.lit(spread)).cast("int").alias("_part"), at.alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    known = marks
    for b in by:
        known = known.where(F.col(b).isNotNull())
    theirs = known.select(
        *(F.col(b).alias(k) for k, b in zip(keys, by)), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_part"), mark_at.alias("_at"), F.lit(0).alias("_side"),
        *(t.alias(f"_t{i}") for i, t in enumerate(tie)), F.struct(F.lit(True).alias("_found"), *values).alias("_mark"),
    ).where("_at IS NOT NULL")
    order = Window.partitionBy(*keys, "_part").orderBy("_at", "_side", *(f"_t{i}" for i in range(len(tie)))).rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_mark", F.last("_mark", ignorenulls=True).over(order)).where("_side = 1")
    return both.select("_row.*", *(F.col(f"_mark.{v}").alias(v) for v in values))


def asof_join(left: DataFrame, eras: DataFrame, by: Sequence[str], at: str, values: Sequence[str], start: str = "era_from", spread: int = SPREAD) -> DataFrame:
    """The era live at ``left[at]``, per key; earlier rows take the key's first era, unknown keys get nulls.

    Every row of ``left`` stays once.  A key's first era is found among its eras, so no table is sent through the driver.
    """
    dim = eras.select(*by, start, *values)
    if by:
        dim = dim.withColumn("_first", F.min(start).over(Window.partitionBy(*by)))
    else:
        dim = dim.crossJoin(F.broadcast(dim.agg(F.min(start).alias("_first"))))  # one row
    begins = F.when(F.col(start) == F.col("_first"), F.lit(EPOCH).cast("timestamp")).otherwise(F.col(start).cast("timestamp"))
    return latest_mark(left, dim.withColumn("_begins", begins), by, F.col(at).cast("timestamp"), F.col("_begins"), (), [start, *values], spread)


def keyless_asof(left: DataFrame, eras: DataFrame, at: str, start: str = "era_from") -> DataFrame:
    """The start of the era live at ``left[at]``, for eras without a key; rows are dealt over many tasks."""
    return asof_join(left, eras.select(start).distinct(), [], at, [], start, 16 * SPREAD)


def listed_eras(dim: DataFrame, by: Sequence[str], start: str, value: str) -> DataFrame:
    """One row per key with all its eras, ``_eras``, for dimensions whose keys have few: when each begins, and its ``value``.

    The first era of a key begins before all times.  See ``live_of``.
    """
    of = dim.groupBy(*by).agg(F.min(start).alias("_first"), F.collect_list(F.struct(F.col(start).alias("start"), F.col(value).alias("value"))).alias("_eras"))
    begins = lambda e: F.when(e["start"] == F.col("_first"), F.lit(EPOCH).cast("timestamp")).otherwise(e["start"].cast("timestamp"))
    return of.select(*by, F.transform("_eras", lambda e: F.struct(begins(e).alias("begins"), e["value"].alias("value"))).alias("_eras"))


def live_of(eras: str, at: Column) -> Column:
    """The value of the era live at a time, of the list that ``listed_eras`` gives; null without a time."""
    return F.array_max(F.filter(eras, lambda e: e["begins"] <= at.cast("timestamp")))["value"]


def compacted(states: DataFrame, by: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """Of consecutive states only those that differ from the one before; a change that is reverted stays."""
    before = F.lag(digest).over(Window.partitionBy(*by).orderBy(*order)) if by else F.lag(digest).over(Window.orderBy(*order))
    return states.withColumn("_before", before).where(~F.col(digest).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def snapshot_digest(records: DataFrame, snapshot: Sequence[str], record_id: str, record: str) -> DataFrame:
    """One digest per snapshot over all its records, in whatever order: their number, and the sums of two row hashes.

    Each record is hashed by itself, so a snapshot of any size is summed up in parts and nothing is collected; whole
    numbers are summed as decimals, which can't overflow.
    """
    hashed = F.sha2(F.to_json(F.struct(F.col(record_id).cast("string").alias("id"), F.col(record).alias("record"))), 256)
    part = lambda at: F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(38,0)")
    sums = records.groupBy(*snapshot).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(part(at)).alias(f"_h{at}") for at in (1, 16, 31, 46)))
    return sums.select(*snapshot, F.sha2(F.concat_ws(":", "_n", *(f"_h{at}" for at in (1, 16, 31, 46))), 256).alias("digest"))


def new_eras(records: DataFrame, build: str, record_id: str, record: str, stored: DataFrame | None = None) -> DataFrame:
    """The builds that begin an era, with their digest: those whose records differ from the build before.

    ``stored`` has the eras found so far (``build``, ``digest``); only builds after its last one are hashed, and the first
    of them is compared with it.  A change that is taken back begins an era, and so does the taking back.
    """
    before = None
    if stored is not None:
        last = stored.agg(F.max_by(F.struct(F.col(build).alias(build), "digest"), build).alias("_l"))
        before = last.where("_l IS NOT NULL").select("_l.*")
        records = records.crossJoin(F.broadcast(last)).where(F.col("_l").isNull() | (F.col(build) > F.col(f"_l.{build}"))).drop("_l")  # one row
    states = snapshot_digest(records, [build], record_id, record)
    both = states.withColumn("_new", F.lit(True))
    if before is not None:
        both = both.unionByName(before.withColumn("_new", F.lit(False)))
    return compacted(both, [], [build], "digest").where("_new").drop("_new")  # one row per build


def changes(leaves: DataFrame, by: Sequence[str], path: str, value: str, order: Sequence[str]) -> DataFrame:
    """Rows where a path's value differs from that of the state before, with the old value."""
    window = Window.partitionBy(*by, path).orderBy(*order)
    out = leaves.withColumn("old", F.lag(value).over(window)).withColumn("_n", F.row_number().over(window))
    return out.where((F.col("_n") > 1) & ~F.col("old").eqNullSafe(F.col(value))).drop("_n")


def folded(base: Column, steps: Column, kind: str, bonus: str) -> Column:
    """Upgrades applied in order to a base: ``add`` adds the bonus, ``multiply`` multiplies by it."""
    return F.aggregate(steps, base.cast("double"), lambda total, s: F.when(s[kind] == "multiply", total * s[bonus]).otherwise(total + s[bonus]))


def running_levels(levels: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, name: str) -> DataFrame:
    """How many rows up to each one, in order, have the flag."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumn(name, F.sum(flag.cast("long")).over(window))


def highest_reached(left: DataFrame, steps: DataFrame, by: Sequence[str], amount: str, need: str, level: str) -> DataFrame:
    """Each left row's highest step whose ``need`` is not above ``amount``: the largest need reached, per key."""
    number = lambda c: F.col(c).cast("double")
    return latest_mark(left, steps, by, number(amount), number(need), [F.col(level)], [level])


def investment_bonus(left: DataFrame, curve: DataFrame, by: Sequence[str], spent: str, name: str = "investment_bonus") -> DataFrame:
    """The bonus of the last step of a shop category's curve that ``spent`` reaches; 0 before the first, and without a curve.

    ``curve``: by, souls, bonus, position; steps of one price count by their place in the curve.
    """
    number = lambda c: F.col(c).cast("double")
    steps = curve.select(*by, "souls", "position", F.col("bonus").alias(name))
    out = latest_mark(left, steps, by, number(spent), number("souls"), [F.col("position")], [name])
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))


#: Kinds of upgrades to a value and to a scale, and the stat that scales where none is named.
TO_VALUE, TO_SCALE, SPIRIT = {"add_to_base": "add", "multiply_base": "multiply"}, {"add_to_scale": "add", "multiply_scale": "multiply"}, "tech_power"


def values_at_tiers(properties: DataFrame, upgrades: DataFrame, keys: Sequence[str], tiers: Sequence[int], order: Sequence[str] = ()) -> DataFrame:
    """Each property's ``value`` and ``scales`` (stat to scale) with the upgrades of the first ``tier`` tiers applied in order.

    ``properties``: keys, property, value, scale_stat, scale; ``upgrades``: keys, tier, property, bonus, type, stat, and
    ``order`` within a tier.  An upgrade of no type adds to the value.  One of a scale counts for its own stat, or else
    for the property's, or else for spirit power; a stat that the property lacks begins at 0.  Scales of 0 are left out.
    A property that only upgrades name has the value 0.  An ability has few upgrades, which bounds what is put in a row.
    """
    step = F.struct("tier", *order, F.coalesce("type", F.lit("add_to_base")).alias("type"), F.col("bonus").cast("double").alias("bonus"), F.col("stat").alias("stat"))
    steps = upgrades.groupBy(*keys, "property").agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    base = properties.select(*keys, "property", F.col("value").alias("_value"), F.col("scale_stat").alias("_stat"), F.col("scale").alias("_scale"))
    rows = base.join(steps, [*keys, "property"], "full").withColumn("tier", F.explode(F.array(*map(F.lit, tiers))))
    named = lambda kinds: lambda s: F.struct(F.when(s["type"].isin(*(k for k, v in kinds.items() if v == "multiply")), "multiply").otherwise("add").alias("kind"), s["bonus"].alias("bonus"))
    upto = F.filter(F.coalesce("_steps", F.array().cast(steps.schema["_steps"].dataType)), lambda s: s["tier"] <= F.col("tier"))
    value_steps = F.transform(F.filter(upto, lambda s: s["type"].isin(*TO_VALUE)), named(TO_VALUE))
    own = lambda s: F.coalesce(s["stat"], F.col("_stat"), F.lit(SPIRIT))
    scale_steps = F.filter(upto, lambda s: s["type"].isin(*TO_SCALE))
    stats = F.array_distinct(F.concat(F.array_compact(F.array("_stat")), F.transform(scale_steps, own)))
    begins = lambda stat: F.when(stat == F.col("_stat"), F.coalesce("_scale", F.lit(0.0))).otherwise(0.0)
    scaled = F.transform(stats, lambda stat: F.struct(stat.alias("stat"), folded(begins(stat), F.transform(F.filter(scale_steps, lambda s: own(s) == stat), named(TO_SCALE)), "kind", "bonus").alias("scale")))
    scales = F.map_filter(F.map_from_entries(scaled), lambda _, scale: scale != 0)
    return rows.select(*keys, "property", "tier", folded(F.coalesce("_value", F.lit(0.0)), value_steps, "kind", "bonus").alias("value"), scales.alias("scales"))


def scale_rows(values: DataFrame) -> DataFrame:
    """One row per scale of ``values_at_tiers``: ``stat`` and ``scale``, in the form that ``resolved_values`` takes."""
    return values.select(*(c for c in values.columns if c not in ("scales", "value")), F.explode("scales").alias("stat", "scale"))
