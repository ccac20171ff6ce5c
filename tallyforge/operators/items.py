"""Items: component closure and credit, ownership windows, buy order, frequencies, rankings and synergies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.frames import dealt
from tallyforge.operators.eras import asof_join, listed_eras, live_of


def component_closure(edges: DataFrame, parent: str, child: str, depth: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """All components of each item up to a depth, with the smallest depth: ``depth`` - 1 joins of the edge list.

    The joins are merges, as an edge list may be small on disk and yet too large to be sent to every task.
    """
    edges = edges.select(*by, F.col(parent).alias("item"), F.col(child).alias("component")).distinct()
    level, found = edges.withColumn("depth", F.lit(1)), None
    step = edges.select(*by, F.col("item").alias("component"), F.col("component").alias("deeper"))
    for d in range(1, depth + 1):
        found = level if found is None else found.unionByName(level)
        if d < depth:
            level = level.join(step.hint("merge"), [*by, "component"]).select(*by, "item", F.col("deeper").alias("component"), F.lit(d + 1).alias("depth"))
    return found.groupBy(*by, "item", "component").agg(F.min("depth").alias("depth"))


def effective_cost(buys: DataFrame, consumed: DataFrame, closure: DataFrame, keys: Sequence[str], at: str, time: str | None = None, start: str = "era_from") -> DataFrame:
    """Each buy's cost less the prices of components consumed at the same moment.

    A component that several buys of that moment could use goes to the closest relative, then to the lowest item; all its
    rows of that moment count.  ``buys``: keys, ``at``, ``item``, ``cost``; ``consumed``: keys, ``at``, ``component``,
    ``price``.  With ``time`` the closure is that of the recipes live then: ``closure`` has ``start``, and buys have ``time``.

    A buy meets its item's components, which are few, in one row.  Buys and what was consumed are then dealt by key once;
    the components are laid out where they are needed, so none of them is shuffled.
    """
    on = [*keys, at]
    depth = closure.schema["depth"].dataType
    part = lambda component, depth: F.struct(component.alias("component"), depth.alias("depth"))
    made_of = closure.where("item IS NOT NULL AND component IS NOT NULL").groupBy("item", *([start] if time else [])).agg(F.collect_set(F.struct("component", "depth")).alias("_parts"))
    bought = buys.select(*on, "item", F.struct(*(c for c in buys.columns if c not in (*on, "item"))).alias("_buy"))
    if time:
        offered = bought.join(listed_eras(made_of, ["item"], start, "_parts"), "item", "left").withColumn("_parts", live_of("_eras", F.col("_buy")[time]))
    else:
        offered = bought.join(made_of, "item", "left")
    no_part = F.lit(None).cast(closure.schema["component"].dataType)
    # a buy stands first among its own offers, without a component; what was consumed has no item
    offers = F.concat(F.array(part(no_part, F.lit(None).cast(depth))), F.coalesce("_parts", F.array().cast(made_of.schema["_parts"].dataType)))
    used = consumed.select(*on, "price", F.array(part(F.col("component"), F.lit(None).cast(depth))).alias("_parts"))
    rows = dealt(offered.select(*on, "item", "_buy", offers.alias("_parts")).unionByName(used, allowMissingColumns=True), *keys).select(*on, "item", "_buy", "price", F.inline("_parts"))
    itself, known = F.col("component").isNull(), F.col("component").isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    rows = rows.where(known | itself & F.col("_buy").isNotNull()).withColumn("_buy", F.when(itself, F.col("_buy")))
    taking = Window.partitionBy(*on, "component").orderBy(F.col("item").isNull(), "depth", "item")
    taken = F.sum("price").over(taking.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    takers = rows.withColumns({"_n": F.row_number().over(taking), "_taken": taken}).where(itself | (F.col("_n") == 1) & F.col("item").isNotNull())
    credit = F.coalesce(F.sum("_taken").over(Window.partitionBy(*on, "item")), F.lit(0))
    out = takers.withColumn("credit", credit).where(itself).select(*on, "item", "_buy.*", "credit")
    return out.withColumn("effective_cost", F.col("cost") - F.col("credit"))


def priced(events: DataFrame, item_eras: DataFrame, at: str = "start_time", item: str = "item_id", values: Sequence[str] = ("cost", "slot", "tier")) -> DataFrame:
    """Events with the prices, slots and tiers of the era live at their match's start, in place of those they came with."""
    return asof_join(events.drop(*values), item_eras.select(item, "era_from", *values), [item], at, values)


def ownership_windows(buys: DataFrame, sold: str, end: str) -> DataFrame:
    """``owned_to`` is the sale, or the end where the item was kept (``sold`` 0 or null)."""
    kept = F.coalesce(F.col(sold), F.lit(0)) == 0
    return buys.withColumn("kept", kept).withColumn("owned_to", F.when(kept, F.col(end)).otherwise(F.col(sold)))


def gained_while_owned(windows: DataFrame, samples: DataFrame, keys: Sequence[str], at: str, value: str, window_keys: Sequence[str]) -> DataFrame:
    """A running total's gain within ownership windows: its largest value up to the end less its largest up to the buy.

    Samples and the ends of windows are sorted together and the largest value so far is read off, so a game's windows
    don't each meet all its samples.
    """
    marks = windows.select(*keys, F.struct(*window_keys).alias("_window"), F.inline(F.array(
        F.struct(F.col("owned_from").cast("double").alias("_t"), F.lit(False).alias("_end")),
        F.struct(F.when(~F.col("kept"), F.col("owned_to").cast("double")).otherwise(F.lit(float("inf"))).alias("_t"), F.lit(True).alias("_end")),
    )))
    both = samples.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v")).where("_t IS NOT NULL").unionByName(marks.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    so_far = F.max("_v").over(Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    read = both.withColumn("_v", so_far).where("_side = 1")
    upto = lambda end: F.coalesce(F.max(F.when(F.col("_end") == end, F.col("_v"))), F.lit(0))
    return read.groupBy("_window").agg((upto(True) - upto(False)).alias(value)).select("_window.*", value)


def buy_order(buys: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "buy_n") -> DataFrame:
    return buys.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def upgrade_points(events: DataFrame, keys: Sequence[str], ability: str, order: Sequence[str], costs: Sequence[int]) -> DataFrame:
    """Which upgrade of its ability an event is, what that costs, and the points spent so far."""
    nth = F.row_number().over(Window.partitionBy(*keys, ability).orderBy(*order))
    out = events.withColumn("upgrade_n", nth)
    price = F.element_at(F.array(*map(F.lit, costs)), F.least(F.col("upgrade_n"), F.lit(len(costs))))
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cost", price).withColumn("points", F.sum("cost").over(window))


def item_frequency(builds: DataFrame, build: Sequence[str], item: str, at: str, sold: str | None = None, include_sold: bool = False, facts: Sequence[str] = ()) -> DataFrame:
    """In what part of the builds an item is, and its median time; the latest buy counts in each build.

    Buys that were ``sold`` again (a flag) count only if asked for, but their builds do.  ``facts``, as slot and tier, are
    those of the item's latest buy of all.
    """
    total = builds.select(*build).distinct().agg(F.count(F.lit(1)).alias("n_builds"))
    kept = builds if sold is None or include_sold else builds.where(~F.coalesce(F.col(sold), F.lit(False)))
    latest = kept.groupBy(*build, item).agg(F.max(at).alias(at), *([F.max_by(F.struct(*facts), F.struct(at, *facts)).alias("_facts")] if facts else []))
    newest = [F.max_by("_facts", F.struct(at, "_facts")).alias("_facts")] if facts else []
    out = latest.groupBy(item).agg(F.count(F.lit(1)).alias("builds"), F.median(at).alias("median_at"), *newest)
    out = out.crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col("builds") / F.col("n_builds")).drop("n_builds")  # one row
    return out.select("*", "_facts.*").drop("_facts") if facts else out


def win_rates(rows: DataFrame, keys: Sequence[str], won: Column, least: int = 0) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.sum(won.cast("long")).alias("wins")).where(F.col("matches") >= least).withColumn("win_percent", 100.0 * F.col("wins") / F.col("matches"))


def verdict(ranked: DataFrame, peers: str, value: str = "win_percent") -> DataFrame:
    """An item's edge over the mean of the other items of its group; alone in it, 0."""
    window = Window.partitionBy(peers)
    n, total = F.count(F.lit(1)).over(window), F.sum(value).over(window)
    return ranked.withColumn("peer_mean", F.when(n > 1, (total - F.col(value)) / (n - 1)).otherwise(F.col(value))).withColumn("edge", F.col(value) - F.col("peer_mean"))


def synergies(rows: DataFrame, build: Sequence[str], item: str, won: Column, least: int, top: int = 10) -> DataFrame:
    """For each ``item`` the ``top`` others in one build with it by the pair's win percent over the item's own.

    A build holds a bounded number of distinct items, which bounds its pairs.  They are laid out from one row per build,
    in which an item beside itself stands for the item alone.
    """
    mine = F.struct(F.col(item).alias("item"), won.alias("won"))
    sets = rows.groupBy(*build).agg(F.collect_set(mine).alias("_all"))
    each = sets.select(*build, "_all", F.explode("_all").alias("_a"))
    known = F.lit(True)
    for b in build:
        known = known & F.col(b).isNotNull()
    pairs = each.select(*build, "_a", F.explode("_all").alias("_b")).withColumn("_alone", F.col("_a").eqNullSafe(F.col("_b"))).where(F.col("_alone") | known & (F.col("_a.item") != F.col("_b.item")))
    rated = win_rates(pairs.select("_a.item", F.col("_b.item").alias("other"), "_a.won", "_alone"), ["item", "other", "_alone"], F.col("won"))
    solo = F.max(F.when(F.col("_alone"), F.col("win_percent"))).over(Window.partitionBy("item"))
    out = rated.withColumn("solo", solo).where(~F.col("_alone") & (F.col("matches") >= least)).drop("_alone").withColumn("lead", F.col("win_percent") - F.col("solo"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(F.round("lead", 9)), "other"))
    return out.withColumn("place", place).where(F.col("place") <= top)


def pick_rates(rows: DataFrame, key: str, won: Column, per_match: int = 12) -> DataFrame:
    """Win percent and pick percent, the latter of all picks times the picks in a match."""
    out = win_rates(rows, [key], won)
    total = out.agg(F.sum("matches").alias("all"))
    return out.crossJoin(F.broadcast(total)).withColumn("pick_percent", 100.0 * per_match * F.col("matches") / F.col("all")).drop("all")  # one row
