"""Queries of the breakdown, timeline and standing operators on the standard tables, with DuckDB SQL that gives the same rows.

A day of ``events`` is a match, its users are the players, their event types the sources; an order is a build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import breakdown, standing, timeline
from tallyforge.plans import registry, views  # noqa: F401  views registers its builders
from tallyforge.plans.metrics import Context, summarize
from tallyforge.queries import _BUILDS, _CLOSURE, SECONDS, builds, closure_of, query, read, rounded
from tallyforge.sources.matches import movement_intervals

KEYS = ["match_id", "account_id"]
WIDTH = 7200
SAMPLES = (
    "e AS (SELECT event_id, user_id AS account_id, event_type AS source, floor(value)::BIGINT AS v, (epoch_us(ts) - 1704067200000000) // 86400000000 AS match_id, ((epoch_us(ts) - 1704067200000000) // 1000000) % 86400 AS t FROM events), "
    "s AS (SELECT *, (sum(v) OVER (PARTITION BY match_id, account_id, source ORDER BY t, event_id))::BIGINT AS total FROM e), "
    "g AS (SELECT match_id, account_id, max(t) + 1000 AS duration_s FROM e GROUP BY 1, 2), f AS (SELECT match_id, account_id, source, max(total) AS total FROM s GROUP BY 1, 2, 3 HAVING max(total) <> 0)"
)
GRID = f"grid AS (SELECT match_id, account_id, duration_s, unnest(range(0, greatest((duration_s - 1) // {WIDTH}, 0) + 1)) AS interval FROM g)"
AT = f"least(greatest((t - 1) // {WIDTH}, 0), greatest((duration_s - 1) // {WIDTH}, 0))"


def samples(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Running totals per player and source, and the games with their lengths."""
    t = F.expr(SECONDS)
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("account_id"), F.col("event_type").alias("source"), F.floor("value").cast("long").alias("v"), F.floor(t / 86400).cast("long").alias("match_id"), (F.floor(t) % 86400).cast("long").alias("t"))
    window = Window.partitionBy(*KEYS, "source").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("total", F.sum("v").over(window)), e.groupBy(*KEYS).agg((F.max("t") + 1000).alias("duration_s"))


# Intervals

_SOURCE_GAINS = (
    f"{SAMPLES}, {GRID}, k AS (SELECT DISTINCT match_id, account_id, source FROM s), b AS (SELECT match_id, account_id, source, {AT} AS interval, max(total) AS total FROM s JOIN g USING (match_id, account_id) GROUP BY 1, 2, 3, 4), "
    f"c AS (SELECT match_id, account_id, source, interval, (interval + 1) * {WIDTH} <= duration_s AS whole, coalesce(max(total) OVER (PARTITION BY match_id, account_id, source ORDER BY interval), 0) AS total FROM grid JOIN k USING (match_id, account_id) LEFT JOIN b USING (match_id, account_id, source, interval)), "
    "d AS (SELECT match_id, account_id, source, interval, whole, (total - lag(total, 1, 0) OVER (PARTITION BY match_id, account_id, source ORDER BY interval))::BIGINT AS total FROM c)"
)


@query(f"WITH {_SOURCE_GAINS} SELECT * FROM d")
def source_intervals(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    return timeline.source_intervals(s, games, KEYS, ["source"], "t", "total", WIDTH).withColumnRenamed("full", "whole")


@query(f"WITH {_SOURCE_GAINS}, x AS (SELECT match_id, account_id, CASE WHEN source IN ('error', 'signup') THEN 'rare' ELSE source END AS shown, interval, sum(total)::BIGINT AS gained FROM d GROUP BY 1, 2, 3, 4), y AS (SELECT *, (sum(gained) OVER (PARTITION BY match_id, account_id, shown))::BIGINT AS total FROM x) SELECT * FROM y WHERE total <> 0")
def damage_intervals(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    shown = F.when(F.col("source").isin("error", "signup"), "rare").otherwise(F.col("source"))
    return timeline.group_intervals(s.withColumnRenamed("total", "gained"), games, KEYS, ["source"], shown, "shown", "t", "gained", WIDTH)


@query(
    f"WITH {SAMPLES}, {GRID}, k AS (SELECT *, account_id % 5 AS enemy FROM e), c AS (SELECT *, (sum(v) OVER (PARTITION BY match_id, enemy, source ORDER BY t, event_id))::BIGINT AS total FROM k), m AS (SELECT match_id, max(t) + 1000 AS duration_s FROM e GROUP BY 1), "
    f"gr AS (SELECT match_id, unnest(range(0, greatest((duration_s - 1) // {WIDTH}, 0) + 1)) AS interval FROM m), ks AS (SELECT DISTINCT match_id, enemy, source FROM c), b AS (SELECT match_id, enemy, source, {AT} AS interval, max(total) AS total FROM c JOIN m USING (match_id) GROUP BY 1, 2, 3, 4), "
    "f2 AS (SELECT match_id, enemy, source, interval, coalesce(max(total) OVER (PARTITION BY match_id, enemy, source ORDER BY interval), 0) AS total FROM gr JOIN ks USING (match_id) LEFT JOIN b USING (match_id, enemy, source, interval)), "
    "d AS (SELECT match_id, enemy, interval, total - lag(total, 1, 0) OVER (PARTITION BY match_id, enemy, source ORDER BY interval) AS gained FROM f2), x AS (SELECT match_id, enemy, interval, sum(gained)::BIGINT AS gained FROM d GROUP BY 1, 2, 3) "
    "SELECT * FROM (SELECT *, (sum(gained) OVER (PARTITION BY match_id, enemy))::BIGINT AS total FROM x) WHERE total <> 0"
)
def enemy_damage_intervals(spark, sf_dir):
    s, _ = samples(spark, sf_dir)
    s = s.withColumn("enemy", F.col("account_id") % 5)
    window = Window.partitionBy("match_id", "enemy", "source").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("gained", F.sum("v").over(window))
    games = s.groupBy("match_id").agg((F.max("t") + 1000).alias("duration_s"))
    return timeline.group_intervals(s, games, ["match_id"], ["enemy", "source"], F.col("enemy"), "enemy", "t", "gained", WIDTH)


@query(
    f"WITH {SAMPLES}, {GRID}, w AS (SELECT match_id, account_id, t, (sum(v) FILTER (source = 'purchase') OVER o)::BIGINT AS worth, (sum(v) FILTER (source = 'click') OVER o)::BIGINT AS farm FROM e WINDOW o AS (PARTITION BY match_id, account_id ORDER BY t, event_id)), "
    f"b AS (SELECT match_id, account_id, {AT} AS interval, max(worth) AS worth, max(farm) AS farm FROM w JOIN g USING (match_id, account_id) GROUP BY 1, 2, 3), n AS (SELECT match_id, account_id, {AT} AS interval, count(*) FILTER (source = 'error') AS deaths, count(*) FILTER (source = 'signup') AS kills FROM e JOIN g USING (match_id, account_id) GROUP BY 1, 2, 3), "
    "c AS (SELECT match_id, account_id, interval, duration_s, coalesce(max(worth) OVER o, 0) AS worth, coalesce(max(farm) OVER o, 0) AS farm FROM grid LEFT JOIN b USING (match_id, account_id, interval) WINDOW o AS (PARTITION BY match_id, account_id ORDER BY interval)), "
    f"d AS (SELECT match_id, account_id, interval, least((interval + 1) * {WIDTH}, duration_s) AS end_s, worth - lag(worth, 1, 0) OVER o AS worth, farm - lag(farm, 1, 0) OVER o AS farm FROM c WINDOW o AS (PARTITION BY match_id, account_id ORDER BY interval)) "
    f"SELECT match_id, account_id, interval, end_s::BIGINT AS end_s, worth::BIGINT AS worth, farm::BIGINT AS farm, coalesce(deaths, 0)::BIGINT AS deaths, coalesce(kills, 0)::BIGINT AS kills, CASE WHEN end_s > interval * {WIDTH} THEN round(60.0 * worth / (end_s - interval * {WIDTH}), 4) END AS per_min FROM d LEFT JOIN n USING (match_id, account_id, interval)"
)
def match_intervals(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    window = Window.partitionBy(*KEYS).orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda kind: F.sum(F.when(F.col("source") == kind, F.col("v"))).over(window)
    snapshots = e.select(*KEYS, "t", running("purchase").alias("worth"), running("click").alias("farm"))
    kinds = e.select(*KEYS, "t", F.when(F.col("source") == "error", "deaths").when(F.col("source") == "signup", "kills").alias("kind"))
    out = timeline.match_intervals(snapshots, kinds, games, KEYS, "t", ["worth", "farm"], ["deaths", "kills"], WIDTH)
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("deaths", "kills")}), "per_min")


@query(f"WITH {SAMPLES} SELECT match_id, account_id, source AS enemy, {AT} AS interval, count(*) AS n FROM e JOIN g USING (match_id, account_id) GROUP BY 1, 2, 3, 4")
def enemy_counts_by_interval(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    return timeline.enemy_interval_counts(e.withColumnRenamed("source", "enemy"), games, KEYS, "enemy", "t", WIDTH)


# Totals by source and per game


_SPLIT = ", ".join(f"coalesce(sum(total) FILTER (kind = '{k}'), 0)::BIGINT AS {k}" for k in ("gun", "item", "ability"))
_KIND = "CASE source WHEN 'click' THEN 'gun' WHEN 'purchase' THEN 'item' ELSE 'ability' END"


@query(
    f"WITH {SAMPLES}, x AS (SELECT match_id, account_id, coalesce(sum(total), 0)::BIGINT AS total, {_SPLIT} FROM g LEFT JOIN (SELECT *, {_KIND} AS kind FROM f) USING (match_id, account_id) GROUP BY 1, 2) "
    "SELECT *, " + ", ".join(f"CASE WHEN total <> 0 THEN round(100.0 * {k} / total, 4) END AS {k}_percent" for k in ("gun", "item", "ability")) + " FROM x"
)
def damage_game_records(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    out = breakdown.game_split(breakdown.final_values(s, KEYS, "source", "total"), games, KEYS, F.expr(_KIND), ["gun", "item", "ability"], "total")
    return rounded(out, "gun_percent", "item_percent", "ability_percent")


@query(
    "WITH h AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS healing, coalesce(sum(l_quantity) FILTER (l_suppkey % 3 = 0), 0)::BIGINT AS self_healing FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), p AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS prevented FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) "
    "SELECT l_orderkey, coalesce(healing, 0) AS healing, coalesce(self_healing, 0) AS self_healing, coalesce(prevented, 0) AS prevented FROM h FULL JOIN p USING (l_orderkey)"
)
def healing_game_records(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity"))
    out = breakdown.healing_split(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), ["l_orderkey"], F.col("l_suppkey") % 3 == 0, "q")
    return out.withColumns({c: F.col(c).cast("long") for c in ("healing", "self_healing", "prevented")})


@query(
    f"WITH {SAMPLES}, o AS (SELECT *, total // 10 AS orbs FROM f), m AS (SELECT source, match_id, max(duration_s) AS longest FROM o JOIN g USING (match_id, account_id) GROUP BY 1, 2), "
    "x AS (SELECT source, count(*) AS games, sum(total + orbs)::BIGINT AS souls, sum(orbs)::BIGINT AS secured_orbs, (SELECT sum(longest) FROM m WHERE m.source = o.source) / 60.0 AS minutes FROM o GROUP BY 1) "
    "SELECT source, games, souls, secured_orbs, round(minutes, 4) AS minutes, round(100.0 * souls / (SELECT sum(souls) FROM x), 4) AS percent, CASE WHEN souls <> 0 THEN round(100.0 * secured_orbs / souls, 4) END AS orb_share FROM x"
)
def souls_by_source(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    finals = breakdown.final_values(s, KEYS, "source", "total").withColumn("orbs", F.floor(F.col("total") / 10))
    return rounded(breakdown.souls_by_source(finals, games, KEYS, "source", "total", "orbs", ["match_id"]), "minutes", "percent", "orb_share")


@query(
    f"WITH {SAMPLES} SELECT account_id, coalesce(sum(v) FILTER (source = 'click'), 0)::BIGINT AS click, coalesce(sum(v) FILTER (source = 'purchase'), 0)::BIGINT AS purchase, coalesce(sum(v) FILTER (source = 'error'), 0)::BIGINT AS error, "
    "CASE WHEN coalesce(sum(v) FILTER (source = 'click'), 0) <> 0 THEN round(100.0 * coalesce(sum(v) FILTER (source = 'purchase'), 0) / sum(v) FILTER (source = 'click'), 4) END AS hit_percent FROM e WHERE source IN ('click', 'purchase', 'error') GROUP BY 1"
)
def combat_hero_records(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    return rounded(breakdown.counter_totals(e, ["account_id"], "source", "v", ["click", "purchase", "error"], {"hit_percent": ("purchase", "click")}), "hit_percent")


@query(f"WITH {SAMPLES}, x AS (SELECT match_id, account_id, account_id % 4 AS stat_group, source, max(total) AS total FROM s GROUP BY 1, 2, 3, 4) SELECT stat_group, source, count(*) AS games, sum(total)::BIGINT AS total, round(avg(total), 4) AS mean FROM x GROUP BY 1, 2")
def custom_stat_totals(spark, sf_dir):
    s, _ = samples(spark, sf_dir)
    return rounded(breakdown.custom_totals(s.withColumn("stat_group", F.col("account_id") % 4), KEYS, "stat_group", "source", "total"), "mean")


@query(
    f"WITH {SAMPLES}, h AS (SELECT match_id, account_id AS by_id, account_id + 1 AS to_id, v FROM e WHERE source = 'click'), p AS (SELECT DISTINCT match_id, account_id FROM e), a AS (SELECT match_id, by_id AS account_id, sum(v)::BIGINT AS dealt FROM h GROUP BY 1, 2), b AS (SELECT match_id, to_id AS account_id, sum(v)::BIGINT AS taken FROM h GROUP BY 1, 2) "
    "SELECT match_id, account_id, coalesce(dealt, 0) AS dealt, coalesce(taken, 0) AS taken FROM p LEFT JOIN a USING (match_id, account_id) LEFT JOIN b USING (match_id, account_id)"
)
def melee_by_player(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    hits = e.where("source = 'click'").select("match_id", F.col("account_id").alias("by_id"), (F.col("account_id") + 1).alias("to_id"), "v")
    return breakdown.dealt_and_taken(hits, games.select(*KEYS), ["match_id"], "by_id", "to_id", "v")


# Items of a game

_ITEM_GAMES = (
    "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_suppkey % 4 AS tier, l_suppkey % 10 = 0 AS wanted FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS buy_n, row_number() OVER (PARTITION BY l_orderkey, tier ORDER BY l_linenumber, l_partkey, l_extendedprice) AS tier_buy_n FROM p), "
    "b AS (SELECT l_orderkey, min((l_linenumber, l_partkey, l_extendedprice)) AS k FROM n WHERE wanted GROUP BY 1), c AS (SELECT n.l_orderkey, n.l_linenumber AS bought_at, buy_n, tier_buy_n FROM n JOIN b ON n.l_orderkey = b.l_orderkey AND (n.l_linenumber, n.l_partkey, n.l_extendedprice) = b.k AND wanted), "
    "o AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS gained, count(*) * 300 AS owned_s FROM p WHERE wanted GROUP BY 1), "
    "x AS (SELECT o_orderkey AS l_orderkey, o_orderstatus = 'F' AS won, bought_at, buy_n, tier_buy_n, coalesce(gained, 0) AS gained, owned_s, bought_at IS NOT NULL AS built FROM orders LEFT JOIN c ON o_orderkey = c.l_orderkey LEFT JOIN o ON o_orderkey = o.l_orderkey)"
)


def _item_games(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("tier", F.col("l_suppkey") % 4)
    wanted = F.col("l_suppkey") % 10 == 0
    games = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("won"))
    gained = lines.where(wanted).groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("gained"), (F.count(F.lit(1)) * 300).alias("owned_s"))
    return breakdown.item_games(games, lines, gained, ["l_orderkey"], wanted, ["l_linenumber", "l_partkey", "l_extendedprice"])


@query(f"WITH {_ITEM_GAMES} SELECT DISTINCT l_orderkey, won, bought_at, buy_n, tier_buy_n, gained, owned_s, built FROM x")
def item_games(spark, sf_dir):
    return _item_games(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("buy_n", "tier_buy_n")}).select("l_orderkey", "won", "bought_at", "buy_n", "tier_buy_n", "gained", "owned_s", "built")


@query(f"WITH {_ITEM_GAMES}, y AS (SELECT DISTINCT * FROM x) SELECT built, count(*) AS games, sum(won::INT)::BIGINT AS wins, round(100.0 * sum(won::INT) / count(*), 4) AS win_percent, round(avg(gained), 4) AS mean_gained, CASE WHEN coalesce(sum(owned_s), 0) > 0 THEN round(60.0 * sum(gained) / sum(owned_s), 4) END AS per_min_owned FROM y GROUP BY 1")
def item_report(spark, sf_dir):
    return rounded(breakdown.built_summary(_item_games(spark, sf_dir), F.col("won")), "win_percent", "mean_gained", "per_min_owned")


@query(f"WITH {_BUILDS}, d AS (SELECT DISTINCT l_orderkey, item, won FROM x), n AS (SELECT count(DISTINCT l_orderkey) FILTER (won) AS w, count(DISTINCT l_orderkey) FILTER (NOT won) AS l FROM d), r AS (SELECT item, 100.0 * count(*) FILTER (won) / max(w) AS ws, 100.0 * count(*) FILTER (NOT won) / max(l) AS ls FROM d, n GROUP BY 1) SELECT item, round(ws, 4) AS win_share, round(ls, 4) AS loss_share FROM r WHERE ws >= 5")
def item_core(spark, sf_dir):
    return rounded(breakdown.item_core(builds(spark, sf_dir), ["l_orderkey"], "p_brand", F.col("o_orderstatus") == "F", 5), "win_share", "loss_share")


@query(f"WITH {_CLOSURE}, b AS (SELECT DISTINCT l_orderkey, l_partkey AS item FROM lineitem) SELECT c.l_orderkey, c.item AS component, arg_min(b.item, (depth, b.item)) AS item FROM b c JOIN cl ON cl.component = c.item JOIN b ON b.l_orderkey = c.l_orderkey AND b.item = cl.item GROUP BY 1, 2")
def consumed_into(spark, sf_dir):
    buys = read(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(1).alias("at"), F.col("l_partkey").alias("item")).distinct()
    return breakdown.consumed_into(buys.withColumnRenamed("item", "component"), buys, closure_of(spark, sf_dir), ["l_orderkey"], "at").select("l_orderkey", "component", "item")


@query(
    "WITH f AS (SELECT l_orderkey, arg_min(l_suppkey % 6, (l_linenumber, l_partkey, l_extendedprice)) AS first_item FROM lineitem WHERE l_quantity > 30 GROUP BY 1) SELECT first_item, count(*) AS games, round(100.0 * avg((o_orderstatus = 'F')::INT), 4) AS win_percent FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY 1"
)
def first_item_split(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 30").withColumn("first_item", F.col("l_suppkey") % 6)
    games = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return rounded(breakdown.first_choice_split(lines, games, ["l_orderkey"], "first_item", ["l_linenumber", "l_partkey", "l_extendedprice"], F.col("o_orderstatus") == "F"), "win_percent")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS picks, count(*) FILTER (o_orderpriority = '1-URGENT') AS hero_picks, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS hero_wins, round(100.0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 4) AS pick_percent, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN round(100.0 * count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') / count(*) FILTER (o_orderpriority = '1-URGENT'), 4) END AS win_percent FROM orders GROUP BY 1")
def bucket_meta(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    out = breakdown.bucket_rates(rows, "month", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("hero_picks", "hero_wins")}), "pick_percent", "win_percent")


# Movement

_STATES = ["stationary_s", "slide_s", "in_air_s", "zipline_s", "combat_s"]
_MOVES = (
    "m AS (SELECT user_id % 3 AS match_id, user_id AS account_id, (epoch_us(ts) - 1704067200000000) // 60000000 AS t, min(event_id) AS k, arg_min(value, event_id) AS x, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1, 2, 3), "
    "a AS (SELECT *, CASE kind WHEN 'click' THEN 'ground_dash' WHEN 'purchase' THEN 'slide' WHEN 'view' THEN 'ziplining' ELSE 'in_air' END AS mv, CASE WHEN k % 3 = 0 THEN 'player' ELSE 'creep' END AS cb FROM m WHERE k % 10 > 0), "
    "w AS (SELECT *, lag(t) OVER o AS pt, lag(mv) OVER o AS pm, abs(x - lag(x) OVER o) AS st FROM a WINDOW o AS (PARTITION BY match_id, account_id ORDER BY t)), "
    "z AS (SELECT *, CASE WHEN t - pt = 1 AND mv <> 'ziplining' AND pm <> 'ziplining' AND st < 2500 THEN st END AS step FROM w), "
    "mi AS (SELECT match_id, account_id, t // 60 * 60 AS start_s, count(*) AS alive_s, count(step) AS moving_s, count(*) FILTER (step < 40) AS stationary_s, count(*) FILTER (mv = 'slide') AS slide_s, count(*) FILTER (mv = 'in_air') AS in_air_s, count(*) FILTER (mv = 'ziplining') AS zipline_s, count(*) FILTER (cb = 'player') AS combat_s, "
    "count(*) FILTER (mv = 'ground_dash' AND pm <> 'ground_dash') AS dashes, 0::BIGINT AS air_dashes, coalesce(sum(step), 0) AS distance FROM z GROUP BY 1, 2, 3)"
)


def _minutes(spark, sf_dir) -> DataFrame:
    """Minutes of events as seconds of a path along one axis; a tenth of them are spent dead."""
    t = F.floor(F.expr(SECONDS) / 60).cast("long")
    e = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("match_id"), F.col("user_id").alias("account_id"), t.alias("game_time_s")).agg(F.min("event_id").alias("k"), F.min_by(F.struct("value", "event_type"), "event_id").alias("e"))
    kind = F.col("e.event_type")
    moved = F.when(kind == "click", "ground_dash").when(kind == "purchase", "slide").when(kind == "view", "ziplining").otherwise("in_air")
    path = e.select("match_id", F.lit(None).cast("timestamp").alias("start_time"), "account_id", F.lit(1).alias("hero_id"), "game_time_s", F.col("e.value").alias("x"), F.lit(0.0).alias("y"), (F.col("k") % 10).alias("health_percent"), F.when(F.col("k") % 3 == 0, "player").otherwise("creep").alias("combat_type"), moved.alias("move_type"))
    return movement_intervals(path).drop("start_time", "hero_id")


@query(f"WITH {_MOVES} SELECT * REPLACE (round(distance, 4) AS distance) FROM mi")
def movement_minutes(spark, sf_dir):
    return rounded(_minutes(spark, sf_dir), "distance")


_OF = {s: "moving_s" if s == "stationary_s" else "alive_s" for s in _STATES}
_PERCENTS = ", ".join(f"CASE WHEN {of} > 0 THEN round(100.0 * {s} / {of}, 4) END AS {s[:-2]}_percent" for s, of in _OF.items())
_SUMS = ", ".join(f"coalesce(sum({s}), 0)::BIGINT AS {s}" for s in ["alive_s", "moving_s", *_STATES])


@query(
    f"WITH {_MOVES}, g AS (SELECT match_id, account_id, max(start_s) - 7000 AS duration_s, max(start_s) // 3600 AS moved FROM mi GROUP BY 1, 2), gr AS (SELECT match_id, account_id, duration_s, unnest(range(0, greatest((duration_s - 1) // 3600, moved, 0) + 1)) AS interval FROM g), "
    f"s AS (SELECT match_id, account_id, interval, (interval * 3600)::BIGINT AS start_s, least((interval + 1) * 3600, any_value(duration_s))::BIGINT AS end_s, {_SUMS}, coalesce(sum(distance), 0) AS distance FROM gr LEFT JOIN (SELECT *, start_s // 3600 AS interval FROM mi) m USING (match_id, account_id, interval) GROUP BY 1, 2, 3) "
    f"SELECT * REPLACE (round(distance, 4) AS distance), {_PERCENTS}, CASE WHEN moving_s > 0 THEN round(60.0 * distance / moving_s, 4) END AS pace FROM s"
)
def movement_buckets(spark, sf_dir):
    minutes = _minutes(spark, sf_dir)
    games = minutes.groupBy(*KEYS).agg((F.max("start_s") - 7000).alias("duration_s"))
    out = timeline.movement_buckets(minutes, games, KEYS, 3600, _STATES)
    return rounded(out, "distance", "pace", *(f"{s[:-2]}_percent" for s in _STATES))


@query(f"WITH {_MOVES}, s AS (SELECT match_id, account_id, {_SUMS}, sum(distance) AS distance, sum(dashes)::BIGINT AS dashes FROM mi GROUP BY 1, 2) SELECT * REPLACE (round(distance, 4) AS distance), {_PERCENTS}, CASE WHEN moving_s > 0 THEN round(60.0 * distance / moving_s, 4) END AS pace, round(60.0 * dashes / alive_s, 4) AS dashes_per_min FROM s")
def movement_scoreboard(spark, sf_dir):
    out = timeline.movement_totals(_minutes(spark, sf_dir), KEYS, _STATES, ["dashes"])
    return rounded(out, "distance", "pace", "dashes_per_min", *(f"{s[:-2]}_percent" for s in _STATES))


# Deaths, objectives, buffs


@query(
    f"WITH {SAMPLES}, d AS (SELECT CASE WHEN t <= 28800 THEN 'early' WHEN t <= 57600 THEN 'mid' ELSE 'late' END AS phase, v, account_id % 2 = 0 AS solo FROM e WHERE source = 'error') "
    "SELECT phase, count(*) AS deaths, round(count(*) / 150.0, 4) AS per_game, median(v) AS median_v, round(100.0 * avg(solo::INT), 4) AS solo_percent FROM d GROUP BY 1"
)
def death_phases(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    died = e.where("source = 'error'").withColumn("solo", F.col("account_id") % 2 == 0)
    return rounded(timeline.phases(died, "t", [28800, 57600], ["early", "mid", "late"], 150, "v", ["solo"]), "per_game", "solo_percent")


@query(
    f"WITH {SAMPLES}, m AS (SELECT match_id, max(account_id) % 2 AS mine FROM e GROUP BY 1), p AS (SELECT match_id, t AS at_s, account_id % 2 AS team, CASE source WHEN 'signup' THEN 'boss' ELSE 'tower' END AS kind FROM e WHERE source IN ('signup', 'error')) "
    "SELECT match_id, at_s, team, kind, CASE WHEN team = mine THEN 'mine' ELSE 'theirs' END AS side, row_number() OVER (PARTITION BY match_id ORDER BY at_s, kind, team) AS n FROM p JOIN m USING (match_id)"
)
def objective_timeline(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    e = e.withColumn("team", F.col("account_id") % 2)
    mine = e.groupBy("match_id").agg((F.max("account_id") % 2).alias("team"))
    out = timeline.objective_timeline([("tower", e.where("source = 'error'")), ("boss", e.where("source = 'signup'"))], "match_id", "t", "team", mine)
    return out.withColumn("n", F.col("n").cast("long")).withColumnRenamed("at", "at_s")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.02 THEN round(sqrt((l_quantity - l_tax) * (l_quantity - l_tax) + (l_extendedprice - l_suppkey) * (l_extendedprice - l_suppkey) + l_discount * l_discount) / 39.37, 4) END AS metres FROM lineitem")
def killer_distance(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    here = [F.when(F.col("l_discount") > 0.02, F.col("l_quantity")), F.col("l_extendedprice"), F.col("l_discount")]
    there = [F.col("l_tax"), F.col("l_suppkey"), F.lit(0.0)]
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(timeline.distance(here, there, 39.37), 4).alias("metres"))


@query(
    "WITH t AS (SELECT l_orderkey, count(*) * 3 AS taken FROM lineitem GROUP BY 1), j AS (SELECT l_orderkey, count(*) AS jackpots FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS bosses FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) "
    "SELECT l_orderkey, taken, coalesce(jackpots, 0) AS jackpots, coalesce(bosses, 0) AS bosses, coalesce(jackpots, 0) * 4 AS from_jackpots, coalesce(bosses, 0) * 2 AS from_bosses, greatest(taken - coalesce(jackpots, 0) * 4 - coalesce(bosses, 0) * 2, 0) AS collected FROM t LEFT JOIN j USING (l_orderkey) LEFT JOIN b USING (l_orderkey)"
)
def buff_sources(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    n = lambda df, name: df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias(name))
    taken = lines.groupBy("l_orderkey").agg((F.count(F.lit(1)) * 3).alias("taken"))
    return timeline.buff_sources(taken, n(lines.where("l_returnflag = 'R'"), "jackpots"), n(lines.where("l_returnflag = 'A'"), "bosses"), ["l_orderkey"])


# Ratings and records

_POINTS = "SELECT o_custkey, o_orderkey, o_orderdate, (o_custkey % 7 + 1) * 10 + o_orderkey % 6 + 1 AS badge, floor(o_totalprice / 1000)::BIGINT AS points, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 1000)::BIGINT - 100 END AS change, o_orderstatus = 'F' AS won FROM orders"


def _rated(spark, sf_dir) -> DataFrame:
    points = F.floor(F.col("o_totalprice") / 1000).cast("long")
    change = standing.points_change(F.lit(100), points, F.col("o_orderstatus") == "P")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", ((F.col("o_custkey") % 7 + 1) * 10 + F.col("o_orderkey") % 6 + 1).alias("badge"), points.alias("points"), change.alias("change"), (F.col("o_orderstatus") == "F").alias("won"))


@query(
    f"WITH r AS ({_POINTS}), x AS (SELECT o_custkey, arg_max(badge, (o_orderdate, o_orderkey)) AS badge, arg_max(points, (o_orderdate, o_orderkey)) AS points, sum(won::INT)::BIGINT AS wins, sum((NOT won)::INT)::BIGINT AS losses, coalesce(sum(change), 0)::BIGINT AS net_points FROM r GROUP BY 1) "
    "SELECT o_custkey, badge, points, CASE WHEN badge < 80 THEN points - (badge // 10 - 1) * 7000 - (badge % 10 - 1) * 1000 END AS into_subrank, CASE WHEN badge % 10 = 6 THEN 2000 ELSE 1000 END AS subrank_points, wins, losses, net_points, wins + losses AS placed_games FROM x"
)
def season_standing(spark, sf_dir):
    return standing.season_standing(_rated(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], "badge", "points", F.col("change"), F.col("won"))


@query("WITH h AS (SELECT o_custkey, o_orderpriority, sum((o_orderstatus = 'F')::INT)::BIGINT AS wins FROM orders GROUP BY 1, 2) SELECT o_custkey, count(*) FILTER (wins >= 2) AS heroes, sum(wins)::BIGINT AS wins FROM h GROUP BY 1")
def hero_eligibility(spark, sf_dir):
    out = standing.eligibility(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderstatus") == "F", 2)
    return out.withColumn("heroes", F.col("heroes").cast("long"))


@query("SELECT o_custkey, count(*) AS games, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1")
def archive_coverage(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return standing.coverage(rows, ["o_custkey"], "day")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) FILTER (o_orderstatus <> 'F') AS losses, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 9 > 0) AS wins_without, count(*) FILTER (o_orderstatus <> 'F' AND o_custkey % 9 > 0) AS losses_without FROM orders GROUP BY 1")
def record_by_mode(spark, sf_dir):
    return standing.record_without(read(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_custkey") % 9 == 0)


# Registered views over facts made of events: a user's day is a game

_FACTS = (
    f"{SAMPLES}, m AS (SELECT match_id, max(t) + 1000 AS duration_s, match_id % 3 AS match_mode, match_id % 5 = 0 AS not_scored, match_id % 2 AS winning_team FROM e GROUP BY 1), "
    "p AS (SELECT match_id, account_id, account_id % 7 AS hero_id, account_id % 2 = match_id % 2 AS won, count(*) FILTER (source = 'signup') AS kills, count(*) FILTER (source = 'error') AS deaths, count(*) FILTER (source = 'view') AS assists, sum(v)::BIGINT AS net_worth FROM e GROUP BY 1, 2), "
    "st AS (SELECT match_id, account_id, t, max(run)::BIGINT AS net_worth FROM (SELECT match_id, account_id, t, sum(v) OVER (PARTITION BY match_id, account_id ORDER BY t, event_id) AS run FROM e) GROUP BY 1, 2, 3)"
)


def facts(spark, sf_dir):
    """A context's tables: ``matches``, ``players``, ``stats``, ``soul_sources`` and ``movement_intervals``."""
    e, _ = samples(spark, sf_dir)
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("match_id") * 86400).alias("start_time")
    hero = (F.col("account_id") % 7).alias("hero_id")

    def table(name: str) -> DataFrame:
        if name == "matches":
            rows = e.groupBy("match_id").agg((F.max("t") + 1000).alias("duration_s"))
            return rows.select("match_id", start, "duration_s", (F.col("match_id") % 3).alias("match_mode"), F.lit(1).alias("game_mode"), (F.col("match_id") % 5 == 0).alias("not_scored"), (F.col("match_id") % 2).alias("winning_team"))
        if name == "players":
            n = lambda kind: F.count(F.when(F.col("source") == kind, 1))
            rows = e.groupBy(*KEYS).agg(n("signup").alias("kills"), n("error").alias("deaths"), n("view").alias("assists"), F.sum("v").alias("net_worth"))
            more = {"won": F.col("account_id") % 2 == F.col("match_id") % 2, "team": F.col("account_id") % 2, "last_hits": F.lit(0), "denies": F.lit(0), "assigned_lane": F.lit(1)}
            return rows.select("*", start, hero).withColumns(more)
        if name == "stats":
            window = Window.partitionBy(*KEYS).orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
            return e.withColumn("run", F.sum("v").over(window)).groupBy(*KEYS, F.col("t").alias("time_stamp_s")).agg(F.max("run").alias("net_worth")).select("*", start, hero)
        if name == "soul_sources":
            return e.select(*KEYS, start, hero, "source", F.col("total").alias("souls"), F.floor(F.col("total") / 10).alias("souls_orbs"))
        if name == "movement_intervals":
            return _minutes(spark, sf_dir).select("*", F.lit(None).cast("timestamp").alias("start_time"), F.lit(1).alias("hero_id"))
        raise KeyError(name)

    return Context(spark, table)


@query(
    f"WITH {_FACTS} SELECT hero_id AS hero, count(*) AS games, count(*) FILTER (NOT not_scored) AS scored_games, count(*) FILTER (won AND NOT not_scored) AS wins, CASE WHEN count(*) FILTER (NOT not_scored) > 0 THEN round(100.0 * count(*) FILTER (won AND NOT not_scored) / count(*) FILTER (NOT not_scored), 4) END AS win_rate, "
    "sum(kills)::BIGINT AS kills, round((sum(kills) + sum(assists)) / greatest(sum(deaths), 1)::DOUBLE, 4) AS kda, round(sum(net_worth) / count(*)::DOUBLE, 4) AS net_worth_per_game FROM p JOIN m USING (match_id) WHERE match_mode = 1 GROUP BY 1"
)
def view_my_games(spark, sf_dir):
    out = summarize(facts(spark, sf_dir), registry.build("my_games", match_mode=1), "hero", ["games", "scored_games", "wins", "win_rate", "kills", "kda", "net_worth_per_game"])
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("scored_games", "wins")}), "win_rate", "kda", "net_worth_per_game")


@query(f"WITH {_FACTS}, l AS (SELECT match_id, account_id, arg_max(net_worth, t) AS w FROM st GROUP BY 1, 2) SELECT won, count(*) AS games, sum(w)::BIGINT AS net_worth FROM l JOIN p USING (match_id, account_id) GROUP BY 1")
def view_stat_snapshots(spark, sf_dir):
    return summarize(facts(spark, sf_dir), registry.build("stat_snapshots"), "won", ["games", "net_worth"])


@query(
    f"WITH {_FACTS}, x AS (SELECT match_id, account_id, source, max(total) AS s, max(total // 10) AS o FROM s GROUP BY 1, 2, 3 HAVING max(total) + max(total // 10) <> 0) "
    "SELECT source, count(DISTINCT match_id) AS games, sum(s + o)::BIGINT AS souls, sum(o)::BIGINT AS secured_orbs, round(100.0 * sum(o) / sum(s + o), 4) AS orb_share FROM x GROUP BY 1"
)
def view_soul_sources(spark, sf_dir):
    return rounded(summarize(facts(spark, sf_dir), registry.build("soul_source_games"), "source", ["games", "souls", "secured_orbs", "orb_share"]), "orb_share")


@query(
    f"WITH {_FACTS}, gr AS (SELECT match_id, account_id, unnest(range(0, duration_s // 7200)) AS interval FROM p JOIN m USING (match_id)), b AS (SELECT match_id, account_id, greatest((t - 1) // 7200, 0) AS interval, arg_max(net_worth, t) AS w FROM st GROUP BY 1, 2, 3), "
    "c AS (SELECT match_id, account_id, interval, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY match_id, account_id ORDER BY interval), 0) AS w FROM gr LEFT JOIN b USING (match_id, account_id, interval)), d AS (SELECT *, w - lag(w, 1, 0) OVER (PARTITION BY match_id, account_id ORDER BY interval) AS gain FROM c) "
    "SELECT interval, count(*) AS games, sum(gain)::BIGINT AS total_gain, round(avg(gain), 4) AS mean_gain, median(gain) AS median_gain FROM d GROUP BY 1"
)
def view_compare_intervals(spark, sf_dir):
    return rounded(summarize(facts(spark, sf_dir), registry.build("compare_intervals", width=7200), "interval", ["games", "total_gain", "mean_gain", "median_gain"]), "mean_gain")


@query(
    f"WITH {_FACTS}, k AS (SELECT match_id, account_id, unnest([21600, 43200, 64800])::BIGINT AS mark_s, duration_s FROM p JOIN m USING (match_id)), x AS (SELECT match_id, account_id, mark_s, arg_max(net_worth, t) AS w FROM k JOIN st USING (match_id, account_id) WHERE t <= mark_s GROUP BY 1, 2, 3) "
    "SELECT mark_s, count(*) AS games, round(avg(coalesce(w, 0)), 4) AS mean, median(coalesce(w, 0)) AS median FROM k LEFT JOIN x USING (match_id, account_id, mark_s) WHERE duration_s >= mark_s GROUP BY 1"
)
def view_cumulative_marks(spark, sf_dir):
    return rounded(summarize(facts(spark, sf_dir), registry.build("cumulative_marks", marks=(21600, 43200, 64800)), "mark_s", ["games", "mean", "median"]), "mean")


@query(
    f"WITH {_FACTS}, w AS (SELECT match_id, account_id, t AS t1, net_worth AS v1, lag(t, 1, 0) OVER o AS t0, lag(net_worth, 1, 0) OVER o AS v0 FROM st WINDOW o AS (PARTITION BY match_id, account_id ORDER BY t)), "
    "x AS (SELECT match_id, account_id, target, min(t0 + (t1 - t0) * (target - v0) / (v1 - v0)) / 60.0 AS minutes FROM w, (SELECT unnest([50.0, 100.0, 200.0])::DOUBLE AS target) WHERE v0 < target AND target <= v1 GROUP BY 1, 2, 3) SELECT target, count(*) AS games, round(median(minutes), 4) AS minutes FROM x GROUP BY 1"
)
def view_milestone_games(spark, sf_dir):
    return rounded(summarize(facts(spark, sf_dir), registry.build("milestone_games", targets=(50, 100, 200)), "target", ["games", "minutes"]), "minutes")


@query(f"WITH {_MOVES}, s AS (SELECT match_id, account_id, {_SUMS}, sum(distance) AS distance FROM mi GROUP BY 1, 2) SELECT match_id AS match, count(*) AS games, round(avg(100.0 * combat_s / alive_s), 4) AS mean_combat_percent, round(avg(60.0 * distance / nullif(moving_s, 0)), 4) AS mean_pace FROM s GROUP BY 1")
def view_movement_games(spark, sf_dir):
    return rounded(summarize(facts(spark, sf_dir), registry.build("movement_games"), "match", ["games", "mean_combat_percent", "mean_pace"]), "mean_combat_percent", "mean_pace")
