"""Queries of the level, report and history operators on the standard tables, with DuckDB SQL that gives the same rows.

As in the report queries a day of ``events`` is a match and its event types are sources; a nation is a hero, its
customers are levels and its suppliers stats; an order is a game.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import levels, reports
from tallyforge.queries import query, read, rounded
from tallyforge.report_queries import KEYS, SAMPLES, samples
from tallyforge.sources import histories

# Levels and tiers

_STATS = ["max_health", "light_melee_damage", "heavy_melee_damage"]
_GAINS = ["base_health_from_level", "tech_power", "base_bullet_damage_from_level", "base_melee_damage_from_level"]


@query(
    "WITH l AS (SELECT c_nationkey AS hero_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS level, c_acctbal > 0 AS up FROM customer), n AS (SELECT hero_id, level, (sum(up::INT) OVER (PARTITION BY hero_id ORDER BY level))::BIGINT AS standard_levels FROM l), "
    "b AS (SELECT s_nationkey AS hero_id, max(s_acctbal) FILTER (s_suppkey % 3 = 0) AS h, max(s_acctbal) FILTER (s_suppkey % 3 = 1) AS li, max(s_acctbal) FILTER (s_suppkey % 3 = 2) AS he, min(s_acctbal) FILTER (s_suppkey % 4 = 0) AS gh, min(s_acctbal) FILTER (s_suppkey % 4 = 1) AS gs, min(s_acctbal) FILTER (s_suppkey % 4 = 2) AS gb, min(s_acctbal) FILTER (s_suppkey % 4 = 3) AS gm FROM supplier GROUP BY 1), "
    "z AS (SELECT n.*, coalesce(h, 0) AS h, coalesce(li, 0) AS li, coalesce(he, 0) AS he, coalesce(gh, 0) AS gh, coalesce(gs, 0) AS gs, coalesce(gb, 0) AS gb, coalesce(gm, 0) AS gm FROM n LEFT JOIN b USING (hero_id)) "
    "SELECT hero_id, level, standard_levels, round(h + gh * standard_levels, 4) AS max_health, round(gs * standard_levels, 4) AS spirit_power, round(gb * standard_levels, 4) AS bullet_damage_bonus, round(li + gm * standard_levels, 4) AS light_melee_damage, round(he + CASE WHEN li <> 0 THEN gm * standard_levels * he / li ELSE 0 END, 4) AS heavy_melee_damage FROM z"
)
def boon_stats(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    level = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    steps = customers.select(F.col("c_nationkey").alias("hero_id"), level.alias("level"), (F.col("c_acctbal") > 0).alias("standard_upgrade"))
    suppliers = read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "hero_id")
    stat = lambda names: F.array(*map(F.lit, names))[(F.col("s_suppkey") % len(names)).cast("int")]
    stats = suppliers.groupBy("hero_id", stat(_STATS).alias("stat")).agg(F.max("s_acctbal").alias("value"))
    gains = suppliers.groupBy("hero_id", stat(_GAINS).alias("stat")).agg(F.min("s_acctbal").alias("per_level_value"))
    return rounded(levels.boon_stats(steps, stats, gains, ["hero_id"]), "max_health", "spirit_power", "bullet_damage_bonus", "light_melee_damage", "heavy_melee_damage")


@query("SELECT p_partkey, p_size, round(p_size + p_retailprice / 100, 4) AS bullet, round(p_retailprice * (p_size + p_retailprice / 100) / p_size, 4) AS dps FROM part WHERE p_size <> 0")
def gun_at_level(spark, sf_dir):
    guns = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_size").alias("bullet_damage"), F.col("p_retailprice").alias("damage_per_second"), (F.col("p_retailprice") / 100).alias("bonus"))
    return rounded(levels.gun_at_level(guns, "bonus").select("p_partkey", "p_size", "bullet", "dps"), "bullet", "dps")


@query(
    "WITH s AS (SELECT l_partkey, l_returnflag AS stat, max(l_discount) AS scale FROM lineitem GROUP BY 1, 2), c AS (SELECT l_returnflag AS stat, max(l_quantity)::DOUBLE AS amount FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), a AS (SELECT l_partkey, sum(scale * amount) AS added FROM s JOIN c USING (stat) GROUP BY 1) "
    "SELECT p_partkey AS l_partkey, round(p_retailprice + coalesce(added, 0), 4) AS resolved FROM part LEFT JOIN a ON p_partkey = l_partkey"
)
def resolved_values(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    scales = lines.groupBy("l_partkey", F.col("l_returnflag").alias("stat")).agg(F.max("l_discount").alias("scale"))
    context = lines.where("l_returnflag <> 'N'").groupBy(F.col("l_returnflag").alias("stat")).agg(F.max("l_quantity").cast("double").alias("amount"))
    values = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("value"))
    return rounded(levels.resolved_values(values, scales, context, ["l_partkey"]).select("l_partkey", "resolved"), "resolved")


_FOLD = "list_reduce(list_prepend([0.0, 100.0, 0.0], list_filter(steps, lambda s: s[1] {} t)), lambda a, x: CASE WHEN x[3] = 1 THEN [0, a[2] * (1 + x[2] / 100), 0] ELSE [0, a[2] + x[2], 0] END)[2]"


@query(
    "WITH g AS (SELECT l_orderkey, list([l_linenumber::DOUBLE, l_quantity::DOUBLE, (l_returnflag = 'R')::INT::DOUBLE] ORDER BY l_linenumber, (l_returnflag = 'R')::INT, l_quantity) AS steps FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, steps, unnest(list_distinct(list_transform(steps, lambda s: s[1]))) AS t FROM g) "
    f"SELECT l_orderkey, t::INT AS tier, round({_FOLD.format('<')}, 4) AS before, round({_FOLD.format('<=')}, 4) AS after FROM x"
)
def tier_changes(spark, sf_dir):
    reset = F.col("l_returnflag") == "R"
    step = F.struct(F.col("l_linenumber").alias("tier"), F.when(reset, "multiply").otherwise("add").alias("kind"), F.when(reset, 1 + F.col("l_quantity") / 100).otherwise(F.col("l_quantity")).alias("bonus"))
    upgrades = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps")).withColumn("base", F.lit(100.0))
    return rounded(levels.tier_changes(upgrades, ["l_orderkey"], "base", "steps"), "before", "after")


@query(
    "WITH r AS (SELECT DISTINCT o_orderkey % 8 AS tier, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 8 <> 5), v AS (SELECT tier, y, 'T' || tier || '-' || y AS name, lead(y) OVER w AS upto, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY tier ORDER BY y)), "
    "b AS (SELECT o_orderkey, year(o_orderdate) AS y, (o_custkey % 8) * 10 + o_custkey % 7 AS badge FROM orders) SELECT o_orderkey, badge, CASE WHEN name IS NULL THEN 'badge' || badge WHEN badge < 10 THEN name ELSE name || ' ' || CASE WHEN badge % 10 = 0 THEN '0' ELSE ['I', 'II', 'III', 'IV', 'V', 'VI'][badge % 10] END END AS rank "
    "FROM b LEFT JOIN v ON badge // 10 = tier AND (b.y >= v.y OR n = 1) AND (upto IS NULL OR b.y < upto)"
)
def rank_labels_asof(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    year = F.date_trunc("year", "at")
    eras = orders.where("o_orderkey % 8 <> 5").select((F.col("o_orderkey") % 8).alias("tier"), year.alias("era_from")).distinct()
    ranks = eras.withColumn("name", F.concat(F.lit("T"), F.col("tier").cast("string"), F.lit("-"), F.year("era_from").cast("string")))
    badges = orders.select("o_orderkey", "at", (F.col("o_custkey") % 8 * 10 + F.col("o_custkey") % 7).alias("badge"))
    return levels.with_rank_label(badges, ranks, "badge", "at").select("o_orderkey", "badge", "rank")


@query(
    "WITH h AS (SELECT user_id, props::JSON AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id FROM events), x AS (SELECT event_id, json_extract_string(p, '$.k') AS new, lag(json_extract_string(p, '$.k')) OVER (PARTITION BY user_id ORDER BY n) AS old, n FROM h) "
    "SELECT event_id, 'k' AS path, old, new FROM x WHERE n > 1 AND old IS DISTINCT FROM new"
)
def record_changes(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    history = rows.select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("from"), F.col("event_id").alias("build"), F.col("props").alias("record"))
    return histories.record_changes(history, depth=2).select(F.col("build").alias("event_id"), "path", "old", "new")


# Reports of games


@query(f"WITH {SAMPLES} SELECT s.match_id, s.account_id, source, arg_max(total, (t, event_id)) AS total, any_value(duration_s) AS duration_s FROM s JOIN g USING (match_id, account_id) WHERE source IN ('purchase', 'error') GROUP BY 1, 2, 3")
def custom_stats(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    return reports.custom_stats(s, games, KEYS, "source", "total", ["t", "event_id"], F.col("source").isin("purchase", "error"))


@query(f"WITH {SAMPLES} SELECT match_id, account_id + 1 AS target_id, account_id, sum(v)::BIGINT AS taken, any_value(duration_s) AS duration_s FROM e JOIN g USING (match_id, account_id) WHERE source = 'click' GROUP BY 1, 2, 3")
def melee_taken_by_attacker(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    hits = e.where("source = 'click'").select("match_id", "account_id", (F.col("account_id") + 1).alias("target_id"), "v")
    return reports.taken_by_attacker(hits, games, "match_id", "account_id", "target_id", "v")


@query(
    f"WITH {SAMPLES}, c AS (SELECT match_id, account_id, sum(v) FILTER (source = 'click') AS click, sum(v) FILTER (source = 'error') AS error, sum(v) FILTER (source = 'purchase') AS gun FROM e GROUP BY 1, 2) "
    "SELECT match_id, account_id, duration_s, coalesce(click, 0)::BIGINT AS click, coalesce(error, 0)::BIGINT AS error, coalesce(gun, 0)::BIGINT AS gun_damage FROM g LEFT JOIN c USING (match_id, account_id)"
)
def combat_rows(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    return reports.combat_rows(games, e, e.where("source = 'purchase'"), KEYS, "source", "v", ["click", "error"])


@query(f"WITH {SAMPLES}, x AS (SELECT account_id, source, t // 21600 AS span, sum(v)::BIGINT AS v FROM e GROUP BY 1, 2, 3) SELECT account_id, source, span, v, CASE WHEN sum(v) OVER (PARTITION BY account_id, source) <> 0 THEN round(100.0 * v / sum(v) OVER (PARTITION BY account_id, source), 4) END AS percent FROM x")
def range_shares(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    return rounded(reports.shares_of_group(e.withColumn("span", F.floor(F.col("t") / 21600)), ["account_id", "source"], "span", "v"), "percent")


@query(f"WITH {SAMPLES}, x AS (SELECT match_id, source AS ability, account_id % 4 AS stacks, sum(v)::BIGINT AS v FROM e WHERE source <> 'error' GROUP BY 1, 2, 3) SELECT match_id, ability, stacks, v, CASE WHEN sum(v) OVER (PARTITION BY match_id, ability) <> 0 THEN round(100.0 * v / sum(v) OVER (PARTITION BY match_id, ability), 4) END AS percent FROM x")
def stack_uptime(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    counted = F.concat("source", F.lit("TimeAt_"), (F.col("account_id") % 4).cast("string"), F.lit("_stacks"))
    return rounded(reports.stack_uptime(e.withColumn("stat", F.when(F.col("source") != "error", counted).otherwise("error")), ["match_id"], "stat", "v"), "percent")


@query(f"WITH {SAMPLES}, x AS (SELECT match_id, account_id, coalesce(sum(v) FILTER (source = 'click'), 0) AS a, coalesce(sum(v) FILTER (source = 'purchase'), 0) AS b FROM e WHERE source IN ('click', 'purchase') GROUP BY 1, 2) SELECT match_id, account_id, round(60.0 * a / duration_s, 4) AS click_held, round(60.0 * b / duration_s, 4) AS purchase_held FROM x JOIN g USING (match_id, account_id)")
def unspent_average(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    return rounded(reports.held_on_average(e, games, KEYS, "source", "v", ["click", "purchase"]), "click_held", "purchase_held")


@query(
    f"WITH {SAMPLES}, x AS (SELECT match_id, account_id, t // 7200 AS interval, sum(v)::BIGINT AS v FROM e GROUP BY 1, 2, 3), m AS (SELECT interval, median(v) FILTER (account_id % 2 = 0) AS mine, median(v) FILTER (account_id % 2 = 1) AS theirs, count(*) FILTER (account_id % 2 = 0) AS n_mine, count(*) FILTER (account_id % 2 = 1) AS n_theirs FROM x GROUP BY 1), "
    "k AS (SELECT *, bool_and(least(n_mine, n_theirs) >= 3 AND interval = rn - 1) OVER (ORDER BY interval) AS good FROM (SELECT *, row_number() OVER (ORDER BY interval) AS rn FROM m)) "
    "SELECT interval, mine, theirs, n_mine, n_theirs, mine - theirs AS gap, sum(mine - theirs) OVER (ORDER BY interval) AS running_gap, row_number() OVER (ORDER BY theirs - mine DESC, interval) = 1 AND theirs > mine AS worst FROM k WHERE good"
)
def pool_medians(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    gains = e.groupBy(*KEYS, F.floor(F.col("t") / 7200).alias("interval")).agg(F.sum("v").alias("v"))
    return reports.pool_medians(gains, F.col("account_id") % 2 == 0, "interval", "v")


@query(
    f"WITH {SAMPLES}, x AS (SELECT match_id, account_id, target, min(t) / 60.0 AS minutes FROM s, (SELECT unnest([50, 100, 200, 400]) AS target) WHERE source = 'purchase' AND total >= target GROUP BY 1, 2, 3), y AS (SELECT target, round(median(minutes), 4) AS minutes, count(*) AS games FROM x GROUP BY 1) "
    "SELECT target::BIGINT AS target, minutes, games FROM y WHERE games >= 3 AND target < coalesce((SELECT min(t) FROM (SELECT unnest([50, 100, 200, 400]) AS t) WHERE t NOT IN (SELECT target FROM y WHERE games >= 3)), 1000000000)"
)
def milestone_medians(spark, sf_dir):
    s, _ = samples(spark, sf_dir)
    targets = [50, 100, 200, 400]
    reached = s.where("source = 'purchase'").withColumn("target", F.explode(F.array(*(F.lit(t).cast("long") for t in targets)))).where("total >= target")
    times = reached.groupBy(*KEYS, "target").agg((F.min("t") / 60.0).alias("minutes"))
    return rounded(reports.milestone_medians(times, "target", "minutes", targets), "minutes")


@query("WITH p AS (SELECT DISTINCT 'upgrade_' || l_suppkey % 50 AS c FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity > 45) SELECT l_orderkey, l_linenumber, 'upgrade_' || l_suppkey % 50 AS class_name, CASE WHEN c IS NOT NULL THEN 'proc' ELSE 'stat' END AS attribution FROM lineitem LEFT JOIN p ON c = 'upgrade_' || l_suppkey % 50")
def item_attribution(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("class_name", F.concat(F.lit("upgrade_"), (F.col("l_suppkey") % 50).cast("string")))
    damage = lines.where("l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity > 45").select(F.col("class_name").alias("source_class"))
    return reports.item_attribution(lines.select("l_orderkey", "l_linenumber", "class_name"), damage, "class_name", "source_class")


@query(
    "WITH w AS (SELECT l_orderkey, sum(l_quantity * 60)::BIGINT AS owned_s, sum(l_quantity * 3)::BIGINT AS dealt, FROM lineitem WHERE l_suppkey % 10 = 0 GROUP BY 1), d AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS v FROM lineitem WHERE l_suppkey % 10 = 0 AND l_returnflag = 'R' GROUP BY 1) "
    "SELECT count(*) AS builds, coalesce(sum(v), 0)::BIGINT AS damage, coalesce(sum(owned_s), 0)::BIGINT AS owned_s, coalesce(sum(dealt), 0)::BIGINT AS dealt_after_buy, round(60.0 * coalesce(sum(v), 0) / sum(owned_s), 4) AS per_min, round(100.0 * coalesce(sum(v), 0) / sum(dealt), 4) AS percent_of_dealt FROM w LEFT JOIN d USING (l_orderkey)"
)
def item_value(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_suppkey % 10 = 0").withColumn("q", F.col("l_quantity").cast("long"))
    windows = lines.select("l_orderkey", (F.col("l_linenumber") * 100).alias("owned_from"), (F.col("l_linenumber") * 100 + F.col("q") * 60).alias("owned_to"), (F.col("q") * 3).alias("dealt"))
    return rounded(reports.item_value(windows, lines.where("l_returnflag = 'R'"), ["l_orderkey"], "q", "dealt"), "per_min", "percent_of_dealt")


@query(
    f"WITH {SAMPLES}, m AS (SELECT match_id, account_id, sum(v)::BIGINT AS distance FROM e GROUP BY 1, 2), x AS (SELECT match_id, account_id, sum(total)::BIGINT AS farm_souls FROM (SELECT match_id, account_id, source, max(total) AS total FROM s WHERE source IN ('click', 'purchase') GROUP BY 1, 2, 3) GROUP BY 1, 2) "
    "SELECT match_id, account_id, distance, farm_souls, duration_s, round(60.0 * farm_souls / duration_s, 4) AS farm_min, CASE WHEN distance <> 0 THEN round(1000.0 * farm_souls / distance, 4) END AS souls_per_1000_units FROM m LEFT JOIN x USING (match_id, account_id) JOIN g USING (match_id, account_id)"
)
def movement_profile(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    moved = s.groupBy(*KEYS).agg(F.sum("v").alias("distance"))
    return rounded(reports.farm_pace(moved, s, games, KEYS, "source", "total", ["click", "purchase"]), "farm_min", "souls_per_1000_units")


@query(
    f"WITH {SAMPLES}, d AS (SELECT event_id, match_id, account_id AS victim_id, account_id + 1 AS killer_id, v, CASE WHEN v % 5 <> 0 THEN v * 2.0 END AS kx, t FROM e WHERE source = 'error') "
    "SELECT event_id, d.match_id, victim_id, killer_id, a.duration_s AS victim_duration_s, b.duration_s AS killer_duration_s, round(sqrt((v - kx) * (v - kx) + (t - v) * (t - v)) / 40.0, 4) AS killer_distance FROM d LEFT JOIN g a ON a.match_id = d.match_id AND a.account_id = victim_id LEFT JOIN g b ON b.match_id = d.match_id AND b.account_id = killer_id"
)
def kill_log(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    killer_x = F.when(F.col("v") % 5 != 0, F.col("v") * 2.0)
    deaths = e.where("source = 'error'").select("event_id", "match_id", F.col("account_id").alias("victim_id"), (F.col("account_id") + 1).alias("killer_id"), F.col("v").alias("x"), F.col("t").alias("y"), killer_x.alias("kx"), F.col("v").alias("ky"))
    out = reports.kill_log(deaths, games, "match_id", "victim_id", "killer_id", ["x", "y"], ["kx", "ky"], 40.0)
    return rounded(out.drop("x", "y", "kx", "ky"), "killer_distance")


@query("SELECT o_custkey, c_mktsegment, o_orderkey FROM (SELECT DISTINCT c_custkey AS o_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'furniture')) JOIN orders USING (o_custkey)")
def tracked_games(spark, sf_dir):
    downloads = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return reports.tracked_games(downloads, read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["Building", "FURNITURE"], ["o_custkey"], "c_mktsegment")
