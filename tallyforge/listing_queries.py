"""Queries of the listings and labels on the standard tables, with DuckDB SQL that gives the same rows.

A day of ``events`` is a match, its users are the players, their event types the sources; in other queries an order is
a game, its lines are purchases, and its customer is the account.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.functions.columns import binned, since_day
from tallyforge.operators import items, listings, timeline
from tallyforge.queries import query, read, rounded
from tallyforge.report_queries import _SOURCE_GAINS, KEYS, SAMPLES, WIDTH, samples


def finals_of(s):
    return s.groupBy(*KEYS, "source").agg(F.max("total").alias("total")).where("total <> 0")


# Labels


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = (SELECT min(n_nationkey) FROM nation WHERE regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = 'nation7')")
def hero_filter(spark, sf_dir):
    heroes = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return read(spark, sf_dir, "customer").where(labels.hero_filter(heroes, "Nation & 7", "c_nationkey", "n_name")).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey AS hero_id, coalesce(n_name, 'id' || c_nationkey) AS hero, CASE c_custkey % 7 WHEN 1 THEN 'yellow' WHEN 4 THEN 'blue' WHEN 6 THEN 'green' END AS lane FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def player_rows(spark, sf_dir):
    heroes = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("hero_id"), F.col("n_name").alias("name"))
    players = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("hero_id"), (F.col("c_custkey") % 7).alias("assigned_lane"))
    return listings.player_rows(players, heroes).drop("assigned_lane")


@query(
    "WITH x AS (SELECT o_orderkey, (o_custkey % 18)::INT AS o FROM orders) SELECT o_orderkey, o AS objective_id, CASE WHEN o = 0 THEN 'Weakened Patron' WHEN o <= 4 THEN 'Guardian' WHEN o <= 8 THEN 'Walker' WHEN o = 9 THEN 'Patron' WHEN o <= 11 THEN 'Shrine' WHEN o <= 15 THEN 'Base Guardians' END AS objective, "
    "CASE WHEN o IN (1, 5, 12) THEN 'yellow' WHEN o IN (3, 7, 14) THEN 'blue' WHEN o IN (4, 8, 15) THEN 'green' END AS lane FROM x"
)
def objective_labels(spark, sf_dir):
    return labels.with_objective_labels(read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 18).cast("int").alias("objective_id")))


_CLASS = "CASE l_linenumber WHEN 1 THEN 'hp_permanent_pickup' WHEN 2 THEN 'hp_powerup_pickup' WHEN 3 THEN 'other' ELSE lower(l_returnflag) || '_gun_permanent_pickup_lv' || CAST(l_linenumber AS {}) END"


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag AS r, {_CLASS.format('VARCHAR')} AS type FROM lineitem) SELECT l_orderkey, type, CASE WHEN n <= 2 THEN 'hp' WHEN n > 3 THEN lower(r) || '_gun' END AS buff, CASE WHEN n = 1 THEN 1 WHEN n > 3 THEN n END::BIGINT AS level FROM x")
def buff_labels(spark, sf_dir):
    return labels.with_buff_labels(read(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_CLASS.format("STRING")).alias("type")))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'players' WHEN 2 THEN 'troopers' WHEN 3 THEN 'jungle' WHEN 4 THEN 'bosses' WHEN 5 THEN 'treasure' WHEN 6 THEN 'assists' WHEN 7 THEN 'denies' ELSE l_linenumber::VARCHAR END AS source_name FROM lineitem")
def soul_source_names(spark, sf_dir):
    return labels.with_soul_source_name(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber")


@query("SELECT o_orderkey, o_custkey % 30 AS ability_id, coalesce('item_' || r_name, 'ability_' || n_name) AS class_name, coalesce(r_name, n_name) AS name FROM orders LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 1) ON r_regionkey = o_custkey % 30 LEFT JOIN nation ON n_nationkey = o_custkey % 30")
def stack_labels(spark, sf_dir):
    abilities = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("ability_"), "n_name").alias("class_name"), F.col("n_name").alias("name"))
    shop = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") != 1, F.concat(F.lit("item_"), "r_name")).alias("class_name"), F.col("r_name").alias("name"))
    return labels.with_stack_labels(read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("ability_id")), abilities, shop)


@query("SELECT l_orderkey, l_linenumber, coalesce(replace(r_name, '_', ' '), 'id' || l_linenumber) AS label, l_quantity::BIGINT % 3 + 1 AS stars FROM lineitem LEFT JOIN region ON r_regionkey = l_linenumber")
def accolade_awards(spark, sf_dir):
    names = read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 3).alias("threshold"))
    return listings.awards(rows, names, "l_linenumber", "r_name", "threshold").drop("threshold")


# Games


@query(f"WITH {SAMPLES}, w AS (SELECT * FROM g WHERE account_id % 3 = 1 ORDER BY match_id DESC, account_id DESC LIMIT 10) SELECT match_id, account_id, duration_s, coalesce(total, 0)::BIGINT AS total FROM w LEFT JOIN (SELECT * FROM f WHERE source = 'purchase') USING (match_id, account_id)")
def match_history(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    return listings.match_history(games.where("account_id % 3 = 1"), finals_of(s).where("source = 'purchase'"), KEYS, "total", KEYS, 10)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'Placing' ELSE o_orderpriority END AS rating, round(o_totalprice - o_custkey, 4) AS applied FROM orders WHERE o_orderstatus = 'F'")
def ranked_games(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("badge", F.col("o_custkey") % 9)
    return rounded(listings.ranked_games(rows, "badge", "o_orderpriority", "o_custkey", "o_totalprice").select("o_orderkey", "rating", "applied"), "applied")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate::DATE >= DATE '2000-01-01'")
def unscored_since(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "P", True).when(F.col("o_orderstatus") == "O", False)
    rows = listings.unscored(read(spark, sf_dir, "orders").withColumn("not_scored", flag))
    return rows.where(since_day(F.col("o_orderdate"), "2000-01-01")).select("o_orderkey", "o_custkey")


@query(
    "WITH x AS (SELECT o_orderstatus = 'F' AS won, 'lane' AS t, CASE WHEN o_totalprice <= 100000 THEN 'behind' WHEN o_totalprice <= 300000 THEN 'even' ELSE 'ahead' END AS b FROM orders UNION ALL SELECT o_orderstatus = 'F', 'deaths', CASE WHEN o_custkey % 6 <= 1 THEN '0-1' WHEN o_custkey % 6 <= 3 THEN '2-3' ELSE '4+' END FROM orders) "
    "SELECT t AS split, b AS bucket, count(*) AS games, sum(won::INT)::BIGINT AS wins, (count(*) - sum(won::INT))::BIGINT AS losses, round(100.0 * sum(won::INT) / count(*), 4) AS win_percent FROM x GROUP BY 1, 2"
)
def rate_tables(spark, sf_dir):
    buckets = {"lane": binned(F.col("o_totalprice"), [100000, 300000], ["behind", "even", "ahead"]), "deaths": binned(F.col("o_custkey") % 6, [1, 3], ["0-1", "2-3", "4+"])}
    return rounded(listings.rate_tables(read(spark, sf_dir, "orders"), buckets, F.col("o_orderstatus") == "F"), "win_percent")


@query(
    "WITH r AS (SELECT c_nationkey AS hero_id, o_orderstatus = 'F' AS won FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT count(*) / 12.0 AS m FROM r) "
    "SELECT hero_id, count(*) AS matches, sum(won::INT)::BIGINT AS wins, round(100.0 * sum(won::INT) / count(*), 4) AS win_percent, round(100.0 * count(*) / any_value(m), 4) AS pick_percent FROM r, n WHERE hero_id = 3 GROUP BY 1"
)
def hero_baseline(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = items.pick_rates(rows.select(F.col("c_nationkey").alias("hero_id"), "o_orderstatus"), "hero_id", F.col("o_orderstatus") == "F")
    return rounded(per.where("hero_id = 3"), "win_percent", "pick_percent")


# Deaths and objectives


@query(f"WITH {SAMPLES} SELECT event_id, match_id, account_id, t, duration_s FROM e JOIN g USING (match_id, account_id) WHERE source = 'error'")
def game_deaths(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    return listings.game_deaths(e.where("source = 'error'").select("event_id", *KEYS, "t"), games, KEYS)


@query(f"WITH {SAMPLES}, x AS (SELECT match_id, v % 12 AS killer, count(*) AS deaths FROM e WHERE source = 'error' GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY deaths DESC, killer) AS place FROM x) WHERE place <= 5")
def top_killers(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    return listings.top_killers(e.where("source = 'error'").withColumn("killer", F.col("v") % 12), ["match_id"], "killer")


@query(
    f"WITH {SAMPLES}, m AS (SELECT match_id, min(account_id) % 2 AS mine FROM e GROUP BY 1) SELECT event_id, match_id, t, CASE v % 18 WHEN 1 THEN 'yellow' WHEN 3 THEN 'blue' WHEN 4 THEN 'green' END AS lane, CASE WHEN account_id % 2 = mine THEN 'ally' ELSE 'enemy' END AS side "
    "FROM e JOIN m USING (match_id) WHERE source = 'click' AND v % 18 BETWEEN 1 AND 4 AND t <= 43200"
)
def guardian_falls(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    mine = e.groupBy("match_id").agg((F.min("account_id") % 2).alias("team"))
    falls = e.where("source = 'click'").select("event_id", "match_id", "t", (F.col("v") % 18).alias("objective_id"), (F.col("account_id") % 2).alias("team"))
    return listings.objective_falls(falls, mine, "match_id", "t", 43200).select("event_id", "match_id", "t", "lane", "side")


# Aim


@query(
    f"WITH {SAMPLES}, w AS (SELECT match_id, account_id, coalesce(sum(total) FILTER (source = 'click'), 0)::BIGINT AS shots, coalesce(sum(total) FILTER (source = 'purchase'), 0)::BIGINT AS hits, coalesce(sum(total) FILTER (source = 'error'), 0)::BIGINT AS headshots FROM f WHERE source IN ('click', 'purchase', 'error') GROUP BY 1, 2), m AS (SELECT match_id, min(account_id) % 2 AS mine FROM g GROUP BY 1) "
    "SELECT match_id, account_id, account_id % 2 AS team, shots, hits, headshots, total AS gun, round(100.0 * hits / greatest(shots, 1), 4) AS hit_rate, round(100.0 * headshots / greatest(hits, 1), 4) AS headshot_rate, CASE WHEN account_id % 2 = mine THEN 'ally' ELSE 'enemy' END AS side FROM w JOIN m USING (match_id) LEFT JOIN (SELECT * FROM f WHERE source = 'signup') USING (match_id, account_id)"
)
def lobby_aim(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    finals = finals_of(s)
    gun = finals.where("source = 'signup'").select(*KEYS, F.col("total").alias("gun"))
    players = games.select(*KEYS, (F.col("account_id") % 2).alias("team"))
    aims = listings.lobby_aim(finals, players, gun, KEYS, "source", "total", "click", "purchase", "error")
    return rounded(listings.with_side(aims, games.groupBy("match_id").agg((F.min("account_id") % 2).alias("team")), "match_id"), "hit_rate", "headshot_rate")


@query(f"WITH {SAMPLES}, w AS (SELECT account_id, coalesce(sum(total) FILTER (source = 'click'), 0)::BIGINT AS hit, coalesce(sum(total) FILTER (source = 'error'), 0)::BIGINT AS missed FROM f GROUP BY 1) SELECT account_id, hit, missed, CASE WHEN hit + missed <> 0 THEN round_even(100.0 * hit / (hit + missed), 0)::BIGINT END AS accuracy FROM w")
def snapshot_accuracy(spark, sf_dir):
    s, _ = samples(spark, sf_dir)
    of = lambda name: F.when(F.col("source") == name, F.col("total"))
    return listings.accuracy(finals_of(s).select("account_id", of("click").alias("hit"), of("error").alias("missed")), ["account_id"], "hit", "missed")


@query(
    f"WITH {SAMPLES}, w AS (SELECT match_id, account_id, coalesce(sum(total) FILTER (source = 'click'), 0) AS a, coalesce(sum(total) FILTER (source = 'purchase'), 0) AS b, coalesce(sum(total) FILTER (source = 'error'), 0) AS c FROM f GROUP BY 1, 2), z AS (SELECT account_id, count(*) AS games, sum(a)::BIGINT AS shots, sum(b)::BIGINT AS hits, sum(c)::BIGINT AS headshots FROM w GROUP BY 1) "
    "SELECT *, round(shots / games, 4) AS shots_per_game, round(hits / games, 4) AS hits_per_game, round(headshots / games, 4) AS headshots_per_game, CASE WHEN shots <> 0 THEN round(100.0 * hits / shots, 4) END AS hit_percent, CASE WHEN hits <> 0 THEN round(100.0 * headshots / hits, 4) END AS headshot_percent FROM z"
)
def aim_totals(spark, sf_dir):
    s, _ = samples(spark, sf_dir)
    out = listings.aim_totals(finals_of(s), ["account_id"], KEYS, "source", "total", "click", "purchase", "error")
    return rounded(out, "shots_per_game", "hits_per_game", "headshots_per_game", "hit_percent", "headshot_percent")


# Sources


@query(f"WITH {SAMPLES} SELECT match_id, account_id, source, total, round(100.0 * total / nullif(sum(total) OVER (PARTITION BY match_id, account_id), 0), 4) AS percent FROM f")
def game_sources(spark, sf_dir):
    s, _ = samples(spark, sf_dir)
    return rounded(listings.game_sources(finals_of(s), KEYS, "source", "total"), "percent")


@query(f"WITH {SAMPLES} SELECT match_id, account_id, coalesce(total, 0)::BIGINT AS total FROM g LEFT JOIN (SELECT * FROM f WHERE source = 'error') USING (match_id, account_id)")
def one_source(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    return listings.one_source(finals_of(s), games, KEYS, "source", "error", "total")


_GROUP = "CASE WHEN source IN ('error', 'signup') THEN 'rare' ELSE 'common' END"


@query(f"WITH {SAMPLES}, w AS (SELECT count(*) AS n, sum(duration_s) / 60.0 AS m FROM g), p AS (SELECT {_GROUP} AS block, sum(total)::BIGINT AS total FROM f GROUP BY 1) SELECT block, total, round(total / n, 4) AS per_game, round(total / m, 4) AS per_min, round(100.0 * total / sum(total) OVER (), 4) AS percent FROM p, w")
def group_block(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    return rounded(listings.group_block(finals_of(s), games, KEYS, F.expr(_GROUP), "total"), "per_game", "per_min", "percent")


@query(
    f"WITH {SAMPLES}, w AS (SELECT count(*) FILTER (account_id % 2 = 0) AS a, count(*) FILTER (account_id % 2 <> 0) AS b FROM g), p AS (SELECT source, coalesce(sum(total) FILTER (account_id % 2 = 0), 0) AS x, coalesce(sum(total) FILTER (account_id % 2 <> 0), 0) AS y FROM f GROUP BY 1) "
    "SELECT source, round(x / a, 4) AS mine, round(y / b, 4) AS theirs, round(x / a - y / b, 4) AS gap FROM p, w"
)
def pool_gap(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    return rounded(listings.pool_gap(finals_of(s), games, F.col("account_id") % 2 == 0, ["source"], "total"), "mine", "theirs", "gap")


_MARKS = (21600, 43200, 64800)


@query(
    f"WITH {SAMPLES}, k AS (SELECT unnest({list(_MARKS)}) AS mark), c AS (SELECT match_id, account_id, source, mark, coalesce(max(total) FILTER (t <= mark), 0) AS value FROM s JOIN g USING (match_id, account_id) CROSS JOIN k WHERE duration_s >= mark GROUP BY 1, 2, 3, 4) "
    "SELECT source, mark::INT AS mark, median(value) FILTER (account_id % 2 = 0) AS mine, median(value) FILTER (account_id % 2 <> 0) AS theirs, median(value) FILTER (account_id % 2 = 0) - median(value) FILTER (account_id % 2 <> 0) AS gap FROM c GROUP BY 1, 2"
)
def source_mark_gaps(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    marked = s.join(games, KEYS).withColumn("mark", F.explode(F.array(*map(F.lit, _MARKS)))).where("duration_s >= mark")
    values = marked.groupBy(*KEYS, "source", "mark").agg(F.coalesce(F.max(F.when(F.col("t") <= F.col("mark"), F.col("total"))), F.lit(0)).alias("value"))
    return listings.mark_medians(values, F.col("account_id") % 2 == 0, ["source", "mark"], "value")


_CELLS = ", ".join(f"coalesce(sum(total) FILTER (interval = {i}), 0)::BIGINT AS i{i}" for i in range(13))


@query(f"WITH {_SOURCE_GAINS}, x AS (SELECT match_id, account_id, 'source' AS kind, source AS label, interval, total FROM d UNION ALL SELECT match_id, account_id, 'group', {_GROUP}, interval, total FROM d) SELECT match_id, account_id, kind, label, sum(total)::BIGINT AS total, {_CELLS} FROM x GROUP BY 1, 2, 3, 4")
def interval_table(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    per = timeline.source_intervals(s, games, KEYS, ["source"], "t", "total", WIDTH)
    return listings.interval_table(per, KEYS, "source", F.expr(_GROUP), "total", 13)


# Scoreboards and items


@query(f"WITH {SAMPLES}, b AS (SELECT match_id, account_id, sum(v % 3) AS buffs FROM e WHERE source = 'error' GROUP BY 1, 2), x AS (SELECT match_id, account_id, account_id % 2 AS team, coalesce(total, 0)::BIGINT AS worth, coalesce(buffs, 0)::BIGINT AS buffs FROM g LEFT JOIN (SELECT * FROM f WHERE source = 'purchase') USING (match_id, account_id) LEFT JOIN b USING (match_id, account_id)) SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY worth DESC, account_id) AS place FROM x")
def scoreboard(spark, sf_dir):
    s, games = samples(spark, sf_dir)
    finals = finals_of(s).where("source = 'purchase'").select(*KEYS, F.col("total").alias("worth"))
    players = games.select(*KEYS, (F.col("account_id") % 2).alias("team"))
    return listings.scoreboard(players, finals, s.where("source = 'error'").withColumn("count", F.col("v") % 3), KEYS, ["match_id", "team"], "worth")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, buy_n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS buy_n FROM lineitem) WHERE l_suppkey % 5 = 2")
def item_buys(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return listings.item_buys(read(spark, sf_dir, "lineitem"), ["l_orderkey"], order, F.col("l_suppkey") % 5 == 2).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "buy_n")


@query(
    "WITH p AS (SELECT l_suppkey, count(*) AS games, round(sum(l_quantity), 4) AS total, max(l_extendedprice) AS cost, avg(l_linenumber) / 60 AS buy_min, avg(l_partkey) / 60 AS owned_min, 60 * sum(l_quantity) / sum(l_partkey) AS d FROM lineitem WHERE l_partkey > 0 GROUP BY 1) "
    "SELECT l_suppkey, games, total, cost, round(buy_min, 4) AS buy_min, round(owned_min, 4) AS owned_min, round(d, 4) AS per_min_owned, round(1000 * d / cost, 4) AS per_1k FROM p WHERE cost <> 0"
)
def cost_efficiency(spark, sf_dir):
    out = listings.cost_efficiency(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "l_linenumber", "l_partkey", "l_quantity")
    return rounded(out, "total", "buy_min", "owned_min", "per_min_owned", "per_1k")


# Movement

_METRICS = f"{SAMPLES}, m AS (SELECT match_id, account_id, sum(v)::BIGINT AS way, max(v) AS pace FROM e WHERE source = 'click' GROUP BY 1, 2), r AS (SELECT match_id, account_id, account_id % 3 = 0 AS won, way, pace FROM g LEFT JOIN m USING (match_id, account_id))"


@query(f"WITH {_METRICS} SELECT * FROM r")
def movement_game_rows(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    metrics = e.where("source = 'click'").groupBy(*KEYS).agg(F.sum("v").alias("way"), F.max("v").alias("pace"))
    return listings.movement_games(games.select(*KEYS, (F.col("account_id") % 3 == 0).alias("won")), metrics, KEYS)


@query(f"WITH {_METRICS} SELECT won, false AS everything, count(*) AS games, round(avg(way), 4) AS way, round(avg(pace), 4) AS pace FROM r GROUP BY 1 UNION ALL SELECT NULL, true, count(*), round(avg(way), 4), round(avg(pace), 4) FROM r")
def movement_by_result(spark, sf_dir):
    return rounded(listings.mean_metrics(movement_game_rows(spark, sf_dir), "won", ["way", "pace"]), "way", "pace")
