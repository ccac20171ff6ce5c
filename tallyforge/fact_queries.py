"""Queries of source facts, objectives, eras and levels on the standard tables, with DuckDB SQL that gives the same rows.

A day of ``events`` is a match and its users the players; an order is a build, its lines what was bought or upgraded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.frames import dealt
from tallyforge.operators import breakdown, eras, items, levels, listings, objectives, records, source_facts, timeline
from tallyforge.plans import views
from tallyforge.queries import query, read, rounded
from tallyforge.report_queries import KEYS, SAMPLES, WIDTH, samples

# Sources with what was paid for their items

_DELIVERY = "CASE {} WHEN 'click' THEN 'gun' WHEN 'view' THEN 'ability' WHEN 'purchase' THEN 'gun_proc' ELSE 'spirit_proc' END"
_FACTS = (
    f"{SAMPLES}, w AS (SELECT match_id, account_id, ['purchase', 'error', 'signup', 'none'][event_id % 4 + 1] AS source, t, v, event_id FROM e WHERE event_id % 3 = 0), "
    "ow AS (SELECT match_id, account_id, source, sum(duration_s - t) / 60.0 AS owned_minutes FROM w JOIN g USING (match_id, account_id) GROUP BY 1, 2, 3), "
    "ou AS (SELECT match_id, account_id, source, sum(v % 500 + 100) AS outlay FROM w WHERE event_id % 6 = 0 GROUP BY 1, 2, 3), "
    "fa AS (SELECT * FROM ow FULL JOIN ou USING (match_id, account_id, source) WHERE source IN (SELECT source FROM f)), "
    f"r AS (SELECT match_id, account_id, source AS source_class, upper(source) AS source_name, {_DELIVERY.format('source')} AS delivery, coalesce(total, 0)::BIGINT AS amount, coalesce(owned_minutes, 0) AS owned_minutes, coalesce(outlay, 0)::BIGINT AS effective_cost FROM f FULL JOIN fa USING (match_id, account_id, source))"
)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"source_name": F.upper("source_class"), "delivery": F.expr(_DELIVERY.format("source_class"))})


def _source_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s, lengths = samples(spark, sf_dir)
    games = lengths.select(*KEYS, (F.col("duration_s") / 60.0).alias("game_minutes"))
    finals = breakdown.final_values(s, KEYS, "source", "total").select(*KEYS, F.col("source").alias("source_class"), F.col("total").alias("amount"), F.lit(0).cast("long").alias("self_amount"))
    item = F.array(*map(F.lit, ("purchase", "error", "signup", "none")))[(F.col("event_id") % 4).cast("int")]
    bought = s.where("event_id % 3 = 0").select(*KEYS, item.alias("source_class"), "event_id", F.col("t").alias("owned_from"), (F.col("v") % 500 + 100).alias("effective_cost"))
    windows = bought.join(lengths.select(*KEYS, F.col("duration_s").alias("owned_to")), KEYS)
    owned, costs = source_facts.owned_minutes(windows, KEYS), source_facts.outlay(bought.where("event_id % 6 = 0"), KEYS)
    return source_facts.source_rows(_named(finals), games, owned, costs, KEYS, _named), games


@query(f"WITH {_FACTS} SELECT match_id, account_id, source_class, source_name, delivery, amount, round(owned_minutes, 4) AS owned_minutes, effective_cost, round(duration_s / 60.0, 4) AS game_minutes FROM r JOIN g USING (match_id, account_id)")
def damage_source_rows(spark, sf_dir):
    rows, _ = _source_rows(spark, sf_dir)
    return rounded(rows.drop("self_amount"), "owned_minutes", "game_minutes")


_MEASURES = (
    "count(DISTINCT (match_id, account_id)) FILTER (amount <> 0) AS games, sum(amount)::BIGINT AS total, any_value(minutes) AS minutes, sum(owned_minutes) AS owned, sum(effective_cost) AS cost"
)


@query(
    f"WITH {_FACTS}, m AS (SELECT source_class, sum(duration_s) / 60.0 AS minutes FROM r JOIN g USING (match_id, account_id) WHERE amount <> 0 GROUP BY 1), x AS (SELECT source_name, source_class, delivery, {_MEASURES} FROM r LEFT JOIN m USING (source_class) GROUP BY 1, 2, 3) "
    "SELECT source_name, source_class, delivery, games, total, round(total / minutes, 4) AS per_min, CASE WHEN owned <> 0 THEN round(total / owned, 4) END AS per_min_owned, CASE WHEN cost <> 0 THEN round(1000.0 * total / cost, 4) END AS per_1k, "
    "round(100.0 * total / (SELECT sum(amount) FROM r), 4) AS percent, round(total / (SELECT count(*) FROM g), 4) AS per_window_game FROM x WHERE total <> 0"
)
def damage_by_source(spark, sf_dir):
    rows, games = _source_rows(spark, sf_dir)
    out = source_facts.by_source(rows, games, KEYS).select("source_name", "source_class", "delivery", "games", "total", "per_min", "per_min_owned", "per_1k", "percent", "per_window_game")
    return rounded(out, "per_min", "per_min_owned", "per_1k", "percent", "per_window_game")


@query(
    f"WITH {_FACTS}, d AS (SELECT DISTINCT match_id, account_id FROM r WHERE amount <> 0 AND delivery LIKE '%_proc'), x AS (SELECT match_id, count(DISTINCT account_id) FILTER (amount <> 0 AND delivery LIKE '%_proc') AS games, sum(amount)::BIGINT AS total, sum(owned_minutes) AS owned FROM r WHERE delivery LIKE '%_proc' GROUP BY 1) "
    "SELECT x.match_id, games, total, round((SELECT coalesce(sum(duration_s), 0) / 60.0 FROM d JOIN g USING (match_id, account_id) WHERE d.match_id = x.match_id), 4) AS minutes, round(owned, 4) AS owned_minutes FROM x"
)
def proc_damage_by_match(spark, sf_dir):
    """At another grain: several sources of a game count its minutes once."""
    rows, games = _source_rows(spark, sf_dir)
    out = source_facts.by_grain(rows.where("delivery LIKE '%_proc'"), games, ["match_id"], KEYS)
    return rounded(out.select("match_id", "games", "total", "minutes", "owned_minutes"), "minutes", "owned_minutes")


# Rifts and urns: a team's hour with a purchase wins a rift, an hour with a sign-up brings an urn

_INCOME = (
    "e AS (SELECT (epoch_us(ts) - 1704067200000000) // 86400000000 AS match_id, ((epoch_us(ts) - 1704067200000000) // 3600000000) % 24 AS h, user_id % 2 AS team, event_type, user_id FROM events), "
    "hr AS (SELECT match_id, team, h, max((event_type = 'purchase')::INT) AS rift, max((event_type = 'error')::INT) * 100 AS back, min(user_id % 6) FILTER (event_type = 'signup') AS runner, min(user_id % 7) FILTER (event_type = 'signup') AS spawn FROM e GROUP BY 1, 2, 3), "
    "pl AS (SELECT unnest(range(0, 6)) AS p), ga AS (SELECT match_id, team, h, p, CASE WHEN rift = 1 THEN 247 + 37 * h + back ELSE 0 END + CASE WHEN p = runner THEN 250 + 70 * (8 + spawn) ELSE 0 END + CASE WHEN h % 5 = 4 AND p < 2 THEN 1 + p ELSE 0 END AS gain FROM hr, pl), "
    "gp AS (SELECT * FROM ga WHERE gain > 0), md AS (SELECT match_id, team, h, gain AS payout, count(*) AS n FROM gp GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5), "
    "rw AS (SELECT match_id, team, h, payout, back, (payout - back - 247) / 37.0 + 13 AS minute FROM md JOIN hr USING (match_id, team, h)), rf AS (SELECT * FROM rw WHERE abs(minute - round(minute)) <= 0.05 AND minute BETWEEN 12.5 AND 31), "
    "tp AS (SELECT match_id, team, h, arg_max(p, (gain, p)) AS p, max(gain) AS top FROM gp GROUP BY 1, 2, 3), ur AS (SELECT match_id, team, h, p, top - coalesce(payout, 0) AS bounty FROM tp LEFT JOIN rf USING (match_id, team, h))"
)


def _income(spark, sf_dir) -> dict[str, DataFrame]:
    t = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = read(spark, sf_dir, "events").select(F.floor(t / 24).alias("match_id"), (t % 24).alias("h"), (F.col("user_id") % 2).alias("team"), "event_type", "user_id")
    of = lambda kind, value: F.min(F.when(F.col("event_type") == kind, value))
    hours = e.groupBy("match_id", "team", "h").agg(of("purchase", F.lit(1)).alias("rift"), F.coalesce(of("error", F.lit(100)), F.lit(0)).alias("back"), of("signup", F.col("user_id") % 6).alias("runner"), of("signup", F.col("user_id") % 7).alias("spawn"))
    each = hours.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    or_0 = lambda when, value: F.when(when, value).otherwise(F.lit(0))
    gain = or_0(F.col("rift") == 1, 247 + 37 * F.col("h") + F.col("back")) + or_0(F.col("p") == F.col("runner"), 250 + 70 * (8 + F.col("spawn"))) + or_0((F.col("h") % 5 == 4) & (F.col("p") < 2), 1 + F.col("p"))
    so_far = Window.partitionBy("match_id", "account_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    totals = each.withColumn("account_id", F.col("team") * 6 + F.col("p")).withColumns({"souls": F.sum(gain).over(so_far), "orbs": F.lit(0), "value": F.sum("back").over(so_far)})
    roster = each.select("match_id", (F.col("team") * 6 + F.col("p")).alias("account_id"), "team", F.col("p").alias("runner")).distinct()
    games = e.select("match_id").distinct().withColumns({"start_time": F.lit("2026-07-01").cast("timestamp"), "duration_s": F.lit(1800)})
    return {"treasure": totals.select("match_id", "account_id", "h", "souls", "orbs"), "koth": totals.select("match_id", "account_id", "h", "value"), "roster": roster, "games": games}


@query(
    f"WITH {_INCOME} SELECT match_id, team, h, 'rift' AS kind, payout::BIGINT AS amount, NULL::VARCHAR AS runner, back <> 0 AS behind, round(minute, 4) AS minute FROM rf "
    "UNION ALL SELECT match_id, team, h, 'urn', bounty::BIGINT, p::VARCHAR, false, round((bounty - 250) / 70.0, 4) FROM ur WHERE bounty >= 915 AND (bounty - 250) / 70.0 <= 32"
)
def rift_and_urn_events(spark, sf_dir):
    i = _income(spark, sf_dir)
    out = objectives.income_events(i["treasure"], i["koth"], i["roster"], i["games"], ["match_id"], "account_id", "h", F.col("souls") + F.col("orbs"), "value", "runner")
    return rounded(out.withColumn("amount", F.col("amount").cast("long")), "minute")


# Recipes, prices and scales by era

_RECIPES = (
    "ed AS (SELECT p_partkey AS item, p_partkey // 2 AS component, DATE '1993-01-01' AS era FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 3, DATE '1995-06-01' FROM part WHERE p_partkey > 2), "
    "c2 AS (SELECT a.item, b.component, a.era FROM ed a JOIN ed b ON a.component = b.item AND a.era = b.era), c3 AS (SELECT a.item, b.component, a.era FROM c2 a JOIN ed b ON a.component = b.item AND a.era = b.era), "
    "cl AS (SELECT item, component, era, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM ed UNION ALL SELECT *, 2 FROM c2 UNION ALL SELECT *, 3 FROM c3) GROUP BY 1, 2, 3)"
)


@query(
    f"WITH {_RECIPES}, b AS (SELECT l_orderkey, l_partkey AS item, any_value(o_orderdate)::DATE AS day, count(*) * 100 AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), "
    "lv AS (SELECT b.l_orderkey, b.item, coalesce(max(era) FILTER (era <= day), min(era)) AS era FROM b JOIN (SELECT DISTINCT item, era FROM cl) c ON c.item = b.item GROUP BY 1, 2), "
    "off AS (SELECT b.l_orderkey, b.item, u.item AS component, row_number() OVER (PARTITION BY b.l_orderkey, u.item ORDER BY depth, b.item) AS n FROM lv b JOIN cl ON cl.item = b.item AND cl.era = b.era JOIN b u ON u.l_orderkey = b.l_orderkey AND u.item = cl.component), "
    "cr AS (SELECT l_orderkey, item, count(*) * 40 AS credit FROM off WHERE n = 1 GROUP BY 1, 2) SELECT l_orderkey, item, (cost - coalesce(credit, 0))::BIGINT AS effective_cost FROM b LEFT JOIN cr USING (l_orderkey, item)"
)
def component_credit_by_era(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    recipe = lambda divisor, era: parts.where(f"p_partkey >= {divisor}").select(F.col("p_partkey").alias("item"), F.floor(F.col("p_partkey") / divisor).alias("part"), F.lit(era).cast("timestamp").alias("era_from"))
    closure = items.component_closure(recipe(2, "1993-01-01").unionByName(recipe(3, "1995-06-01")), "item", "part", by=["era_from"])
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("time"))
    lines = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")), "l_orderkey")
    buys = lines.groupBy("l_orderkey", "item", F.lit(1).alias("at")).agg((F.count(F.lit(1)) * 100).alias("cost")).join(orders, "l_orderkey")
    used = buys.select("l_orderkey", "at", F.col("item").alias("component"), F.lit(40).alias("price"))
    return items.effective_cost(buys, used, closure, ["l_orderkey"], "at", time="time").select("l_orderkey", "item", "effective_cost")


@query(
    "WITH er AS (SELECT p_partkey AS item, DATE '1992-01-01' + (p_partkey * k % 40 * 60)::INT AS era, p_size * k AS cost FROM part, (SELECT unnest([1, 2, 3, 5, 7]) AS k)), d AS (SELECT item, era, max(cost) AS cost FROM er GROUP BY 1, 2) "
    "SELECT l_orderkey, l_linenumber, item, strftime(l_shipdate, '%Y-%m-%d') AS day, (SELECT arg_max(cost, era) FROM d WHERE d.item = l.item AND (era <= l_shipdate OR era = (SELECT min(era) FROM d x WHERE x.item = l.item)))::BIGINT AS cost FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey AS item, l_shipdate::DATE AS l_shipdate FROM lineitem) l"
)
def items_priced(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_size", F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 7)))).alias("k"))
    eras_of = parts.select("item_id", F.date_add(F.lit("1992-01-01").cast("date"), (F.col("item_id") * F.col("k") % 40 * 60).cast("int")).cast("timestamp").alias("era_from"), (F.col("p_size") * F.col("k")).cast("long").alias("cost"))
    eras_of = eras_of.groupBy("item_id", "era_from").agg(F.max("cost").alias("cost"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"), F.to_date("l_shipdate").cast("timestamp").alias("start_time"), F.lit(0).alias("cost")).distinct()
    out = items.priced(lines, eras_of, values=["cost"])
    return out.select("l_orderkey", "l_linenumber", F.col("item_id").alias("item"), F.date_format("start_time", "yyyy-MM-dd").alias("day"), "cost")


_STEPS = (
    "u AS (SELECT l_orderkey AS k, l_returnflag AS property, l_linenumber AS tier, l_partkey AS o, l_suppkey AS o2, l_quantity / 10.0 AS bonus, ['add_to_base', 'multiply_base', 'add_to_scale', 'multiply_scale', 'other'][l_suppkey % 5 + 1] AS type, CASE WHEN l_partkey % 3 = 0 THEN l_linestatus END AS stat FROM lineitem WHERE l_linenumber <= 3), "
    "b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'R' ELSE 'N' END AS property, o_custkey % 50 AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'F' END AS stat, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 END AS scale FROM orders), "
    "r AS (SELECT k, property, value, b.stat, scale FROM b FULL JOIN (SELECT DISTINCT k, property FROM u) d USING (k, property))"
)
_FOLDED = "list_reduce(list_prepend([{0}, 0.0], list([bonus, (type LIKE 'multiply%')::INT::DOUBLE] ORDER BY tier, o, o2, type, bonus)), lambda a, x: CASE WHEN x[2] = 1 THEN [a[1] * x[1], 0] ELSE [a[1] + x[1], 0] END)[1]"


def _abilities(spark, sf_dir) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem").where("l_linenumber <= 3"), read(spark, sf_dir, "orders")
    kind = F.array(*map(F.lit, ("add_to_base", "multiply_base", "add_to_scale", "multiply_scale", "other")))[(F.col("l_suppkey") % 5).cast("int")]
    upgrades = lines.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("property"), F.col("l_linenumber").alias("tier"), F.col("l_partkey").alias("o"), F.col("l_suppkey").alias("o2"), (F.col("l_quantity") / 10).alias("bonus"), kind.alias("type"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_linestatus")).alias("stat"))
    third = F.col("o_orderkey") % 3 == 0
    properties = orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "R").otherwise("N").alias("property"), (F.col("o_custkey") % 50).alias("value"), F.when(third, "F").alias("scale_stat"), F.when(third, 0.5).alias("scale"))
    return levels_at(properties, upgrades)


def levels_at(properties: DataFrame, upgrades: DataFrame) -> DataFrame:
    return eras.values_at_tiers(properties, upgrades, ["k"], [3], ["o", "o2"])


@query(
    f"WITH {_STEPS}, v AS (SELECT k, property, {_FOLDED.format('any_value(begins)')} AS value FROM (SELECT u.*, coalesce(r.value, 0)::DOUBLE AS begins FROM u JOIN r USING (k, property) WHERE type LIKE '%_base') GROUP BY 1, 2) "
    "SELECT k, property, 3 AS tier, round(coalesce(v.value, r.value, 0), 4) AS value FROM r LEFT JOIN v USING (k, property)"
)
def ability_values(spark, sf_dir):
    return rounded(_abilities(spark, sf_dir).drop("scales"), "value")


@query(
    f"WITH {_STEPS}, s AS (SELECT u.*, coalesce(u.stat, r.stat, 'tech_power') AS own, CASE WHEN coalesce(u.stat, r.stat, 'tech_power') = r.stat THEN coalesce(scale, 0) ELSE 0 END::DOUBLE AS begins FROM u JOIN r USING (k, property) WHERE type LIKE '%_scale'), "
    f"v AS (SELECT k, property, own AS stat, {_FOLDED.format('any_value(begins)')} AS scale FROM s GROUP BY 1, 2, 3), a AS (SELECT * FROM v UNION ALL SELECT k, property, stat, scale FROM r WHERE stat IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.k = r.k AND v.property = r.property AND v.stat = r.stat)) "
    "SELECT k, property, 3 AS tier, stat, round(scale, 4) AS scale FROM a WHERE scale <> 0"
)
def ability_scales(spark, sf_dir):
    return rounded(eras.scale_rows(_abilities(spark, sf_dir)), "scale")


# Levels and curves


@query(
    "WITH l AS (SELECT DISTINCT l_orderkey AS hero_id, l_linenumber AS level FROM lineitem), c AS (SELECT l_orderkey AS hero_id, l_linenumber AS level, l_returnflag = 'R' AS point, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3), "
    "x AS (SELECT hero_id, level, coalesce((SELECT sum(n) FROM c WHERE c.hero_id = l.hero_id AND c.level <= l.level AND point), 0)::BIGINT AS ability_points, coalesce((SELECT sum(n) FROM c WHERE c.hero_id = l.hero_id AND c.level <= l.level AND NOT point), 0)::BIGINT AS ability_unlocks FROM l) SELECT * FROM x"
)
def level_currencies(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hero_id"), F.col("l_linenumber").alias("level"), "l_returnflag")
    named = F.when(F.col("l_returnflag") == "R", "ability_points").otherwise("ability_unlocks")
    gained = lines.where("l_returnflag <> 'N'").groupBy("hero_id", "level", named.alias("currency")).agg(F.count(F.lit(1)).alias("amount"))
    return levels.with_currencies(lines.select("hero_id", "level").distinct(), gained, ["hero_id"])


@query(
    "WITH c AS (SELECT s_nationkey AS n, s_acctbal * 30 AS souls, s_suppkey AS position, s_suppkey / 2.0 AS bonus FROM supplier) "
    "SELECT o_orderkey, round(coalesce((SELECT arg_max(bonus, (souls, position)) FROM c WHERE n = c_nationkey AND souls <= o_totalprice), 0), 4) AS investment_bonus FROM orders JOIN customer ON o_custkey = c_custkey"
)
def investment_bonus(spark, sf_dir):
    curve = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), (F.col("s_acctbal") * 30).alias("souls"), F.col("s_suppkey").alias("position"), (F.col("s_suppkey") / 2).alias("bonus"))
    spent = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n")), "o_custkey")
    return rounded(eras.investment_bonus(spent, curve, ["n"], "o_totalprice").select("o_orderkey", "investment_bonus"), "investment_bonus")


# Eras of whole snapshots

_SNAPSHOTS = "s AS (SELECT (epoch_us(ts) - 1704067200000000) // 86400000000 AS build, event_type AS id, (count(*) // 60)::VARCHAR AS record FROM events GROUP BY 1, 2), d AS (SELECT build, string_agg(id || '=' || record, ',' ORDER BY id) AS digest FROM s GROUP BY 1)"


@query(f"WITH {_SNAPSHOTS} SELECT build FROM (SELECT build, digest, lag(digest) OVER (ORDER BY build) AS b FROM d) WHERE b IS NULL OR b <> digest")
def snapshot_eras(spark, sf_dir):
    """The second half of the builds goes on from the eras found in the first."""
    t = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    rows = read(spark, sf_dir, "events").groupBy(t.alias("build"), F.col("event_type").alias("id")).agg(F.floor(F.count(F.lit(1)) / 60).cast("string").alias("record"))
    first = eras.new_eras(rows.where("build <= 15"), "build", "id", "record")
    known = eras.snapshot_digest(rows.where("build <= 15"), ["build"], "id", "record")
    return first.select("build").unionByName(eras.new_eras(rows, "build", "id", "record", known).select("build"))


# Enemies

_ENEMIES = f"{SAMPLES}, h AS (SELECT match_id, account_id, account_id * 7 % 5 AS target_account_id, v FROM e WHERE source = 'click')"


@query(
    f"WITH {_ENEMIES} SELECT h.match_id, target_account_id AS account_id, h.account_id AS enemy_account_id, sum(v)::BIGINT AS v, any_value(h.account_id % 11) AS enemy_hero_id, any_value(h.account_id % 2) AS enemy_team "
    "FROM h JOIN g ON g.match_id = h.match_id AND g.account_id = target_account_id WHERE v <> 0 GROUP BY 1, 2, 3"
)
def enemy_damage_totals(spark, sf_dir):
    e, games = samples(spark, sf_dir)
    hits = e.where("source = 'click'").select(*KEYS, (F.col("account_id") * 7 % 5).alias("target_account_id"), "v")
    players = e.select(*KEYS, (F.col("account_id") % 11).alias("hero_id"), (F.col("account_id") % 2).alias("team")).distinct()
    return timeline.enemy_totals(hits, games, players, "match_id", "target_account_id", "account_id", "v")


@query(f"WITH {SAMPLES} SELECT match_id, account_id, source, NULL::BIGINT AS final, total::BIGINT AS from_intervals FROM f WHERE source = 'signup'")
def totals_against_intervals(spark, sf_dir):
    """Final figures agree with the sums of intervals but for one source, which is left out of the final ones here."""
    s, games = samples(spark, sf_dir)
    finals = breakdown.final_values(s.where("source <> 'signup'"), KEYS, "source", "total")
    per = timeline.source_intervals(s, games, KEYS, ["source"], "t", "total", WIDTH)
    return timeline.differing_totals(finals, per, [*KEYS, "source"], "total")


# Lobbies


@query(
    "WITH p AS (SELECT o_custkey AS match_id, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_orderkey % 7 + 1) * 10 + o_orderkey % 6 + 1 END AS badge, o_orderkey % 9 = 0 AS quit FROM orders), "
    "l AS (SELECT match_id, CASE WHEN count(*) FILTER (badge > 0) >= 6 THEN avg(badge // 10 * 6 + badge % 10) FILTER (badge > 0) END AS placed, bool_or(quit) AS abandoned FROM p GROUP BY 1), "
    "m AS (SELECT match_id, placed, abandoned, (match_id % 3) * 21 AS a, (match_id % 2) * 34 AS b FROM l) SELECT match_id, round(CASE WHEN a > 0 AND b > 0 THEN (a // 10 * 6 + a % 10 + b // 10 * 6 + b % 10) / 2.0 ELSE placed END, 4) AS subrank, abandoned FROM m"
)
def lobby_ratings(spark, sf_dir):
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    players = orders.select(F.col("o_custkey").alias("match_id"), F.when(key % 4 == 0, 0).otherwise((key % 7 + 1) * 10 + key % 6 + 1).alias("player_rank_initial_display_rank"), F.when(key % 9 == 0, 1).alias("abandon_time_s"))
    lobbies = views.lobby_facts(players).withColumns({"a": F.col("match_id") % 3 * 21, "b": F.col("match_id") % 2 * 34})
    return rounded(lobbies.select("match_id", views.lobby_subrank(F.col("a"), F.col("b"), F.col("placed_subrank")).alias("subrank"), "abandoned"), "subrank")


# Aim and leavers

_AIM = f"{SAMPLES}, c AS (SELECT match_id, account_id, account_id % 3 AS hero, sum(v) FILTER (source = 'click')::BIGINT AS shots, coalesce(sum(v // 2) FILTER (source = 'click'), 0)::BIGINT AS hits, coalesce(sum(v // 7) FILTER (source = 'click' AND event_id % 2 = 0), 0)::BIGINT AS headshots FROM e GROUP BY 1, 2), k AS (SELECT *, 100.0 * hits / shots AS hit, CASE WHEN hits <> 0 THEN 100.0 * headshots / hits END AS head FROM c WHERE shots >= 100)"
_PLACE = "CASE WHEN {0} IS NOT NULL THEN round(100.0 * (rank() OVER (PARTITION BY hero ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY hero, {0}) - 1) / 2.0) / count(*) OVER (PARTITION BY hero)) END"


@query(f"WITH {_AIM} SELECT match_id, account_id, hero, shots, hits, headshots, round(hit, 4) AS hit_rate, round(head, 4) AS headshot_rate, count(*) OVER (PARTITION BY hero) AS hero_games, {_PLACE.format('hit')} AS hit_percentile, {_PLACE.format('head')} AS headshot_percentile FROM k")
def aim_rates(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    clicks = e.where("source = 'click'")
    kinds = F.array(F.struct(F.lit("Shots").alias("stat"), F.col("v").alias("value")), F.struct(F.lit("Hits").alias("stat"), F.floor(F.col("v") / 2).alias("value")), F.struct(F.lit("Headshots").alias("stat"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("v") / 7)).alias("value")))
    counters = clicks.select(*KEYS, (F.col("account_id") % 3).alias("hero"), F.inline(kinds))
    return rounded(records.aim_rates(counters, KEYS, "hero", "stat", "value", 100, 1), "hit_rate", "headshot_rate")


@query(
    f"WITH {SAMPLES}, lv AS (SELECT match_id, account_id, account_id % 2 AS team, min(t) AS gone FROM e WHERE source = 'error' GROUP BY 1, 2), p AS (SELECT match_id, account_id, t, sum(total) AS v FROM s GROUP BY 1, 2, 3), "
    "r AS (SELECT match_id, account_id, team, coalesce(max(v) FILTER (t > gone) > min(v) FILTER (t > gone), false) AS returned FROM lv LEFT JOIN p USING (match_id, account_id) GROUP BY 1, 2, 3), m AS (SELECT DISTINCT match_id, match_id % 2 AS mine, match_id % 3 = 0 AS won FROM e) "
    "SELECT match_id, bool_or(won) AS won, bool_or(account_id IN (1, 2, 3)) AS you, bool_or(account_id NOT IN (1, 2, 3) AND team = mine) AS ally, bool_or(team <> mine) AS enemy, bool_or(returned) AS returned FROM r JOIN m USING (match_id) GROUP BY 1"
)
def abandon_record(spark, sf_dir):
    s, _ = samples(spark, sf_dir)
    games = s.select("match_id", (F.col("match_id") % 3 == 0).alias("won"), (F.col("match_id") % 2).alias("team")).distinct()
    leavers = s.where("source = 'error'").groupBy(*KEYS).agg(F.min("t").alias("abandon_time_s")).withColumn("team", F.col("account_id") % 2)
    return records.abandons(games, leavers, s.withColumnRenamed("t", "time_stamp_s"), [1, 2, 3], "total")


@query(
    f"WITH {SAMPLES}, x AS (SELECT match_id, account_id, account_id % 4 AS hero, coalesce(sum(v) FILTER (source = 'click'), 0) AS shots, coalesce(sum(v // 3) FILTER (source = 'click'), 0) AS hits, coalesce(sum(v) FILTER (source = 'view'), 0) AS them, count(*) FILTER (source = 'signup') AS parries, count(*) FILTER (source = 'error') AS missed FROM e GROUP BY 1, 2) "
    "SELECT hero, count(*) AS games, sum(shots)::BIGINT AS shots, round(sum(shots) / count(*), 4) AS shots_per_game, round(100.0 * sum(hits) / sum(shots), 4) AS hit_percent, sum(them)::BIGINT AS incoming_shots, CASE WHEN sum(parries + missed) > 0 THEN round(100.0 * sum(parries) / sum(parries + missed), 4) END AS parry_percent FROM x GROUP BY 1"
)
def combat_totals(spark, sf_dir):
    e, _ = samples(spark, sf_dir)
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("source") == kind, value)), F.lit(0))
    none = F.lit(0).cast("long")
    games = e.groupBy(*KEYS).agg(
        of("click", F.col("v")).alias("shots"), of("click", F.floor(F.col("v") / 3)).alias("hits"), F.max(none).alias("headshots"), of("view", F.col("v")).alias("incoming_shots"), F.max(none).alias("incoming_hits"),
        of("signup", F.lit(1)).alias("parries"), of("error", F.lit(1)).alias("missed_parries"),
    )
    out = listings.combat_totals(games.withColumn("hero", F.col("account_id") % 4), ["hero"])
    return rounded(out.select("hero", "games", "shots", "shots_per_game", "hit_percent", "incoming_shots", "parry_percent"), "shots_per_game", "hit_percent", "parry_percent")
