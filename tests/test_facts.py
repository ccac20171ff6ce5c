"""Figures worked out by hand: source facts, objectives, eras, levels, lobbies, windows of measures, drift of a store."""

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.operators import breakdown, eras, items, levels, listings, objectives, records, reports, source_facts, standing, timeline
from tallyforge.plans import registry, views
from tallyforge.plans.metrics import Context, Dimension, Lookup, Measure, MetricView, Series, summarize, validate_view, view_frame
from tallyforge.schemas import TABLES
from tallyforge.sources import histories, upkeep
from tallyforge.sources.store import Store

from .test_histories import HERO, history

KEYS = ["match_id", "account_id"]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def times(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


# Sources with their items


def named(df):
    return df.withColumns({"source_name": F.upper("source_class"), "delivery": F.when(F.col("source_class") == "gun", "gun").otherwise("gun_proc")})


@pytest.fixture(scope="module")
def sources(spark):
    games = spark.createDataFrame([(1, 7, 30.0), (2, 7, 20.0), (3, 7, 10.0)], "match_id int, account_id int, game_minutes double")
    detail = spark.createDataFrame([(1, 7, "gun", 600, 0), (2, 7, "gun", 400, 0), (1, 7, "lamp", 300, 20), (1, 7, None, 50, 0)], "match_id int, account_id int, source_class string, amount int, self_amount int")
    owned = spark.createDataFrame([(1, 7, "lamp", 12.0), (2, 7, "lamp", 8.0), (2, 7, "rope", 5.0), (9, 7, "lamp", 99.0)], "match_id int, account_id int, source_class string, owned_minutes double")
    costs = spark.createDataFrame([(1, 7, "lamp", 500), (3, 7, "lamp", 1500)], "match_id int, account_id int, source_class string, effective_cost long")
    return source_facts.source_rows(named(detail), games, owned, costs, KEYS, named), games


def test_silent_items_have_rows(sources):
    got = rows(sources[0], "match_id", "source_class", "source_name", "amount", "owned_minutes", "effective_cost", "game_minutes")
    assert got == sorted([
        (1, "gun", "GUN", 600, 0.0, 0, 30.0), (2, "gun", "GUN", 400, 0.0, 0, 20.0), (1, None, None, 50, 0.0, 0, 30.0),
        (1, "lamp", "LAMP", 300, 12.0, 500, 30.0), (2, "lamp", "LAMP", 0, 8.0, 0, 20.0), (3, "lamp", "LAMP", 0, 0.0, 1500, 10.0),
    ], key=repr)


def test_rates_divide_by_what_they_name(sources):
    got = {r.source_name: r for r in source_facts.by_source(*sources, KEYS).collect()}
    lamp, gun = got["LAMP"], got["GUN"]
    assert (lamp.games, lamp.total, lamp.minutes, lamp.per_min, lamp.per_min_owned, lamp.per_1k) == (1, 300, 30.0, 10.0, 15.0, 150.0)
    assert (gun.games, gun.total, gun.per_min, gun.per_min_owned, gun.per_1k) == (2, 1000, 20.0, None, None)
    assert lamp.self == 20 and lamp.per_window_game == 100.0 and lamp.per_window_min == 5.0 and abs(gun.percent - 100 * 1000 / 1350) < 1e-9
    per_match = {r.match_id: r for r in source_facts.by_grain(*sources, ["match_id"], KEYS).collect()}
    assert (per_match[1].games, per_match[1].minutes, per_match[1].total) == (1, 30.0, 950) and (per_match[3].games, per_match[3].minutes) == (0, 0.0)


def test_item_games_tell_the_first_of_the_tier(spark):
    games = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "match_id int, account_id int")
    buys = spark.createDataFrame([(1, 7, 10, "rope", 1), (1, 7, 20, "coat", 2), (1, 7, 30, "lamp", 2), (2, 7, 5, "coat", 2)], "match_id int, account_id int, t int, item string, tier int")
    costs = spark.createDataFrame([(1, 7, 900), (1, 7, 100)], "match_id int, account_id int, effective_cost long")
    gained = spark.createDataFrame([(1, 7, 40)], "match_id int, account_id int, gained long")
    out = breakdown.item_games(games, buys, gained, KEYS, F.col("item") == "lamp", ["t"], 2, costs, "item")
    assert rows(out, "match_id", "built", "buy_n", "tier_buy_n", "item_tier", "first_of_tier", "is_first_of_tier", "effective_cost", "gained") == [
        (1, True, 3, 2, 2, "coat", False, 1000, 40), (2, False, None, None, 2, "coat", False, None, 0), (3, False, None, None, 2, None, None, None, 0)
    ]


# Recipes by era


def test_component_credit_follows_the_era(spark):
    closure = times(spark.createDataFrame([("big", "small", 1, "2026-01-01"), ("big", "tiny", 2, "2026-01-01"), ("big", "other", 1, "2026-03-01")], "item string, component string, depth int, era_from string"), "era_from")
    buys = times(spark.createDataFrame([(1, 60, "big", 3000, "2025-06-01"), (2, 60, "big", 3000, "2026-02-01"), (3, 60, "big", 3000, "2026-04-01"), (3, 9, "none", 50, "2026-04-01")], "match_id int, t int, item string, cost int, start string"), "start")
    used = spark.createDataFrame([(m, 60, c, p) for m in (1, 2, 3) for c, p in (("small", 500), ("tiny", 200), ("other", 800))], "match_id int, t int, component string, price int")
    out = items.effective_cost(buys, used, closure, ["match_id"], "t", time="start")
    assert rows(out, "match_id", "item", "credit", "effective_cost") == [(1, "big", 700, 2300), (2, "big", 700, 2300), (3, "big", 800, 2200), (3, "none", 0, 50)]


def test_contested_components_go_to_the_closest_then_the_lowest(spark):
    closure = spark.createDataFrame([("b", "c", 1), ("a", "c", 2), ("d", "c", 1)], "item string, component string, depth int")
    buys = spark.createDataFrame([(1, 5, "a", 100), (1, 5, "b", 100), (1, 5, "d", 100)], "m int, t int, item string, cost int")
    used = spark.createDataFrame([(1, 5, "c", 30), (1, 5, "c", 7)], "m int, t int, component string, price int")
    assert rows(items.effective_cost(buys, used, closure, ["m"], "t"), "item", "effective_cost") == [("a", 100), ("b", 63), ("d", 100)]


def test_credit_shuffles_no_laid_out_components(spark):
    closure = times(spark.createDataFrame([("a", "c", 1, "2026-01-01"), ("b", "c", 1, "2026-01-01"), ("b", "d", None, "2026-01-01"), (None, "c", 1, "2026-01-01"), ("a", None, 1, "2026-01-01"), ("a", "d", 2, None)], "item string, component string, depth int, era_from string"), "era_from")
    bought = [(1, 5, "b", 100, "2025-01-01"), (1, 5, "b", 90, "2026-05-01"), (1, 5, "a", 80, "2026-05-01"), (1, 5, None, 70, "2026-05-01"), (2, 5, "a", 60, None), (None, 5, "a", 50, "2026-05-01"), (3, None, "a", 40, "2026-05-01")]
    buys = times(spark.createDataFrame(bought, "m int, t int, item string, cost int, start string"), "start")
    used = spark.createDataFrame([(m, t, c, p) for m, t in ((1, 5), (2, 5), (None, 5), (3, None)) for c, p in (("c", 7), ("c", 3), ("d", None), (None, 5), ("e", 1))], "m int, t int, component string, price int")
    out = items.effective_cost(buys, used, closure, ["m"], "t", time="start")
    assert out.columns == ["m", "t", "item", "cost", "start", "credit", "effective_cost"]
    assert sorted(map(repr, rows(out, "m", "item", "cost", "credit"))) == sorted(map(repr, [(1, "b", 100, 0), (1, "b", 90, 0), (1, "a", 80, 10), (1, None, 70, 0), (2, "a", 60, 0), (None, "a", 50, 0), (3, "a", 40, 0)]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Generate inline") < plan.index("REPARTITION_BY_NUM")  # laid out after the rows are dealt


def test_closure_sends_no_edge_list_to_all(spark):
    from tallyforge.queries import closure_of

    plan = closure_of(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# As-of joins


@pytest.mark.parametrize("spread", [1, 5])
def test_asof_join_gives_the_live_era(spark, spread):
    dim = times(spark.createDataFrame([(k, f"2026-01-{d:02d}", d * 10 + k) for k in (1, 2) for d in range(1, 29, 3)] + [(None, "2026-01-01", 5)], "k int, era_from string, v int"), "era_from")
    left = [(k, f"{y}-01-{d:02d} 12:00:00", d) for k in (1, 2, 3, None) for y, d in (("2025", 9), ("2026", 1), ("2026", 17), ("2026", 30))] + [(1, None, 0), (2, "2026-01-04 00:00:00", 4), (2, "2026-01-04 00:00:00", 4)]
    frame = times(spark.createDataFrame(left, "k int, at string, d int"), "at")
    out = eras.asof_join(frame, dim, ["k"], "at", ["v"], spread=spread)
    live = lambda k, y, d: None if k not in (1, 2) else (10 if y == "2025" else max(x for x in range(1, 29, 3) if x <= d) * 10) + k
    want = sorted(((k, None if at is None else d, None if at is None else live(k, at[:4], d)) for k, at, d in left), key=repr)
    assert out.columns == ["k", "at", "d", "era_from", "v"]
    assert sorted(((r.k, None if r.at is None else r.d, r.v) for r in out.collect()), key=repr) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "<" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_scaling_of_a_level_as_of_a_game(spark):
    table = times(spark.createDataFrame([(7, 2, "2026-01-01", 500.0), (7, 2, "2026-02-01", 600.0)], "hero_id int, level int, era_from string, base_health double"), "era_from")
    games = times(spark.createDataFrame([(7, 2, "2025-05-01"), (7, 2, "2026-03-01"), (7, 3, "2026-03-01")], "hero_id int, level int, start string"), "start")
    assert sorted(str(r.base_health) for r in levels.scaling_asof(games, table, "start", ["base_health"]).collect()) == ["500.0", "600.0", "None"]


def test_damage_while_owning(spark):
    samples = spark.createDataFrame([(1, t, t * 10) for t in range(10, 100, 10)], "m int, t int, total int")
    windows = spark.createDataFrame([(1, "a", 15, 45, False), (1, "b", 50, 99, True), (1, "c", 0, 5, False), (2, "d", 0, 5, True)], "m int, item string, owned_from int, owned_to int, kept boolean")
    assert rows(items.gained_while_owned(windows, samples, ["m"], "t", "total", ["m", "item"])) == [(1, "a", 300), (1, "b", 400), (1, "c", 0), (2, "d", 0)]


# Eras of snapshots


def test_digests_ignore_order_and_reverted_changes_stay(spark):
    states = {1: ["a", "b"], 2: ["b", "a"], 3: ["a", "x"], 4: ["a", "b"], 5: ["a", "b"], 6: ["a", "b", "c"]}
    records = spark.createDataFrame([(b, r[:1] if r != "x" else "b", r) for b, rs in states.items() for r in rs], "build int, id string, record string")
    found = eras.new_eras(records, "build", "id", "record")
    assert [r.build for r in found.orderBy("build").collect()] == [1, 3, 4, 6]
    stored = eras.snapshot_digest(records.where("build <= 4"), ["build"], "id", "record")
    assert [r.build for r in eras.new_eras(records, "build", "id", "record", stored).collect()] == [6]
    assert [r.build for r in eras.new_eras(records, "build", "id", "record", stored.where("build = 1")).orderBy("build").collect()] == [3, 4, 6]
    assert eras.new_eras(records, "build", "id", "record", stored.where("false")).count() == 4
    twice = spark.createDataFrame([(1, "a", "r"), (1, "a", "r"), (2, "a", "r")], "build int, id string, record string")
    assert len({r.digest for r in eras.snapshot_digest(twice, ["build"], "id", "record").collect()}) == 2


# Upgrades of values and scales


def test_values_and_scales_at_tiers(spark):
    properties = spark.createDataFrame([("beam", "damage", 10.0, "tech_power", 0.5), ("beam", "range", 4.0, None, None)], "k string, property string, value double, scale_stat string, scale double")
    upgrades = spark.createDataFrame(
        [
            ("beam", 1, 0, "damage", 5.0, None, None), ("beam", 1, 1, "damage", 0.25, "add_to_scale", None), ("beam", 2, 0, "damage", 2.0, "multiply_base", None), ("beam", 2, 1, "damage", 4.0, "multiply_scale", None),
            ("beam", 3, 0, "damage", 3.0, "add_to_base", None), ("beam", 3, 1, "damage", 1.5, "add_to_scale", "weapon_power"), ("beam", 3, 2, "damage", 0.0, "multiply_scale", "tech_power"),
            ("beam", 2, 2, "range", 0.75, "add_to_scale", None), ("beam", 3, 3, "cost", -1.0, "add_to_base", None), ("beam", 3, 4, "range", 9.0, "unheard_of", None),
        ],
        "k string, tier int, n int, property string, bonus double, type string, stat string",
    )
    out = eras.values_at_tiers(properties, upgrades, ["k"], [0, 1, 2, 3], ["n"])
    got = {(r.property, r.tier): (r.value, r.scales) for r in out.collect()}
    assert [got["damage", t] for t in range(4)] == [(10.0, {"tech_power": 0.5}), (15.0, {"tech_power": 0.75}), (30.0, {"tech_power": 3.0}), (33.0, {"weapon_power": 1.5})]
    assert [got["range", t] for t in range(4)] == [(4.0, {}), (4.0, {}), (4.0, {"tech_power": 0.75}), (4.0, {"tech_power": 0.75})]
    assert got["cost", 2] == (0.0, {}) and got["cost", 3] == (-1.0, {})
    context = spark.createDataFrame([("weapon_power", 20.0)], "stat string, amount double")
    at3 = out.where("tier = 3 AND property = 'damage'")
    assert levels.resolved_values(at3, eras.scale_rows(at3), context, ["k", "property"]).first().resolved == 63.0


# Levels and curves


BOONS = HERO | {
    "stats": {"max_health": 730, "light_melee_damage": 50, "heavy_melee_damage": 100}, "level_up": {"base_health_from_level": 45.0, "tech_power": 1.5, "base_melee_damage_from_level": 2.0},
    "levels": [{"level": 1, "currencies": ["ability_unlocks"]}, {"level": 2, "required_souls": 200, "standard_upgrade": True, "currencies": ["ability_points", "ability_points", "ability_unlocks"]}, {"level": 3, "required_souls": 500, "standard_upgrade": True, "currencies": None}],
    "cost_bonuses": {"spirit": [{"souls": 800, "bonus": 7.0}, {"souls": 4800, "bonus": 38.0}], "weapon": []},
}


@pytest.fixture(scope="module")
def hero(spark):
    return histories.hero_tables(history(spark, ("2026-01-02", 3, 7, BOONS)))


def test_currencies_of_levels(hero):
    assert {n: df.columns for n, df in hero.items()} == {n: TABLES[n].names for n in hero}
    assert rows(hero["hero_level_currency_history"], "level", "currency", "amount") == [(1, "ability_unlocks", 1), (2, "ability_points", 2), (2, "ability_unlocks", 1)]
    boons = levels.boon_stats(hero["hero_level_history"], hero["hero_stat_history"], hero["hero_level_up_history"], ["hero_id"])
    full = levels.with_currencies(boons, hero["hero_level_currency_history"], ["hero_id"])
    got = rows(full, "level", "max_health", "light_melee_damage", "heavy_melee_damage", "ability_points", "ability_unlocks")
    assert got == [(1, 730.0, 50.0, 100.0, 0, 1), (2, 775.0, 52.0, 104.0, 2, 2), (3, 820.0, 54.0, 108.0, 2, 2)]


def test_boons_at_souls(spark, hero):
    left = spark.createDataFrame([(7, s) for s in (-1, 0, 199, 200, 9999)] + [(8, 500)], "hero_id long, souls int")
    out = levels.boons_at_souls(left, hero["hero_level_history"], levels.boon_stats(hero["hero_level_history"], hero["hero_stat_history"], hero["hero_level_up_history"], ["hero_id"]), ["hero_id"], "souls")
    assert rows(out, "hero_id", "souls", "level") == [(7, -1, 0), (7, 0, 1), (7, 199, 1), (7, 200, 2), (7, 9999, 3), (8, 500, 0)]


def test_investment_bonus_steps(spark, hero):
    assert rows(hero["hero_cost_bonus_history"], "slot", "position", "souls", "bonus") == [("spirit", 0, 800, 7.0), ("spirit", 1, 4800, 38.0)]
    left = spark.createDataFrame([("spirit", 0), ("spirit", 800), ("spirit", 4799), ("spirit", 4800), ("weapon", 99999), ("spirit", None)], "slot string, spent int")
    out = eras.investment_bonus(left, hero["hero_cost_bonus_history"], ["slot"], "spent")
    assert rows(out, "slot", "spent", "investment_bonus") == [("spirit", 0, 0.0), ("spirit", 4799, 7.0), ("spirit", 4800, 38.0), ("spirit", 800, 7.0), ("spirit", None, 0.0), ("weapon", 99999, 0.0)]


# Rifts and urns


def detect(spark, gains, comeback=0, duration=1800, names="ABCDEF", players=None):
    match = ["match_id"]
    frame = spark.createDataFrame([(1, 0, 600, g, n) for g, n in zip(gains, names)], "match_id int, team int, t int, gain int, runner string")
    games = spark.createDataFrame([(1, duration)], "match_id int, duration_s int")
    sizes = spark.createDataFrame([(1, 0, players or len(gains))], "match_id int, team int, players int")
    bonus = spark.createDataFrame([(1, 0, 600, comeback)], "match_id int, team int, t int, comeback int").where("comeback <> 0")
    rifts = objectives.rift_wins(frame, games, sizes, bonus, match, "t")
    urns = objectives.urn_deliveries(frame, rifts, games, match, "t", "runner")
    return [r.payout for r in rifts.collect()], [(r.runner, r.bounty) for r in urns.collect()]


@pytest.mark.parametrize(
    "gains, more, want",
    [
        ([247] * 6, {}, [247]), ([247] * 5 + [3000], {}, [247]), ([574] * 6, {"comeback": 327}, [574]), ([247, 247, 247, 100, 200, 300], {}, []), ([364] * 6, {}, []), ([54] * 6, {}, []), ([987] * 6, {"duration": 900}, []),
        ([247] * 4, {}, []),
    ],
)
def test_rift_wins(spark, gains, more, want):
    assert detect(spark, gains, **more)[0] == want


@pytest.mark.parametrize(
    "gains, names, duration, want",
    [
        ([2350], ["Mirage"], 1800, [("Mirage", 2350)]), ([247] * 5 + [2597], list("ABCDE") + ["Runner"], 1800, [("Runner", 2350)]), ([2000, 300], ["Runner", "Ally"], 1800, [("Runner", 2000)]),
        ([500], ["Mirage"], 1800, []), ([2350], ["Mirage"], 1200, []), ([2350, 2350], ["A", "B"], 1800, [("B", 2350)]),
    ],
)
def test_urn_deliveries(spark, gains, names, duration, want):
    assert detect(spark, gains, duration=duration, names=names, players=6)[1] == want


def test_minutes_solve_the_payouts(spark):
    got = spark.range(1).select(*(objectives.rift_minute(F.lit(x)) for x in (247, 284, 432)), *(objectives.urn_minute(F.lit(x)) for x in (950, 2350))).first()
    assert tuple(got) == (13.0, 14.0, 18.0, 10.0, 30.0)


def test_objective_log(spark):
    roster = spark.createDataFrame([(m, a, a // 10, f"h{a}") for m in (1, 2) for a in [*range(6), *range(10, 16)]], "match_id int, account_id int, team int, runner string")
    games = times(spark.createDataFrame([(1, "2026-07-01", 1800), (2, "2026-01-01", 1800)], "match_id int, start_time string, duration_s int"), "start_time")
    treasure = spark.createDataFrame([(m, a, t, s + (2350 if (a, t) == (12, 900) else 0), 7) for m in (1, 2) for a in range(10, 16) for t, s in ((300, 0), (900, 574), (1500, 574))], "match_id int, account_id int, t int, souls int, orbs int")
    koth = spark.createDataFrame([(1, 10, 300, 0), (1, 10, 900, 327)], "match_id int, account_id int, t int, value int")
    income = objectives.income_events(treasure, koth, roster, games, ["match_id"], "account_id", "t", F.col("souls") + F.col("orbs"), "value", "runner").withColumnRenamed("t", "at")
    fallen = spark.createDataFrame([(1, 0, 400, "Guardian", "yellow"), (1, 1, 500, "Patron", None), (1, 1, None, "Walker", "blue")], "match_id int, team int, at int, objective string, lane string")
    bosses = spark.createDataFrame([(1, 700, 0, 1), (1, 710, 1, 1)], "match_id int, at int, team_killed int, team_claimed int")
    out = objectives.objective_log(fallen, bosses, income, spark.createDataFrame([(1, 0), (2, 0)], "match_id int, team int"), "match_id")
    assert [(r.match_id, r.at, r.line) for r in out.orderBy("n").collect()] == [
        (1, 400, "enemy team destroys your Guardian (yellow)"), (1, 500, "your team destroys the enemy Patron"), (1, 700, "your team kills the mid boss, enemy team steals the Rejuvenator"), (1, 710, "enemy team kills the mid boss and claims the Rejuvenator"),
        (1, 900, "enemy team delivers the Soul Urn (h12, +2,350 souls)"), (1, 900, "enemy team wins an Unstable Rift while behind (+574 souls each)"),
    ]


# Movement, cores, medians, scoreboards, minutes of sources, enemies


def test_movement_shares_and_late_minutes(spark):
    minutes = spark.createDataFrame([(1, 0, 60, 40, 10, 30, 400.0), (1, 60, 30, 20, 10, 0, 200.0), (1, 660, 6, 0, 0, 3, 0.0)], "m int, start_s int, alive_s int, moving_s int, stationary_s int, slide_s int, distance double")
    games = spark.createDataFrame([(1, 590)], "m int, duration_s int")
    out = timeline.movement_buckets(minutes, games, ["m"], 300, ["stationary_s", "slide_s"])
    got = rows(out, "interval", "start_s", "end_s", "alive_s", "stationary_percent", "slide_percent", "pace")
    assert got == [(0, 0, 300, 90, 100 * 20 / 60, 100 * 30 / 90, 600.0), (1, 300, 590, 0, None, None, None), (2, 600, 590, 6, None, 50.0, None)]


def test_core_is_of_won_builds(spark):
    builds = spark.createDataFrame([(1, "a", True, 5), (1, "a", True, 9), (1, "b", True, 7), (2, "a", True, 11), (3, "b", False, 1), (3, "c", False, 2)], "b int, item string, won boolean, t int")
    assert rows(breakdown.item_core(builds, ["b"], "item", F.col("won"), 50)) == [("a", 100.0, 0.0), ("b", 50.0, 100.0)]
    assert rows(breakdown.item_core(builds, ["b"], "item", F.col("won"), 50, "t")) == [("a", 100.0, 0.0, 10.0), ("b", 50.0, 100.0, 7.0)]


def test_no_interval_is_worst_when_none_is_behind(spark):
    ahead = spark.createDataFrame([(i, mine, v) for i in (0, 1) for mine, v in [(True, 5 + i)] * 3 + [(False, 5)] * 3], "interval int, mine boolean, v int")
    assert [r.worst for r in reports.pool_medians(ahead, F.col("mine"), "interval", "v").collect()] == [False, False]
    assert [r.worst for r in reports.pool_medians(ahead, ~F.col("mine"), "interval", "v").orderBy("interval").collect()] == [False, True]


def test_scoreboard_counts_buffs(spark):
    players = spark.createDataFrame([(1, 7, 0), (1, 8, 0)], "match_id int, account_id int, team int")
    finals = spark.createDataFrame([(1, 7, 100)], "match_id int, account_id int, worth int")
    buffs = spark.createDataFrame([(1, 8, 2), (1, 8, 3)], "match_id int, account_id int, count int")
    assert rows(listings.scoreboard(players, finals, buffs, KEYS, ["match_id", "team"], "worth"), "account_id", "buffs", "place") == [(7, 0, 1), (8, 5, 2)]


def test_minutes_of_income_count_a_match_once(spark):
    finals = spark.createDataFrame([(1, 7, "lane", 100, 5), (1, 8, "lane", 50, 0), (2, 7, "lane", 10, 0)], "match_id int, account_id int, source string, souls int, orbs int")
    games = spark.createDataFrame([(1, 7, 600), (1, 8, 600), (2, 7, 300)], "match_id int, account_id int, duration_s int")
    got = breakdown.souls_by_source(finals, games, KEYS, "source", "souls", "orbs", ["match_id"]).first()
    assert (got.games, got.souls, got.secured_orbs, got.minutes) == (3, 165, 5, 15.0)


def test_enemy_totals(spark):
    damage = spark.createDataFrame([(1, 7, 20, 30), (1, 7, 20, 12), (1, 7, 21, 0), (1, 20, 7, 9), (1, 7, None, 99), (2, 7, 20, 5)], "match_id int, account_id int, target_account_id int, damage int")
    games = spark.createDataFrame([(1, 7)], "match_id int, account_id int")
    players = spark.createDataFrame([(1, 20, 3, 1)], "match_id int, account_id int, hero_id int, team int")
    dealt = timeline.enemy_totals(damage, games, players, "match_id", "account_id", "target_account_id", "damage")
    assert rows(dealt, "account_id", "enemy_account_id", "damage", "enemy_hero_id", "enemy_team") == [(7, 20, 42, 3, 1)]
    taken = timeline.enemy_totals(damage, games, players, "match_id", "target_account_id", "account_id", "damage")
    assert rows(taken, "account_id", "enemy_account_id", "damage") == [(7, 20, 9)]


# Lobbies and records


def lobby(spark, badges, team0, team1, quit_by=None, start="2026-05-01", match=1):
    players = spark.createDataFrame([(match, i, 101, i < 6, b, 60 if i == quit_by else None, 1 if i == 0 else 2) for i, b in enumerate(badges)], "match_id long, account_id long, hero_id long, won boolean, player_rank_initial_display_rank long, abandon_time_s long, mvp_rank long")
    players = players.withColumns({c: F.lit(None).cast("long") for c in ("player_rank_initial_calibration_games", "player_rank_final_flat_progress", "player_rank_initial_flat_progress", "team")}).withColumn("start_time", F.lit(start).cast("timestamp"))
    game = times(spark.createDataFrame([(match, start, 600, 1, 1, 1, team0, team1, False)], "match_id long, start_time string, duration_s long, match_mode long, game_mode long, ranked_type long, average_badge_team0 long, average_badge_team1 long, not_scored boolean"), "start_time")
    return players, game


@pytest.mark.parametrize(
    "badges, team0, team1, want",
    [([0] * 12, 0, 34, None), ([0] * 12, 31, 33, 20.0), ([11] * 5 + [0] * 7, 0, 0, None), ([11] * 3 + [13] * 3 + [0] * 6, 0, 0, 8.0), ([11] * 12, 31, 33, 20.0), ([None] * 6 + [21] * 6, None, None, 13.0)],
)
def test_lobby_rating(spark, badges, team0, team1, want):
    players, game = lobby(spark, badges, team0, team1)
    context = Context(spark, {"players": players, "matches": game}.__getitem__)
    got = summarize(context, registry.build("record_games", account=0), (), ["lobby_subrank", "rated_games"]).first()
    assert tuple(got) == (want, 0 if want is None else 1)


def test_daily_record_names_the_lobby_of_its_newest_rated_game(spark):
    parts = [lobby(spark, [0] * 12, 31, 33, quit_by=9, match=1), lobby(spark, [0] * 12, 0, 0, start="2026-05-01 10:00:00", match=2), lobby(spark, [0] * 12, 31, 33, start="2026-05-02", match=3)]
    players, game = parts[0][0].unionByName(parts[1][0]).unionByName(parts[2][0]), parts[0][1].unionByName(parts[1][1]).unionByName(parts[2][1])
    ranks = times(spark.createDataFrame([(3, "Old", "2026-01-01"), (3, "New", "2026-05-01 12:00:00")], "tier long, name string, era_from string"), "era_from")
    out = views.daily_record(Context(spark, {"players": players, "matches": game}.__getitem__), [0, 7], ranks=ranks)
    got = rows(out, F.date_format("day", "dd"), "games", "wins", "losses", "cum_net", "mvps", "key_players", "abandons", "rated_games", "lobby")
    assert got == [("01", 4, 2, 2, 0, 2, 2, 2, 2, "Old II"), ("02", 2, 1, 1, 0, 1, 1, 0, 2, "New II")]


# Windows and keys of views


def sampled(**measures):
    return MetricView("sampled", lambda spark, table: table("s"), {"k": Dimension(lambda c: c["k"])}, measures)


def test_measures_agree_on_their_sample(spark):
    samples = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 1, 7)], "k string, t int, v int")
    context = Context(spark, {"s": samples}.__getitem__)
    last, first = Series(("k",), "t"), Series(("k",), "t", "first")
    total = lambda series: Measure(lambda c: F.sum(c["v"]), series=series)
    assert summarize(context, sampled(total=total(last)), (), "total").first()[0] == 10
    assert summarize(context, sampled(total=total(first)), (), "total").first()[0] == 12
    assert summarize(context, sampled(total=total(last), half=Measure(composed=lambda m: m["total"] / 2)), (), "half").first()[0] == 5
    for other in (total(first), total(None), Measure(lambda c: F.sum(c["v"]), series=last, cumulative_over=("k",)), total(Series(("k",), "v"))):
        with pytest.raises(ValueError):
            sampled(total=total(last), other=other)
    with pytest.raises(ValueError):
        Series((), "t")
    with pytest.raises(ValueError):
        Series(("k",), "t", "middle")
    with pytest.raises(ValueError, match="not in the source"):
        validate_view(context, sampled(total=total(Series(("k",), "nowhere"))))


def test_once_per_counts_a_key_once_in_each_group(spark):
    table = spark.createDataFrame([(1, "a", "x", 10), (1, "a", "y", 10), (2, "a", "x", 5), (1, "b", "x", 7)], "m int, p string, kind string, minutes int")
    view = MetricView("once", lambda spark, t: t("s"), {"kind": Dimension(lambda c: c["kind"])}, {"minutes": Measure(lambda c: c["minutes"], once_per=("m", "p")), "n": Measure(lambda c: F.count(F.lit(1))), "per": Measure(composed=lambda m: m["minutes"] / m["n"])})
    context = Context(spark, {"s": table}.__getitem__)
    assert rows(summarize(context, view, "kind", ["minutes", "n", "per"])) == [("x", 22, 3, 22 / 3), ("y", 10, 1, 10.0)]
    assert tuple(summarize(context, view, (), ["minutes", "n"]).first()) == (22, 4)
    validate_view(context, view)


def test_cardinality_of_lookups(spark):
    tables = {"s": spark.createDataFrame([(1, 5), (1, 6), (None, 7), (None, 8)], "k int, v int"), "d": spark.createDataFrame([(1, "x")], "k int, name string"), "d2": spark.createDataFrame([(1, "x"), (1, "y")], "k int, name string")}
    read = []
    make = lambda table, cardinality: MetricView("v", "s", {"name": Dimension(lambda c: c["d.name"])}, {"n": Measure(lambda c: F.count(F.lit(1)))}, (Lookup("d", table, {"k": "k"}, cardinality),))
    context = Context(spark, lambda n: read.append(n) or tables[n], check_keys=True)
    assert rows(summarize(context, make("d", "m:1"), "name", "n")) == [("x", 2), (None, 2)]
    with pytest.raises(ValueError, match="lookup d has a key twice"):
        view_frame(context, make("d2", "m:1"))
    with pytest.raises(ValueError, match="1:1"):
        view_frame(context, make("d", "1:1"))
    assert len(context.checked) == 3
    view_frame(context, make("d", "m:1"))
    assert len(context.checked) == 3  # looked at once
    context.version = lambda name: 2
    view_frame(context, make("d", "m:1"))
    assert len(context.checked) == 4
    with pytest.raises(ValueError):
        make("d", "1:m")
    # null keys meet nothing and break nothing
    tables["s"] = spark.createDataFrame([(1, 5), (None, 7), (None, 8)], "k int, v int")
    context.version = lambda name: 3
    assert view_frame(context, make("d", "1:1")).count() == 3


def test_lookups_that_nothing_names_are_not_joined(spark):
    tables = {"s": spark.createDataFrame([(1, 5)], "k int, v int"), "d": spark.createDataFrame([(1, "x")], "k int, name string")}
    read = []
    context = Context(spark, lambda n: read.append(n) or tables[n])
    view = MetricView("v", "s", {"name": Dimension(lambda c: c["d.name"])}, {"n": Measure(lambda c: F.count(F.lit(1)))}, (Lookup("d", "d", {"k": "k"}),))
    out = summarize(context, view, (), "n")
    assert read == ["s"] and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    summarize(context, view, "name", "n")
    assert read == ["s", "s", "d"]


# Drift of a store


@pytest.fixture(scope="module")
def tables(spark):
    import datetime

    starts = {1: datetime.datetime(2023, 11, 14), 2: datetime.datetime(2023, 12, 19)}
    of = lambda table, given: spark.createDataFrame([tuple(g.get(f.name) for f in TABLES[table]) for g in given], TABLES[table])
    return {
        "players": of("players", [{"match_id": m, "start_time": t, "account_id": a, "hero_id": 3, "kills": a, "party": 1} for m, t in starts.items() for a in (11, 22)]),
        "matches": of("matches", [{"match_id": m, "start_time": t, "duration_s": 600} for m, t in starts.items()]),
    }


def month_files(store, table):
    found = {}
    for folder, _, names in os.walk(store.path(table)):
        found |= {os.path.join(folder, n): os.path.getmtime(os.path.join(folder, n)) for n in names if n.endswith(".parquet")}
    return found


def test_drift_names_the_month_and_healing_rewrites_it_alone(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.upsert("players", tables["players"])
    assert store.drift("players") is None and store.heal("players") == []
    months = sorted(os.listdir(store.path("players")))
    months = [m for m in months if m.startswith("month=")]
    assert len(months) == 2
    path = f"{store.path('players')}/{months[0]}"
    copy = str(tmp_path / "copy")
    spark.read.parquet(path).withColumns({"kills": F.col("kills").cast("int"), "extra": F.lit(1)}).drop("party").write.parquet(copy)
    spark.read.parquet(copy).write.mode("overwrite").parquet(path)
    said = store.drift("players")
    assert months[0].removeprefix("month=") in said and months[1].removeprefix("month=") not in said
    assert "missing ['party']" in said and "more ['extra']" in said and "kills int" in said
    other = {f: t for f, t in month_files(store, "players").items() if months[1] in f}
    assert store.heal("players") == [months[0].removeprefix("month=")]
    assert store.drift("players") is None and store.scan("players").count() == 4
    assert {f: t for f, t in month_files(store, "players").items() if months[1] in f} == other


def test_upserts_leave_nothing_behind(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def size():
        return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(store.root) for n in names)

    store.upsert("matches", tables["matches"])
    once = size()
    for _ in range(3):
        store.upsert("matches", tables["matches"])
    store.reshape("matches")
    assert size() <= once + 64 and store.scan("matches").count() == 2  # a few bytes of checksums may differ


# Standings, aim, leavers, builds, combats


def test_standing_knows_points_in_the_subrank(spark):
    rows_ = [(1, 1, 33, 16_400, 100, True), (1, 2, 36, 20_500, 250, True), (2, 1, 0, 300, 300, True), (2, 2, 11, 40, 40, False), (3, 1, 112, 90_000, 10, True), (4, 1, 0, 500, 500, False), (4, 2, 0, 700, 200, True)]
    games = spark.createDataFrame(rows_, "account int, n int, badge int, points int, change int, won boolean")
    out = standing.season_standing(games, ["account"], ["n"], "badge", "points", F.col("change"), F.col("won"))
    assert rows(out, "account", "badge", "points", "into_subrank", "subrank_points", "wins", "losses", "net_points", "placed_games") == [
        (1, 36, 20_500, 1500, 2000, 2, 0, 350, 2), (2, 11, 40, 40, 1000, 1, 1, 40, 1), (3, 112, 90_000, None, None, 1, 0, 10, 1), (4, 0, None, None, None, 1, 1, 0, 0)
    ]


def test_aim_needs_shots_and_games(spark):
    shots = [(m, 7, "a", s, h, x) for m, s, h, x in ((1, 100, 50, 10), (2, 200, 60, 0), (3, 99, 99, 99), (4, 100, 0, 0))] + [(5, 8, "b", 100, 20, 5)]
    counters = spark.createDataFrame([(m, a, hero, n, v) for m, a, hero, *vs in shots for n, v in zip(("Shots", "Hits", "Headshots"), vs)], "match_id int, account_id int, hero string, stat string, value int")
    got = {r.match_id: r for r in records.aim_rates(counters, KEYS, "hero", "stat", "value", 100, 3).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert [(got[m].hit_rate, got[m].hit_percentile, got[m].hero_games) for m in (1, 2, 4, 5)] == [(50.0, 100.0, 3), (30.0, 67.0, 3), (0.0, 33.0, 3), (20.0, None, 1)]
    assert got[4].headshot_rate is None and got[4].headshot_percentile is None and got[1].headshot_percentile == 67.0


def test_who_left_and_who_came_back(spark):
    games = spark.createDataFrame([(1, True, 0), (2, False, 1), (3, True, 0)], "match_id int, won boolean, team int")
    leavers = spark.createDataFrame([(1, 7, 0, 100), (1, 9, 1, 100), (2, 8, 1, 50)], "match_id int, account_id int, team int, abandon_time_s int")
    samples = spark.createDataFrame([(1, 7, t, v) for t, v in ((50, 5), (150, 9), (200, 9))] + [(1, 9, t, v) for t, v in ((150, 1), (150, 2), (250, 8))], "match_id int, account_id int, time_stamp_s int, damage int")
    assert rows(records.abandons(games, leavers, samples, [7], "damage")) == [(1, True, True, False, True, True), (2, False, False, True, False, False)]


def test_sold_items_are_no_part_of_a_build(spark):
    builds = spark.createDataFrame([(1, "a", 5, True, "gun"), (1, "b", 9, False, "gun"), (2, "a", 7, False, "spirit"), (2, "a", 8, True, "gun"), (3, "c", 1, True, "gun")], "build int, item string, t int, sold boolean, slot string")
    assert rows(items.item_frequency(builds, ["build"], "item", "t", "sold", facts=["slot"])) == [("a", 1, 7.0, 100 / 3, "spirit"), ("b", 1, 9.0, 100 / 3, "gun")]
    assert rows(items.item_frequency(builds, ["build"], "item", "t", "sold", True), "item", "builds", "median_at") == [("a", 2, 6.5), ("b", 1, 9.0), ("c", 1, 1.0)]


def test_players_of_matches(spark):
    players = spark.createDataFrame([(1, 7, 3), (1, 8, 4), (2, 7, 4)], "match_id int, account_id int, hero_id int")
    matches = spark.createDataFrame([(1, 600), (2, 700)], "match_id int, duration_s int")
    assert rows(listings.match_players(players, matches, "match_id", hero=4), "match_id", "account_id", "duration_s") == [(1, 8, 600), (2, 7, 700)]
    assert rows(listings.match_players(players, matches, "match_id", [1], accounts=[7]), "match_id", "account_id") == [(1, 7)]
    assert listings.match_players(players, matches, "match_id").count() == 0


def test_combat_of_both_sides(spark):
    tables = {
        "players": times(spark.createDataFrame([(1, 7, 3, True, "2026-01-01"), (2, 7, 3, False, "2026-01-02"), (2, 8, 4, True, "2026-01-02")], "match_id long, account_id long, hero_id long, won boolean, start_time string"), "start_time"),
        "custom_stats": spark.createDataFrame(
            [(1, 7, 60, "Enemy Hero Accuracy", "Shots", 10), (1, 7, 120, "Enemy Hero Accuracy", "Shots", 40), (1, 7, 120, "Enemy Hero Accuracy", "Hits", 20), (1, 7, 120, "Enemy Hero Accuracy - Incoming", "Shots", 30), (1, 7, 120, "Enemy Hero Accuracy - Incoming", "Hits", 3), (1, 7, 120, None, "Parry Success", 2), (1, 7, 120, "Other", "Parry Success", 9), (1, 7, 120, None, "Parry Miss", 6)],
            "match_id long, account_id long, time_stamp_s long, group string, stat string, value long",
        ),
        "damage": spark.createDataFrame([(1, 7, 20, "citadel_weapon_x", "damage", 500), (1, 7, None, "citadel_weapon_x", "damage", 900), (1, 7, 20, "Bullet", "damage", 500)], "match_id long, account_id long, target_account_id long, source_class string, stat string, damage long"),
    }
    context = Context(spark, tables.__getitem__)
    got = summarize(context, registry.build("combat_games", hero=3), (), ["games", "shots", "hits", "incoming_shots", "incoming_hit_rate", "parries", "missed_parries_per_game", "gun_damage", "gun_damage_per_hit", "hit_rate"]).first()
    assert tuple(got) == (2, 40, 20, 30, 10.0, 2, 3.0, 500, 25.0, 50.0)
    totals = listings.combat_totals(views.combat_game_rows(context.table, 3), ["account_id"]).first()
    assert (totals.games, totals.shots_per_game, totals.hit_percent, totals.incoming_hit_percent, totals.parry_percent, totals.headshot_percent) == (2, 20.0, 50.0, 10.0, 25.0, 0.0)


def test_alternate_guns(spark):
    guns = spark.createDataFrame([("g", 8.0, 4.0, 60.0, 12.0, 30.0), ("h", 0.0, 1.0, 1.0, 1.0, 1.0), ("i", 5.0, None, None, None, None)], "ability_class string, bullet_damage double, bullets double, damage_per_second double, bullets_per_second double, clip_size double")
    assert rows(levels.alternate_gun(guns), "ability_class", "bullet", "dps", "shots_per_second", "ammo") == [("g", 8.0, 60.0, 3.0, 30.0), ("i", 5.0, 0.0, 0.0, 0.0)]


def test_a_total_that_falls_counts_as_its_last_sample(spark):
    samples = spark.createDataFrame([(1, 100, 50), (1, 200, 30), (1, 400, 45)], "m int, t int, worth int")
    games = spark.createDataFrame([(1, 500)], "m int, duration_s int")
    events = spark.createDataFrame([(1, 150, "kills")], "m int, t int, kind string")
    out = timeline.match_intervals(samples, events, games, ["m"], "t", ["worth"], ["kills"], 300)
    assert rows(out, "interval", "end_s", "worth", "kills", "per_min") == [(0, 300, 30, 1, 6.0), (1, 500, 15, 0, 4.5)]
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()


def test_income_sources_keep_their_last_sample(spark):
    tables = {
        "soul_sources": spark.createDataFrame([(1, 7, 2, 60, 100, 0), (1, 7, 3, 90, 40, 10), (1, 7, 2, 240, 160, 0), (1, 7, 1, 240, 999, 0)], "match_id long, account_id long, source long, time_stamp_s long, souls long, souls_orbs long"),
        "players": spark.createDataFrame([(1, 7)], "match_id long, account_id long"), "matches": spark.createDataFrame([(1, 600)], "match_id long, duration_s long"),
    }
    context = Context(spark, tables.__getitem__)
    marks = summarize(context, registry.build("cumulative_marks", stat="farm", marks=(60, 120, 300)), "mark_s", "mean")
    assert rows(marks) == [(120, 150.0), (300, 210.0), (60, 100.0)]
    gained = summarize(context, registry.build("compare_intervals", stat="farm", width=120), "interval", "total_gain")
    assert rows(gained) == [(0, 150), (1, 60), (2, 0), (3, 0), (4, 0)]


def test_names_of_modes_and_groups(spark):
    got = spark.range(1).select(labels.match_mode_name(F.lit(4)), labels.game_mode_name(F.lit(4)), labels.match_mode_name(F.lit(99)), labels.soul_group(F.lit(3)), labels.soul_group(F.lit(13))).first()
    assert tuple(got) == ("Ranked", "Street Brawl", None, "roaming", None)
    assert labels.composite_sources("combat") == [1, 6]


def test_a_store_is_mended_and_brought_up_to_date(spark, tables, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(upkeep, "rebuild", lambda store, docs, **names: calls.append("rebuild"))
    monkeypatch.setattr(upkeep, "reexport", lambda store, docs, ids, **names: calls.append(sorted(r.match_id for r in ids.collect())))
    monkeypatch.setattr(upkeep, "fill_missing", lambda store: calls.append("fill"))
    store = Store(spark, str(tmp_path / "store"))
    for name, df in tables.items():
        store.upsert(name, df.where("match_id = 1"))
    docs = tables["matches"].select("match_id")
    upkeep.export_new(store, docs)
    assert calls == [[2], "fill"]
    month = next(d for d in os.listdir(store.path("players")) if d.startswith("month="))
    copy = str(tmp_path / "copy")
    spark.read.parquet(f"{store.path('players')}/{month}").withColumn("extra", F.lit(1)).write.parquet(copy)
    spark.read.parquet(copy).write.mode("overwrite").parquet(f"{store.path('players')}/{month}")
    calls.clear()
    upkeep.export_new(store, docs)
    assert calls == [[2], "fill"] and store.drift("players") is None  # rewritten from itself
    spark.read.parquet(copy).drop("kills").write.mode("overwrite").parquet(f"{store.path('players')}/{month}")
    calls.clear()
    upkeep.export_new(store, docs)
    assert calls == ["rebuild"]


# Work that grows with the tables


def test_nearby_on_a_line_is_the_join_without_its_pairs(spark):
    import random

    rng = random.Random(3)
    value = lambda: rng.choice([None, float("nan"), float("inf"), *(rng.randrange(-4500, 4500) / 100 for _ in range(30))])
    some = [(i, rng.choice([None, 1, 1, 2]), rng.choice([None, *range(9)]), value(), rng.choice([None, 0, 1])) for i in range(900)]
    edges = [(1000 + i, 3, i, x, i % 2) for i, x in enumerate([29.27, 9.27, 49.27, 49.28, -10.73, 0.1, 20.1, 20.3, 0.3, 40.1, 1e-300, 20.0, -0.0])]
    places = spark.createDataFrame([*some, *edges, (5000, 1, 3, 1.0, 1), (5000, 1, 3, 1.0, 1)], "event_id long, hour int, who int, at double, team int")
    died = places.where("event_id % 2 = 0")
    near = (F.col("other") != F.col("who")) & (F.abs(F.col("place") - F.col("at")) <= 20)
    others = places.select("hour", F.col("who").alias("other"), F.col("at").alias("place"), F.col("team").alias("side"))
    want = records.nearby(died, others, ["hour"], "team", "side", near)
    out = records.nearby_on_line(died, places, ["hour"], "who", "at", "team", 20)
    assert out.columns == want.columns
    assert list(map(repr, rows(out))) == list(map(repr, rows(want)))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_synergies_lay_pairs_out_of_one_row_per_build(spark):
    table = [(1, "a", True), (1, "b", True), (1, "b", True), (2, "a", False), (2, "b", False), (3, "a", True), (3, "c", True), (None, "a", True), (None, "c", True), (4, None, True), (4, "a", False)]
    out = items.synergies(spark.createDataFrame(table, "b int, i string, won boolean"), ["b"], "i", F.col("won"), 1)
    assert rows(out, "item", "other", "matches", "wins", "solo", "lead", "place") == [("a", "b", 2, 1, 60.0, -10.0, 2), ("a", "c", 1, 1, 60.0, 40.0, 1), ("b", "a", 2, 1, 50.0, 0.0, 1), ("c", "a", 1, 1, 100.0, 0.0, 1)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_builds_are_dealt_over_many_tasks(spark):
    from tallyforge.functions.frames import LEAST_TASKS
    from tallyforge.queries import builds

    assert builds(spark, "/root/testdata/sf0.001").select("l_orderkey", "p_brand", "o_orderstatus").distinct().rdd.getNumPartitions() >= LEAST_TASKS


def test_item_core_hashes_builds_in_many_tasks(spark):
    from tallyforge import report_queries

    plan = report_queries.item_core(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in x]
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)


def test_source_intervals_lay_gains_out_without_sorting_them(spark):
    games = spark.createDataFrame([(1, 7, 45), (2, 7, 5)], "match_id int, account_id int, duration_s int")
    table = [(1, "a", 5, 3), (1, "a", 12, 9), (1, "a", 25, 7), (1, "a", 99, 20), (1, "b", 15, -4), (1, "b", 35, 2), (1, "c", 3, None), (2, "a", 4, 6), (3, "a", 1, 1)]
    samples = spark.createDataFrame([(m, 7, *r) for m, *r in table], "match_id int, account_id int, source string, t int, total int")
    out = timeline.source_intervals(samples, games, KEYS, ["source"], "t", "total", 10)
    got = {}
    for m, source, i, full, gain in sorted(tuple(r) for r in out.select("match_id", "source", "interval", "full", "total").collect()):
        got.setdefault((m, source), []).append((i, full, gain))
    whole = [True] * 4 + [False]
    laid = lambda *gains: [(i, whole[i], g) for i, g in enumerate(gains)]
    assert got == {(1, "a"): laid(3, 6, 0, 0, 11), (1, "b"): laid(0, -4, 0, 6, 0), (1, "c"): laid(0, 0, 0, 0, 0), (2, "a"): [(0, False, 6)]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "REPARTITION_BY_NUM" in plan


def test_damage_intervals_sort_only_for_running_totals_and_their_sum(spark):
    from tallyforge import report_queries

    plan = report_queries.damage_intervals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and "REPARTITION_BY_NUM" in plan


def test_group_intervals_lay_out_what_was_summed_and_deal_games_too(spark):
    games = spark.createDataFrame([(1, 7, 45), (1, 7, 45), (2, 7, 5), (4, 7, 30)], "match_id int, account_id int, duration_s int").groupBy(*KEYS).agg(F.max("duration_s").alias("duration_s"))
    table = [(1, "a", 12, 9), (1, "a", 35, 7), (1, "b", 15, 2), (1, "b", 35, 4), (1, "x", 5, 3), (1, "y", 8, -3), (1, None, 3, 1), (1, None, 99, 2), (2, "a", 4, 6), (3, "a", 1, 1), (4, "b", 3, None), (4, "a", None, 8)]
    samples = spark.createDataFrame([(m, 7, *r) for m, *r in table], "match_id int, account_id int, source string, t int, total int")
    group = F.when(F.col("source").isin("a", "b"), "ab").when(F.col("source").isin("x", "y"), "xy")
    out = timeline.group_intervals(samples.withColumnRenamed("total", "gained"), games, KEYS, ["source"], group, "group", "t", "gained", 10)
    laid = lambda m, name, total, *gains: [(m, name, i, g, total) for i, g in enumerate(gains)]
    want = [*laid(1, None, 2, 1, 0, 0, 0, 1), *laid(1, "ab", 13, 0, 11, 0, 2, 0), *laid(2, "ab", 6, 6), *laid(4, "ab", 8, 8, 0, 0)]
    assert sorted(map(repr, map(tuple, out.select("match_id", "group", "interval", "gained", "total").collect()))) == sorted(map(repr, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window [") and plan.count("REPARTITION_BY_NUM") == 2


def test_asof_join_sends_no_table_through_the_driver(spark):
    frame = times(spark.createDataFrame([(1, "2024-01-05"), (1, "2023-01-01"), (2, "2024-01-05")], "k int, at string"), "at")
    dim = times(spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-01-04", 2)], "k int, era_from string, v int"), "era_from")
    out = eras.asof_join(frame, dim, ["k"], "at", ["v"])
    assert rows(out, "k", "v") == [(1, 1), (1, 2), (2, None)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
