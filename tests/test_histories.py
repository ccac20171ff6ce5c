"""Dimension tables from histories, changes of records, and the store's upkeep."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import levels
from tallyforge.schemas import FACTS, TABLES
from tallyforge.sources import histories, upkeep
from tallyforge.sources.matches import normalize, read_documents
from tallyforge.sources.store import Store
from tests.test_sources import document

ITEM = {"id": 5, "name": "Lamp", "class_name": "upgrade_lamp", "cost": 800, "slot": "spirit", "tier": 2, "components": ["upgrade_wick", "upgrade_oil"]}
HERO = {"id": 7, "name": "Ada", "levels": [{"level": 1}, {"level": 2, "required_souls": 400, "standard_upgrade": True}], "stats": {"max_health": 500, "odd": "much"}, "level_up": {"tech_power": 1.5}, "player_selectable": True}
ABILITY = {
    "class_name": "beam", "id": 9, "kind": "weapon", "properties": {"damage": 10, "range": 4.5}, "scaling": {"damage": {"stat": "tech_power", "scale": 0.5}, "speed": {"stat": "tech_power", "scale": 2}},
    "upgrades": [[{"property": "damage", "bonus": 5}], [], [{"property": "range", "bonus": 1}, {"property": "damage", "bonus": 2, "type": "multiply"}]], "weapon": {"bullet_damage": 12.5},
}


def history(spark, *rows):
    return spark.createDataFrame([(when, build, str(rid), json.dumps(rec)) for when, build, rid, rec in rows], "from string, build long, id string, record string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_item_tables(spark):
    out = histories.item_tables(history(spark, ("2026-01-02T00:00:00", 3, 5, ITEM), ("2026-02-01", 4, 6, {"id": 6, "is_active": True, "components": None})))
    assert {n: df.columns for n, df in out.items()} == {n: TABLES[n].names for n in out}
    assert rows(out["item_history"], "item_id", "name", "is_active", F.date_format("era_from", "yyyy-MM-dd HH"), "client_version") == [(5, "Lamp", False, "2026-01-02 00", 3), (6, None, True, "2026-02-01 00", 4)]
    assert rows(out["item_component_history"], "item_id", "position", "component_class_name") == [(5, 0, "upgrade_wick"), (5, 1, "upgrade_oil")]


def test_hero_tables(spark):
    out = histories.hero_tables(history(spark, ("2026-01-02T02:00:00+02:00", 3, 7, HERO)))
    assert rows(out["hero_history"], "hero_id", "player_selectable", "disabled", F.date_format("era_from", "HH")) == [(7, True, False, "00")]
    assert rows(out["hero_level_history"], "level", "required_souls", "standard_upgrade") == [(1, 0, False), (2, 400, True)]
    assert rows(out["hero_stat_history"], "stat", "value") == [("max_health", 500.0), ("odd", None)]
    assert rows(out["hero_level_up_history"], "stat", "per_level_value") == [("tech_power", 1.5)]


def test_ability_tables(spark):
    out = histories.ability_tables(history(spark, ("2026-01-02", 3, "beam", ABILITY), ("2026-01-02", 3, "hop", {"class_name": "hop", "id": 1, "kind": "ability"})))
    assert rows(out["ability_property_history"], "property", "value", "scale_stat", "scale") == [("damage", 10.0, "tech_power", 0.5), ("range", 4.5, None, None), ("speed", None, "tech_power", 2.0)]
    assert rows(out["ability_upgrade_history"], "tier", "property", "bonus", "type") == [(1, "damage", 5.0, None), (3, "damage", 2.0, "multiply"), (3, "range", 1.0, None)]
    assert rows(out["ability_weapon_history"], "ability_class", "bullet_damage", "range") == [("beam", 12.5, None)]
    assert out["ability_history"].count() == 2


def test_statues_and_ranks(spark):
    names = ["hp_permanent_pickup", "hp_permanent_pickup_lv3", "gun_powerup_pickup", "crate"]
    out = histories.statue_tables(history(spark, *(("2026-01-02", 1, n, {"class_name": n, "value": 2}) for n in names)))["statue_history"]
    assert rows(out, "class_name", "buff", "level") == [("crate", None, None), ("gun_powerup_pickup", "gun", None), ("hp_permanent_pickup", "hp", 1), ("hp_permanent_pickup_lv3", "hp", 3)]
    ranks = histories.rank_tables(history(spark, ("2026-01-01", 1, 0, {"tier": 0, "name": "None"}), ("2026-01-01", 1, 3, {"tier": 3, "name": "Old"}), ("2026-03-01", 2, 3, {"tier": 3, "name": "New"})))["rank_history"]
    games = spark.createDataFrame([(1, 34, "2025-01-01"), (2, 34, "2026-04-01"), (3, 0, "2026-04-01"), (4, 52, "2026-04-01"), (5, None, "2026-04-01")], "game int, badge int, d string").withColumn("at", F.col("d").cast("timestamp"))
    assert rows(levels.with_rank_label(games, ranks, "badge", "at"), "game", "rank") == [(1, "Old IV"), (2, "New IV"), (3, "None"), (4, "badge52"), (5, None)]
    assert rows(levels.least_badge(ranks.where("name = 'New'"), "new"), "badge") == [(31,)] and levels.least_badge(ranks, "x").count() == 0


def test_reading_a_history(spark):
    h = history(spark, ("2026-01-01", 1, "a", {"x": {"y": [1, "{2}"]}, "gone": True, "n": None}), ("2026-02-01", 2, "a", {"x": {"y": [1, "b", 3]}, "n": None}), ("2026-02-01", 2, "b", {"x": 1}), ("2026-03-01", 3, "a", {"x": {"y": [1, "b", 3]}}))
    assert rows(histories.era_list(h), "from", "build") == [("2026-01-01", 1), ("2026-02-01", 2), ("2026-03-01", 3)]
    assert rows(histories.records_asof(h, "2026-02-10"), "id", "build") == [("a", 2), ("b", 2)]
    assert rows(histories.records_asof(h, "2020-01-01"), "id", "build") == [("a", 1)]
    assert rows(histories.record_changes(h), "id", "build", "path", "old", "new") == [("a", 2, "gone", "true", None), ("a", 2, "x.y.1", "{2}", "b"), ("a", 2, "x.y.2", None, "3")]


@pytest.fixture
def docs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(document(i, s)) for i, s in ((1, 1_700_000_000), (2, 1_703_000_000))))
    return read_documents(spark, str(tmp_path / "in"))


def test_upkeep(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    upkeep.reexport(store, docs)
    before = store.counts()
    upkeep.reprice(store, docs, "2023-12-01")
    assert store.counts() == before and before["matches"] == 2
    # match 1 has no document any more, and the old table lacks a column
    spark.read.parquet(store.path("players")).drop("party").write.partitionBy("month").parquet(str(tmp_path / "narrow"))
    upkeep.take_place(store, str(tmp_path / "narrow"), "players")
    assert "party" in store.drift("players")
    upkeep.rebuild(store, docs.where("match_id = 2"))
    assert store.drift("players") is None and store.counts()["players"] == before["players"]
    assert all(store.exists(t) for t in FACTS if t != "downloads") and upkeep.fill_missing(store) == []
    assert upkeep.sample(store, "players", 1).count() == 1


def test_one_file_tables_move_into_months(spark, docs, tmp_path):
    first, tables = Store(spark, str(tmp_path / "first")), normalize(docs)
    for table in ("matches", "players"):
        first.upsert(table, tables[table])
    for table in ("matches", "players"):
        first.scan(table).drop("month").withColumn("unused", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/old/{table}.parquet")
    store = Store(spark, str(tmp_path / "store"))
    assert upkeep.migrate(store, f"{tmp_path}/old") == ["matches", "players"]
    assert rows(store.scan("players"), "match_id", "account_id", "month") == rows(first.scan("players"), "match_id", "account_id", "month")
    assert store.drift("players") is None


def test_second_store(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ledger = lambda *r: spark.createDataFrame([(m, a, "p", None, None, None, d) for m, a, d in r], "match_id long, account_id long, player string, hero_id long, rank long, region string, d string").withColumn("downloaded_at", F.col("d").cast("timestamp")).drop("d")
    assert upkeep.extend_from_ledger(store, ledger((1, 11, "2026-01-02")), docs.where("match_id = 1"))["matches"] == 1
    counts = upkeep.extend_from_ledger(store, ledger((1, 11, "2026-01-01"), (2, 11, "2026-01-03")), docs)
    assert (counts["matches"], counts["downloads"], counts["players"], counts["objectives"]) == (2, 2, 4, 2)
    assert rows(store.scan("downloads"), "match_id", F.date_format("downloaded_at", "dd")) == [(1, "01"), (2, "03")]


def test_dimensions_are_rewritten(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        assert histories.refresh(store, {"item": history(spark, ("2026-01-02", 3, 5, ITEM))}) == ["item_history", "item_component_history"]
    assert store.scan("item_component_history").count() == 2
