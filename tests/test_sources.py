"""Normalisation of a small match document, and the store's upserts."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyforge.schemas import FACTS, TABLES
from tallyforge.sources.matches import MATCH, movement_intervals, normalize, one_body_each, read_documents, with_accounts
from tallyforge.sources.store import Store, conform, describe
from tallyforge.streaming.ingest import ingest


def player(slot, account, team, hero, **more):
    return {"player_slot": slot, "account_id": account, "team": team, "hero_id": hero, "kills": slot, "net_worth": 1000 * slot, "abandon_match_time_s": 0} | more


def document(match_id=1, start=1_700_000_000):
    stats = [{"time_stamp_s": t, "net_worth": t * 2, "gold_player": t, "gold_sources": [{"source": 1, "gold": t, "gold_orbs": 5}], "custom_user_stats": [{"id": 7, "value": t}, {"id": 8, "value": 1}, {"id": 9, "value": 1}]} for t in (300, 600)]
    return {
        "match_id": match_id, "start_time": start, "duration_s": 610, "winning_team": 1, "match_mode": 1, "game_mode": 1, "not_scored": False,
        "players": [
            player(1, 11, 0, 101, stats=stats, items=[{"game_time_s": 5, "item_id": 50, "sold_time_s": 0, "flags": 0}], death_details=[{"game_time_s": 70, "killer_player_slot": 2, "death_pos": {"x": 1, "y": 2, "z": 3}}], hero_xp_rewards=[{"xp_grant": {"hero_id": 101, "xp_grant": 9, "reason": 2}}, {}]),
            player(2, 22, 1, 102, player_match_outcome=2, abandon_match_time_s=44, power_up_buffs=[{"type": "gun_lv2", "value": 2, "is_permanent": True}]),
        ],
        "objectives": [{"team": 0, "team_objective_id": 3, "destroyed_time_s": 0}], "mid_boss": [{"team_killed": 1, "team_claimed": 0, "destroyed_time_s": 600}],
        "custom_user_stats": [{"id": 7, "name": "Aim##Shots"}, {"id": 8, "name": "Plain"}],
        "damage_matrix": {"sample_time_s": [300, 600, 610], "source_details": {"source_name": ["Bullet", "fire"], "stat_type": [0, 1]}, "damage_dealers": [{"dealer_player_slot": 1, "damage_sources": [{"source_details_index": 1, "damage_to_players": [{"target_player_slot": 2, "damage": [10, 30]}, {"target_player_slot": 99, "damage": [1, 2, 3]}, {"target_player_slot": 2, "damage": []}]}]}]},
        "match_paths": {"interval_s": 1.0, "x_resolution": 10, "y_resolution": 10, "paths": [{"player_slot": 1, "x_min": 0, "x_max": 1000, "y_min": 0, "y_max": 1000, "x_pos": [0, 1, 2, 2], "y_pos": [0, 0, 0, 0], "health": [100, 100, 100, 100], "combat_type": [0, 0, 0, 1], "move_type": [0, 1, 1, 0]}]},
    }


@pytest.fixture
def docs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(document()) + "\n" + json.dumps(document(2, 1_703_000_000)))
    return read_documents(spark, str(tmp_path / "in"))


def test_tables_have_the_declared_columns(docs):
    tables = normalize(docs, stat_names={1: "spirit"}, move_names={0: "normal", 1: "ground_dash"}, combat_names={0: "out_of_combat", 1: "player"})
    assert set(tables) == set(FACTS) - {"downloads"}
    for name, df in tables.items():
        conform(df, TABLES[name])
    one = {n: [r.asDict() for r in df.where("match_id = 1").collect()] for n, df in tables.items()}
    first, second = sorted(one["players"], key=lambda r: r["account_id"])
    assert (first["won"], second["won"], second["abandon_time_s"], first["abandon_time_s"]) == (False, False, 44, None)
    assert [(r["time_stamp_s"], r["souls_player"]) for r in one["stats"]] == [(300, 300), (600, 600)]
    assert {(r["group"], r["stat"]) for r in one["custom_stats"]} == {("Aim", "Shots"), (None, "Plain")}
    assert sorted((r["target_account_id"] or 0, r["damage"]) for r in one["damage"]) == [(0, 3), (22, 30)] and one["damage"][0]["stat"] == "spirit"
    assert sorted((r["vs_heroes"], r["time_stamp_s"], r["damage"]) for r in one["damage_sources"]) == [(False, 300, 1), (False, 600, 2), (False, 610, 3), (True, 600, 10), (True, 610, 30)]
    assert one["deaths"][0]["killer_account_id"] == 22 and one["deaths"][0]["z"] == 3 and one["deaths"][0]["killer_x"] is None
    assert one["objectives"][0]["destroyed_time_s"] is None and len(one["hero_xp_rewards"]) == 1
    (minute,) = one["movement_intervals"]
    assert (minute["alive_s"], minute["moving_s"], minute["stationary_s"], minute["dashes"], minute["distance"], minute["combat_s"]) == (4, 3, 1, 1, 200.0, 1)
    assert with_accounts(docs, [22]).count() == 2 and with_accounts(docs, [5]).count() == 0


def test_upsert_twice_is_once(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert not store.exists("players") and store.drift("players") == "players is missing"
    players = normalize(docs)["players"]
    for _ in range(2):
        store.upsert("players", players)
    assert store.scan("players").count() == 4 and store.drift("players") is None
    store.upsert("players", players.where("match_id = 1").limit(1))
    assert store.scan("players").count() == 3
    assert {r.month for r in store.scan("players").select("month").collect()} == {"2023-11", "2023-12"}
    store.upsert("matches", normalize(docs.where("match_id = 1"))["matches"])
    assert [r.match_id for r in store.new_only(docs).collect()] == [2]
    with pytest.raises(KeyError):
        store.scan("nothing")
    with pytest.raises(ValueError):
        conform(players.drop("team"), TABLES["players"])


def test_tables_are_described(spark):
    rows = describe(spark, "players").orderBy("position").collect()
    assert [r.column for r in rows] == TABLES["players"].names and [r.column for r in rows if r.key] == ["match_id", "account_id"]
    assert {r.column: (r.type, r.description) for r in rows}["abandon_time_s"] == ("bigint", "second at which the player left, null if they stayed")
    assert describe(spark).count() == sum(map(len, TABLES.values())) and describe(spark).where("description = ''").count() == 0
    with pytest.raises(KeyError):
        describe(spark, "nothing")


def test_streaming_ingest(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "live"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination(120)
    assert store.counts()["players"] == 4


def test_movement_intervals_rules(spark):
    rows = [(1, None, 11, 101, t, x, 0.0, 100, combat, move) for t, x, combat, move in ((0, 0.0, "player", "ground_dash"), (1, 100.0, "player", "normal"), (2, 110.0, "creep", "ground_dash"), (4, 500.0, None, "normal"), (5, 4000.0, None, "normal"), (6, 4100.0, None, "ziplining"))]
    (got,) = movement_intervals(spark.createDataFrame(rows, TABLES["movement"])).collect()
    assert (got.alive_s, got.moving_s, got.stationary_s, got.combat_s, got.dashes, got.zipline_s, got.distance) == (6, 2, 1, 2, 1, 1, 110.0)


def test_imbued_zero_is_null_and_odd_paths(spark, tmp_path):
    doc = document()
    doc["players"][0]["items"] = [{"game_time_s": 5, "item_id": 50, "imbued_ability_id": k} for k in (0, 9)]
    doc["match_paths"] |= {"interval_s": None, "x_resolution": 0}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    tables = normalize(read_documents(spark, str(tmp_path)))
    assert sorted(r.imbued_ability_id or 0 for r in tables["item_events"].collect()) == [0, 9] and tables["item_events"].where("imbued_ability_id is null").count() == 1
    assert [(r.game_time_s, r.x) for r in tables["movement"].orderBy("game_time_s").collect()] == [(k, 0.0) for k in range(4)]


def test_drifted_target_is_refused(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "drift"))
    players = normalize(docs)["players"]
    store.upsert("players", players)
    store.scan("players").withColumn("more", F.lit(1)).write.mode("append").partitionBy("month").parquet(store.path("players"))
    with pytest.raises(ValueError):
        store.upsert("players", players)


def test_bodies(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (2, 0, "c")], "match_id long, salt long, name string")
    assert sorted(r.name for r in one_body_each(rows).collect()) == ["b", "c"]


def test_empty_documents(spark):
    for df in normalize(spark.createDataFrame([], MATCH)).values():
        assert df.count() == 0
    assert movement_intervals(spark.createDataFrame([], TABLES["movement"])).count() == 0
    assert datetime.now(timezone.utc)
