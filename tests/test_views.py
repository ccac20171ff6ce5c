"""The registry, and every registered view over a store made of two small documents."""

import json

import pytest

from tallyforge.plans import registry, views
from tallyforge.plans.metrics import Context, Measure, MetricView, Series, summarize, validate_view
from tallyforge.sources.matches import normalize, read_documents

from .test_sources import document

GIVEN = {"record_games": {"account": 11}}


@pytest.fixture(scope="module")
def context(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "a.json").write_text(json.dumps(document()) + "\n" + json.dumps(document(2, 1_703_000_000)))
    tables = normalize(read_documents(spark, str(folder)))
    return Context(spark, {name: df.cache() for name, df in tables.items()}.__getitem__)


def test_thirteen_views():
    assert len(registry.VIEWS) == 13 and set(GIVEN) <= set(registry.VIEWS)


@pytest.mark.parametrize("name", sorted(registry.VIEWS))
def test_view_resolves(context, name):
    made = registry.build(name, **GIVEN.get(name, {}))
    validate_view(context, made)
    assert summarize(context, made, (), "games").count() == 1


def test_views_give_the_documents_figures(context):
    one = lambda name, by, measures, **given: {r[0]: tuple(r)[1:] for r in summarize(context, registry.build(name, **given), by, measures).collect()}
    assert one("my_games", "account", ["games", "kills", "win_rate"], accounts=[22]) == {22: (2, 4, 0.0)}
    assert one("stat_snapshots", "account", ["games", "net_worth"]) == {11: (2, 2400)}
    assert one("soul_source_games", "source", ["souls", "secured_orbs", "games"]) == {1: (1210, 10, 2)}
    assert one("damage_source_games", "source", ["total", "games", "minutes", "items"], stat="healing") == {"fire": (60, 2, 2 * 610 / 60, 0)}
    assert one("combat_games", "account", ["games", "shots", "hit_rate"]) == {11: (2, 0, None), 22: (2, 0, None)}
    assert one("stack_games", "name", "games") == {}
    assert one("compare_intervals", "interval", ["total_gain"], stat="farm", width=300) == {}
    assert one("compare_intervals", "interval", ["total_gain"], stat="combat", width=300) == {0: (610,), 1: (600,)}
    assert one("compare_intervals", "interval", ["total_gain"], stat="kills", width=300) == {0: (2,), 1: (0,)}
    assert one("compare_intervals", "account", ["total_gain"], stat="deaths", width=300) == {11: (2,), 22: (0,)}
    assert one("cumulative_marks", "mark_s", ["games", "mean"], stat="combat", marks=(360, 600)) == {360: (4, 152.5), 600: (4, 302.5)}
    assert one("milestone_games", "target", ["games", "minutes"], stat="combat", targets=(305, 455)) == {305.0: (2, 5.0), 455.0: (2, 7.5)}
    assert one("buff_games", "type", ["held", "games"]) == {"gun_lv2": (4, 2)}
    assert one("cumulative_marks", "mark_s", ["games", "mean"], marks=(360, 600))[360] == (4, 300.0)
    assert one("compare_intervals", "interval", ["total_gain"], width=300) == {0: (1200,), 1: (1200,)}


def test_registry_refuses():
    with pytest.raises(KeyError):
        registry.build("nothing")
    with pytest.raises(TypeError):
        registry.build("my_games", nobody=1)
    with pytest.raises(TypeError):
        registry.build("record_games")
    with pytest.raises(ValueError):
        registry.view(views.my_games)
    assert list(registry.parameters("cumulative_marks")) == ["stat", "marks"]
    mixed = MetricView("mixed", "stats", {}, {"a": Measure(lambda c: c["x"], cumulative_over=("day",))}, series=Series(("k",), "t"))
    with pytest.raises(ValueError):
        registry.check_windows(mixed)
