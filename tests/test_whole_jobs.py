"""Registered queries do the whole job."""

import pytest

from flowlens.operators import ml
from flowlens.plans import flow_queries, registry, report_queries  # noqa: F401
from flowlens.plans.fixtures import Tables

from .conftest import SF


def test_every_order_is_a_run(spark):
    t = Tables(spark, SF)
    assert t.runs().count() == t.table("orders").count() > 0


def test_every_run_has_a_history(spark):
    t = Tables(spark, SF)
    assert registry.QUERIES["r07_loss_by_seed"](spark, SF).select("experiment", "seed").distinct().count() == t.runs().count()


def test_early_stop_reads_no_further_than_it_must(spark):
    # the best value rises at the last moment each time; what follows a stop is not read
    rows = [("p", 0, i, min(i // 10, 30) * 0.001) for i in range(5_000)] + [("q", 1, i, 0.01) for i in range(3)]
    out = {r["seed"]: tuple(r)[2:] for r in report_queries.early_stop(spark.createDataFrame(rows, "experiment string, seed long, epoch int, v double")).collect()}
    assert out == {0: (300, 0.03, 310), 1: (0, 0.01, None)}


def test_models_train_at_the_operators_size(spark, monkeypatch):
    class Seen(Exception):
        pass

    def forest(train, trees=ml.TREES, depth=ml.DEPTH, y="y", subset="auto"):
        raise Seen(trees, depth)

    def net(train, inputs=32, rounds=50, y="y"):
        raise Seen(rounds)

    monkeypatch.setattr(ml, "train_forest", forest)
    monkeypatch.setattr(ml, "train_edge_mlp", net)
    for name in ("m01_train_forest", "m02_feature_importance", "m03_score_flows", "m05_train_context_forest", "k03_top_importances", "m04_train_edge_mlp"):
        with pytest.raises(Seen) as seen:
            registry.QUERIES[name](spark, SF)
        assert seen.value.args == ((50,) if name[:3] == "m04" else (100, 15))
