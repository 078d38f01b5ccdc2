"""The forest over wide vectors (``operators/forest.py``)."""

import numpy as np

from flowlens.operators import forest, ml

SIZE = 12


def flows(spark, n=3_000):
    rng = np.random.default_rng(5)
    x = rng.random((n, SIZE)).round(2)
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.3) | (rng.random(n) < 0.1)).astype(int)
    rows = [([None if v == 0 else float(v) for v in r], int(k)) for r, k in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "features array<float>, y int").repartition(3)


def test_branches_grow_as_splits_over_all_tasks_would(spark, monkeypatch):
    """A tree is the same wherever its nodes are split, in whatever packs."""
    rows = flows(spark).localCheckpoint()
    monkeypatch.setattr(ml, "MultilayerPerceptronClassifier", None)
    monkeypatch.setattr(ml, "RandomForestClassifier", None)  # nothing of it is asked for a third of the features
    whole = ml.train_context_forest(rows, trees=4, depth=7)
    monkeypatch.setattr(forest, "SMALL", 40)
    monkeypatch.setattr(forest, "OPEN", 5)
    monkeypatch.setattr(forest, "SENT", 500)
    parts = ml.train_context_forest(rows, trees=4, depth=7)
    for k in ("feature", "cut", "share"):
        assert np.array_equal(getattr(whole, k), getattr(parts, k))
    assert (whole.feature[:, 64:128] >= 0).any() and (whole.feature[:, 128:] < 0).all()
    out = ml.score_flows(parts, rows).select("y", "Probability").toPandas()
    assert out.loc[out["y"] == 1, "Probability"].mean() > out.loc[out["y"] == 0, "Probability"].mean() + 0.2
    assert len(out) == 3_000 and out["Probability"].between(0, 1).all()


def test_split_of_least_impurity():
    rng = np.random.default_rng(6)
    n = rng.integers(0, 5, (1, forest.BINS, 2)).repeat(3, axis=0)
    for i in (1, 2):
        n[i] = n[i][rng.permutation(forest.BINS)]
    w = np.array([0.6, 3.0])

    def impurity(k):
        a, b = k * w
        return a * b / (a + b) if a + b else 0.0

    cost = {(i, j): impurity(f[: j + 1].sum(axis=0)) + impurity(f[j + 1 :].sum(axis=0)) for i, f in enumerate(n) for j in range(forest.BINS - 1) if 0 < f[: j + 1].sum() < f.sum()}
    i, j, left, right = forest.best_split(n.ravel(), w)
    assert np.isclose(cost[i, j], min(cost.values()))
    assert np.array_equal(left, n[i, : j + 1].sum(axis=0)) and np.array_equal(left + right, n[i].sum(axis=0))
    # two labels in one bin: no split
    one = np.zeros((2, forest.BINS, 2), int)
    one[:, 4] = 7
    assert forest.best_split(one.ravel(), w) is None


def test_degenerate_tables(spark):
    rows = spark.createDataFrame([([0.5, 1.0], 1)] * 5, "features array<float>, y int")
    assert {r[0] for r in ml.score_flows(ml.train_context_forest(rows, trees=2, depth=3), rows).select("Probability").collect()} == {1.0}
    # bagging draws each row once on average
    assert abs(forest.POISSON.mean() - 1) < 0.001 and abs((forest.POISSON == 0).mean() - np.exp(-1)) < 0.001


def test_blocks_stay_small(spark):
    """However many rows a task has, what readers, writers and batches count as a row is a few KB."""
    rows = flows(spark).selectExpr("transform(features, v -> coalesce(v, 0f)) AS features", "y AS label")
    cuts = forest.cut_points(rows, SIZE, 3_000)
    got = forest.blocks_of(rows, cuts).toArrow()
    sizes = [len(c) for c in got.column("codes").to_pylist()]
    assert max(sizes) <= 4_096 and sum(sizes) == 3_000 * SIZE
    chunks = list(forest.together(iter(got.to_batches()), SIZE))
    codes, numbers = (np.concatenate(x) for x in zip(*chunks, strict=True))
    assert len(set(numbers.tolist())) == 3_000
    table = rows.toPandas()
    want = 2 * forest.binned(np.stack(table["features"]), cuts) + table["label"].to_numpy("uint8")[:, None]
    assert sorted(map(bytes, codes)) == sorted(map(bytes, want))


def test_draws_go_by_the_number_of_a_row():
    numbers = np.concatenate([np.arange(50_000), (7 << 33) + np.arange(50_000)])
    some = np.random.default_rng(7).permutation(len(numbers))[:1_000]
    times = np.stack([forest.bag(42, t, numbers) for t in range(20)])
    assert all(np.array_equal(forest.bag(42, t, numbers[some]), times[t, some]) for t in range(20))
    # Poisson(1), and neither trees nor neighbours know of each other
    share = np.bincount(times.ravel(), minlength=4)[:4] / times.size
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.002)
    between = np.corrcoef(times)
    assert np.abs(between - np.eye(20)).max() < 0.02
    assert max(abs(np.corrcoef(t[1:], t[:-1])[0, 1]) for t in times) < 0.02
