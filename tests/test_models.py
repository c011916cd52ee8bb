import pytest
from pyspark.sql import functions as F

from regimen.operators import metrics, models, solvers


@pytest.fixture(scope="module")
def planted(spark):
    d = spark.range(4000).select(
        (F.col("id") % 50 + 1).cast("double").alias("q"),
        ((F.col("id") * 7) % 11 / 100.0).alias("d"))
    return d.select("q", "d", F.when(F.col("q") > 25, 10.0).otherwise(2.0).alias("step"),
                    (3.0 * F.col("q") + 100.0 * F.col("d") + 1.0).alias("line"))


def max_err(df, label):
    return df.agg(F.max(F.abs(F.col("prediction") - F.col(label)))).first()[0]


def test_forest_recovers_step(spark, planted):
    m = models.random_forest(["q", "d"], "step", num_trees=10, max_bins=64).fit(planted)
    assert max_err(m.transform(planted), "step") == 0.0
    imp = {r.feature: r.importance for r in models.feature_importance(m, ["q", "d"], "rf").collect()}
    assert imp["q"] == 1.0 and imp["d"] == 0.0


def test_gbt_recovers_step(spark, planted):
    m = models.gbt(["q", "d"], "step", max_iter=5, max_bins=64).fit(planted)
    assert max_err(m.transform(planted), "step") == 0.0
    h = models.training_history_gbt(m, planted, "gbt").collect()
    assert len(h) == 5 and h[-1].loss == pytest.approx(0.0)


def test_svr_linear_within_tube(spark, planted):
    # with few rows the penalty still matters at C=1; a larger C makes the tube binding
    m = solvers.SVR(["q", "d"], "line", kernel="linear", C=100.0, epsilon=0.1).fit(planted)
    assert max_err(m.transform(planted), "line") <= 0.1 + 1e-3
    assert m.objective_trace[-1] <= m.objective_trace[0]


def test_svr_rbf_fits_step(spark, planted):
    m = solvers.SVR(["q", "d"], "step", kernel="rbf", n_components=64, max_iter=10).fit(planted)
    r = metrics.regression_metrics(m.transform(planted).withColumnRenamed("step", "label"), []).first()
    assert r.r2 > 0.8


def test_mlp_learns_and_keeps_history(spark, planted):
    d = planted.withColumn("v", F.col("d") == 0.0)
    m = solvers.MLPRegressor(["q", "d"], "line", hidden=(16, 8), learning_rate=0.01, epochs=40, patience=10,
                             validation_col="v").fit(d)
    h = m.history
    assert h[-1][1] < h[0][1]
    assert all(row[3] is not None for row in h)
    r = metrics.regression_metrics(m.transform(d).withColumnRenamed("line", "label"), []).first()
    assert r.r2 > 0.5


def test_mlp_single_partition_equals_numpy_epochs(spark):
    """With one partition the distributed epoch is exactly the local NumPy
    epoch (same seed, Adam state carried), so averaging/orchestration adds
    nothing but the row-weighted mean."""
    import numpy as np

    rows = [(float(i % 13), float(i % 5) / 10.0) for i in range(64)]
    df = spark.createDataFrame([(q, d, 2.0 * q - 3.0 * d + 1.0) for q, d in rows], "q double, d double, y double") \
        .coalesce(1)
    est = solvers.MLPRegressor(["q", "d"], "y", hidden=(4,), dropout=0.0, learning_rate=0.01, batch_size=8,
                               epochs=2, patience=None, seed=3, validation_size=0)
    model = est.fit(df)
    x = np.array(rows)
    y = 2.0 * x[:, 0] - 3.0 * x[:, 1] + 1.0
    xs = (x - x.mean(axis=0)) / x.std(axis=0)
    shapes = solvers._layer_shapes(2, [4])
    w = solvers._init_weights(shapes, 3)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    per_epoch = []
    for epoch in range(2):
        w, m, v, t, se, _ = solvers._local_epoch(w, m, v, t, xs, y, shapes, 0.01, 8, 0.0, 3 * 100003 + epoch * 1009)
        per_epoch.append((w.copy(), se / len(y)))
    assert [h[1] for h in model.history] == pytest.approx([p[1] for p in per_epoch], rel=1e-9)
    # the kept weights are those of the epoch with the lowest loss seen while training it
    expected = per_epoch[int(np.argmin([p[1] for p in per_epoch]))][0]
    assert np.allclose(model.weights, expected, rtol=1e-9, atol=1e-12)


def test_replicas_train_each_row_once_with_the_gradient_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(5)
    shapes = solvers._layer_shapes(3, (8, 4))
    w = solvers._init_weights(shapes, 1)
    x = rng.normal(size=(333, 3))
    y = x @ [3.0, 1.0, 0.0]
    state = [np.tile(z, (4, 1)) for z in (w, 0 * w, 0 * w)] + [np.zeros(4, int)]
    _, _, seen = solvers._replica_epoch(*state, x, y, shapes, 0.01, 32, 0.2, rng)
    assert seen.tolist() == [96, 96, 77, 64] and state[3].tolist() == [3, 3, 3, 2]

    def loss(q):
        return np.mean((solvers._forward(solvers._unflatten(q, shapes), x[:32])[0][-1][:, 0] - y[:32]) ** 2)

    m = np.zeros((1, len(w)))
    solvers._step(w[None].copy(), m, m.copy(), np.zeros(1, int), x[None, :32], y[None, :32], shapes, 0.01, 0.0, rng)
    numeric = [(loss(w + e) - loss(w - e)) / 2e-6 for e in 1e-6 * np.eye(len(w))]
    assert np.allclose(m[0] / 0.1, numeric, atol=1e-6)


def test_network_of_many_rows_trains_replicas(spark, monkeypatch):
    monkeypatch.setattr(solvers, "REPLICA_ROWS", 128)
    d = spark.range(4096).selectExpr("cast(id % 50 as double) q", "cast(id % 11 as double) d").selectExpr("*", "q - 2 * d AS y", "q = 7 AS v")
    m = solvers.MLPRegressor(["q", "d"], "y", hidden=(16, 8), dropout=0.1, learning_rate=0.01, epochs=15, validation_col="v").fit(d.coalesce(1))
    r = metrics.regression_metrics(m.transform(d).withColumnRenamed("y", "label"), []).first()
    assert r.r2 > 0.9


@pytest.mark.parametrize("hidden, dropout", [((8, 4), 0.0), ((8, 4), 0.3), ((7, 5, 3), 0.3), ((6,), 0.3)])
def test_single_precision_epoch_equals_the_plain_one(monkeypatch, hidden, dropout):
    import numpy as np

    rng, shapes, n = np.random.default_rng(0), solvers._layer_shapes(3, hidden), 333
    x = rng.normal(size=(n, 3))
    y = x @ [3.0, 1.0, 0.0] + 1
    w = np.tile(solvers._init_weights(shapes, 1), (4, 1)) + 0.01 * rng.normal(size=(4, sum((a + 1) * b for a, b in shapes)))
    keeps = [rng.random((n, b)) >= dropout for _, b in shapes[:-1]]
    asked = []

    class Given:
        """The same order of the rows and the same kept units for both."""

        def permutation(self, k):
            return np.random.default_rng(7).permutation(k)

        def random(self, shape):
            layer, first = len(asked) % len(keeps), sum(z[0] * z[1] for z in asked[::len(keeps)][:len(asked) // len(keeps)])
            asked.append(shape)
            return keeps[layer][first:first + shape[0] * shape[1]].reshape(shape).astype(float)

    monkeypatch.setattr(solvers, "_keeps", lambda *_: keeps)
    plain = [w.copy(), 0 * w, 0 * w, np.array([3, 3, 4, 3])]
    single = [z.astype(np.float32) for z in plain[:3]] + [plain[3].copy()]
    a = solvers._replica_epoch(*plain, x, y, shapes, 0.01, 32, dropout, Given())
    b = solvers._replica_epoch(*single, x.astype(np.float32), y.astype(np.float32), shapes, 0.01, 32, dropout, Given())
    assert a[:2] == pytest.approx(b[:2], rel=1e-5) and a[2].tolist() == b[2].tolist() == [96, 96, 77, 64]
    assert single[0].dtype == np.float32 and all(np.allclose(p, q, atol=1e-5) for p, q in zip(plain, single))


def test_dropped_units_are_as_many_as_asked_for():
    import numpy as np

    keeps = solvers._keeps(np.random.default_rng(3), 10_001, [(3, 64), (64, 33), (33, 1)], 0.2)
    assert [k.shape for k in keeps] == [(10_001, 64), (10_001, 33)]
    assert [k.mean() for k in keeps] == pytest.approx([0.8, 0.8], abs=0.003)


def test_large_network_trains_every_row_in_no_more_tasks_than_cores(spark, monkeypatch):
    monkeypatch.setattr(solvers, "REPLICA_ROWS", 64)
    monkeypatch.setattr(solvers, "SINGLE_BLOCK", 128)
    cores = spark.sparkContext.defaultParallelism
    d = spark.range(9000).selectExpr("cast(id % 50 as double) q", "cast(id % 11 as double) d").selectExpr("*", "q - 2 * d AS y", "q = 7 AS v")
    seen, plain = [], solvers._epoch_sums

    def spy(table, width, replicas, *args, **kw):
        sums = plain(table, width, replicas, *args, **kw)
        seen.append((table.rdd.getNumPartitions(), replicas, *(round(sums[0][i]) for i in (0, 3))))
        return sums

    monkeypatch.setattr(solvers, "_epoch_sums", spy)
    m = solvers.MLPRegressor(["q", "d"], "y", hidden=(8, 4), dropout=0.1, learning_rate=0.01, epochs=2, validation_col="v").fit(
        d.repartition(3 * cores))
    assert [s[0] for s in seen] == [cores] * 3 and [s[1] for s in seen] == [min(solvers.REPLICAS, 9000 // (64 * cores))] * 3
    assert [s[2:] for s in seen] == [(8820, 180), (8820, 180), (0, 180)]
    assert [h[0] for h in m.history] == [1, 2] and m.history[1][1] < m.history[0][1]


def test_svr_of_equal_rows_equals_that_of_the_rows(spark, monkeypatch):
    import numpy as np

    from regimen.operators import svr
    d = spark.range(3000).selectExpr("cast(id % 20 as double) a", "cast(id % 7 as double) b").selectExpr("*", "a * b + a AS y")
    for kernel in ("linear", "poly", "rbf"):
        est = solvers.SVR(["a", "b"], "y", kernel=kernel, C=10.0, max_iter=4, tol=0.0, n_components=200, degree=2)
        sizes, own = [], svr.irls
        monkeypatch.setattr(svr, "irls", lambda table, *args: (sizes.append(table.count()), own(table, *args)))
        grouped = est.fit(d)
        monkeypatch.setattr(svr, "EQUAL_ROWS", 10**9)
        alone = est.fit(d)
        monkeypatch.undo()
        assert sizes == [140, 3000]
        assert np.allclose(grouped.objective_trace, alone.objective_trace, rtol=1e-6)
        both = [m.transform(d.distinct()).orderBy("a", "b").toPandas()["prediction"] for m in (grouped, alone)]
        assert np.allclose(*both, atol=1e-4)


def test_svr_irls_rounds_equal_numpy(spark):
    """Each IRLS round is the exact weighted ridge solve of
    0.5|w|^2 + 0.5 sum q (t - Xw - b)^2 (intercept unpenalised)."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1.5 * x[:, 0] - 0.5 * x[:, 1] + 0.3 + rng.normal(scale=0.3, size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = solvers.SVR(["a", "b"], "y", kernel="linear", C=1.0, epsilon=0.1, max_iter=3, tol=0.0).fit(df)
    xs = (x - x.mean(axis=0)) / x.std(axis=0)
    w, b = np.zeros(2), 0.0
    for _ in range(3):
        e = y - (xs @ w + b)
        i1 = 1.0 / np.maximum(np.abs(e - 0.1), 0.01)
        i2 = 1.0 / np.maximum(np.abs(e + 0.1), 0.01)
        q = 0.5 * (i1 + i2)
        t = y - 0.1 * (i1 - i2) / (i1 + i2)
        a = np.zeros((3, 3))
        a[:2, :2] = xs.T @ (q[:, None] * xs) + np.eye(2)
        a[:2, 2] = a[2, :2] = xs.T @ q
        a[2, 2] = q.sum()
        sol = np.linalg.solve(a, np.concatenate([xs.T @ (q * t), [q @ t]]))
        w, b = sol[:2], sol[2]
    assert np.allclose(m.coef, w, rtol=1e-6, atol=1e-8)
    assert m.intercept == pytest.approx(b, rel=1e-6, abs=1e-8)


def exact_kernel_svr(x, y, kernel, C, eps, rounds=60, delta=0.01):
    """The same objective over the exact kernel matrix (NumPy): f = K a + b with penalty a' K a / 2."""
    import numpy as np

    k = kernel(x, x)
    n = len(y)
    a, b = np.zeros(n), 0.0
    for _ in range(rounds):
        e = y - (k @ a + b)
        i1, i2 = 1 / np.maximum(abs(e - eps), delta), 1 / np.maximum(abs(e + eps), delta)
        q, t = C / 2 * (i1 + i2), y - eps * (i1 - i2) / (i1 + i2)
        left = np.block([[k + np.diag(1 / q), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        sol = np.linalg.solve(left, np.append(t, 0.0))
        a, b = sol[:n], sol[n]
    return k @ a + b


def test_svr_rbf_close_to_the_exact_kernel(spark):
    import numpy as np

    from regimen.operators.svr import rbf

    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + r.normal(scale=0.1, size=400)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    xs = (x - x.mean(0)) / x.std(0)
    exact = exact_kernel_svr(xs, y, lambda p, q: rbf(p, q, 1 / 3), 1.0, 0.1)
    want = 1 - ((y - exact) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    m = solvers.SVR(["a", "b", "c"], "y", kernel="rbf", max_iter=60, tol=1e-5).fit(df)   # 256 landmarks
    got = metrics.regression_metrics(m.transform(df).withColumnRenamed("y", "label"), []).first().r2
    assert abs(got - want) < 0.02
    assert len(m.landmarks) <= 256


def test_svr_handles_missing_values(spark):
    rows = [(float(i), float(i % 5), 2.0 * i) for i in range(50)] + [(None, 1.0, 3.0), (float("nan"), 1.0, 3.0), (4.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    for kernel in ("linear", "poly", "rbf"):
        m = solvers.SVR(["a", "b"], "y", kernel=kernel, C=10.0, n_components=16, degree=2).fit(df)
        out = m.transform(df).collect()
        assert sum(r.prediction is not None and r.prediction == r.prediction for r in out) == 51
    empty = solvers.SVR(["a", "b"], "y", kernel="linear").fit(df.where("false"))
    assert empty.transform(df).first().prediction == 0.0


def test_svr_grid_equals_single_fits(spark):
    """Every point and fold of the shared passes is the fit that SVR makes alone."""
    import numpy as np

    from regimen.operators import svr

    r = np.random.default_rng(3)
    x = r.normal(size=(120, 2))
    y = np.cos(x[:, 0]) + x[:, 1]
    df = spark.createDataFrame([(i % 3, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "fold int, a double, b double, y double").coalesce(2)
    points = [{"kernel": "rbf", "C": 1.0, "gamma": "scale"}, {"kernel": "rbf", "C": 1.0, "gamma": "auto"}, {"kernel": "linear", "C": 0.1},
              {"kernel": "rbf", "C": 10.0, "gamma": 0.3}, {"kernel": "poly", "C": 1.0, "degree": 2}]
    rows = svr.grid_fold_scores(df, points, ["a", "b"], "y", 3, n_components=200)
    got = {(gi, f): s for gi, f, _, s in rows}
    assert len(rows) == 15 and all(n == 40 for _, _, n, _ in rows)
    assert all(got[0, f] == got[1, f] for f in range(3))
    for gi, f in ((2, 0), (4, 1), (3, 2), (0, 1)):
        m = svr.SVR(["a", "b"], "y", n_components=200, **points[gi]).fit(df.where(f"fold != {f}"))
        alone = metrics.regression_metrics(m.transform(df.where(f"fold = {f}")).withColumnRenamed("y", "label"), []).first().r2
        assert got[gi, f] == pytest.approx(alone, abs=1e-3 if points[gi]["kernel"] == "rbf" else 1e-9)


def test_networks_trained_together_equal_networks_trained_alone(spark):
    rows = [(float(i % 13), float(i % 5) / 10.0, i % 4 == 0) for i in range(96)]
    df = spark.createDataFrame([(q, d, 2.0 * q - 3.0 * d + 1.0, v) for q, d, v in rows], "q double, d double, y double, v boolean")
    points = [{"hidden": (4,), "dropout": 0.1, "learning_rate": 0.05, "batch_size": 8},
              {"hidden": (8, 4), "dropout": 0.0, "learning_rate": 1e-6, "batch_size": 16}]
    both = solvers.train_networks(df, ["q", "d"], "y", points, epochs=6, patience=2, validation_col="v", seed=5)
    for p, m in zip(points, both):
        alone = solvers.MLPRegressor(["q", "d"], "y", epochs=6, patience=2, validation_col="v", seed=5, **p).fit(df)
        assert alone.history == m.history and alone.weights == m.weights
    assert both[0].history[-1][3] < both[0].history[0][3]


def test_network_sets_validation_rows_aside_itself(spark):
    rows = [(float(i % 7), float(i % 3), float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    m = solvers.MLPRegressor(["a", "b"], "y", hidden=(4,), epochs=3, learning_rate=0.01).fit(df)
    assert all(h[3] is not None for h in m.history)
    from regimen.operators import sampling
    flags = [sampling.content_holdout(d, ["a", "b", "y"], 0.1, 42).where("is_test").groupBy("a", "b").count().collect()
             for d in (df, df.repartition(7))]
    assert sorted(flags[0]) == sorted(flags[1]) and sum(r["count"] for r in flags[0]) == 20


@pytest.fixture(scope="module")
def noisy(spark):
    """Labels that differ between rows of equal bins."""
    d = spark.range(6000).select((F.col("id") % 50).cast("double").alias("q"), ((F.col("id") * 7919) % 6000 / 6000.0).alias("u"))
    return d.select("q", "u", (F.sin(F.col("q") / 6.0) + F.col("u") + (F.col("q") * 31 + F.col("u") * 6000) % 7 / 10.0).alias("y"),
                    (F.col("u") > 0.8).alias("v"))


def by_rows(boosted, df, **kw):
    """Spark ML's learner over the binned rows one by one."""
    from pyspark.ml.regression import GBTRegressor
    rows = boosted.stages[1].transform(boosted.stages[0].transform(df)).withMetadata("features", {})
    return GBTRegressor(featuresCol="features", labelCol="y", stepSize=kw.pop("stepSize", 0.1), maxDepth=3, maxBins=16, **kw).fit(rows), rows


def test_boosting_groups_equals_boosting_rows(spark, noisy):
    m = models.gbt(["q", "u"], "y", max_iter=8, max_bins=16).fit(noisy)
    rows_model, rows = by_rows(m, noisy, maxIter=8)
    assert models.round_losses(m, noisy) == pytest.approx(rows_model.evaluateEachIteration(rows, "squared"))
    both = rows_model.transform(rows).withColumnRenamed("prediction", "p")
    other = m.stages[-1].transform(both)
    assert other.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9


def test_early_stopping_on_groups_equals_rows(spark, noisy):
    m = models.gbt(["q", "u"], "y", max_iter=60, step_size=0.5, max_bins=16, validation_col="v").fit(noisy)
    rows_model, _ = by_rows(m, noisy, maxIter=60, stepSize=0.5, validationIndicatorCol="v", validationTol=0.01)
    assert m.stages[-1].getNumTrees == rows_model.getNumTrees < 60


def test_learner_gets_groups_not_rows(spark, noisy):
    bucketizer, rows, _ = models.fit_bins(noisy, ["q", "u"], "y", 16)
    groups = models.grouped(bucketizer.transform(noisy), bucketizer.getOutputCols(), "y", spread=F.lit(True))
    assert rows == 6000 and groups.count() <= 2 * 16 * 16
    total = groups.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("y")), F.sum(F.col("_n") * F.col("y") * F.col("y"))).first()
    known = noisy.agg(F.count("*"), F.sum("y"), F.sum(F.col("y") * F.col("y"))).first()
    assert list(total) == pytest.approx(list(known))


def test_samples_of_groups(spark):
    groups = spark.range(400).select((F.col("id") % 20).cast("double").alias("y"), F.lit(1000.0).alias("_n"))
    part = models.draw(groups, 0.8, False, 1, 0).agg(F.sum("_drawn"), F.max("_drawn")).first()
    assert part[0] == pytest.approx(320000, rel=0.01) and part[1] <= 1000
    again = models.draw(groups, 1.0, True, 1, 0).agg(F.sum("_drawn"), F.var_samp("_drawn")).first()
    assert again[0] == pytest.approx(400000, rel=0.01) and again[1] == pytest.approx(1000, rel=0.3)


def test_stochastic_boosting_draws_groups(spark, planted):
    m = models.gbt_stochastic(["q", "d"], "step", max_iter=4, max_bins=64).fit(planted)
    assert m.stages[-1].treeWeights == [1.0, 0.1, 0.1, 0.1] and max_err(m.transform(planted), "step") == 0.0
    assert models.training_history_gbt(m, planted, "x").collect()[-1].loss == 0.0


def test_trees_refuse_missing_values(spark, planted):
    holes = planted.withColumn("d", F.when(F.col("q") > 3, F.col("d")))
    for est in (models.gbt(["q", "d"], "step", max_iter=2), models.random_forest(["q", "d"], "step", num_trees=2)):
        with pytest.raises(ValueError, match="without a value of d"):
            est.fit(holes)


def test_dealt_tasks_stay_small(spark):
    from regimen.session import deal_up
    assert deal_up(spark.range(0, 1000, 1, 1), rows=100).rdd.getNumPartitions() == 10


def test_assembled_ensembles_are_saved_whole(spark, planted, tmp_path):
    from regimen.sources import tables
    for name, est in (("forest", models.random_forest(["q", "d"], "step", num_trees=3, max_bins=64)),
                      ("boosted", models.gbt_stochastic(["q", "d"], "step", max_iter=3, max_bins=64))):
        m = est.fit(planted.crossJoin(spark.range(10)))   # groups are few beside the rows
        m.write().overwrite().save(str(tmp_path / name))
        back = tables.load_model(str(tmp_path / name))
        assert back.stages[-1].getNumTrees == 3 and max_err(back.transform(planted), "step") == 0.0


def test_sampled_boosting_on_many_label_values_reads_rows_once_a_pass(spark, noisy, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    many = noisy.crossJoin(spark.range(4).select((F.col("id") / 100.0).alias("e"))).select("q", "u", (F.col("y") + F.col("e")).alias("y"))
    monkeypatch.setattr(GBTRegressor, "fit", lambda *args: pytest.fail("the learner got the rows"))
    monkeypatch.setattr(models, "ROUNDS_A_PASS", 3)
    passes, own = [], models.row_samples
    monkeypatch.setattr(models, "row_samples", lambda *args: (passes.append(list(args[-1])), own(*args))[1])
    m = models.gbt(["q", "u"], "y", max_iter=8, step_size=0.5, max_bins=16, subsample=0.8).fit(many)
    assert passes == [[0, 1, 2], [3, 4, 5], [6, 7]] and m.stages[-1].treeWeights == [1.0] + 7 * [0.5]
    monkeypatch.undo()
    whole, rows = by_rows(m, many.withColumn("_n", F.lit(1.0)), maxIter=8, stepSize=0.5)
    assert models.round_losses(m, many) == pytest.approx(whole.evaluateEachIteration(rows, "squared"), rel=0.2)  # samples differ
    est = models.gbt(["q", "u"], "y", max_iter=8, step_size=0.5, max_bins=16)
    drawn = est._sampled(est._row_samples(m.stages[0].transform(many)))   # at rate 1
    assert drawn.evaluateEachIteration(rows, "squared") == pytest.approx(whole.evaluateEachIteration(rows, "squared"))


def test_row_samples_are_counts_and_sums_of_the_same_rows(spark):
    rows = spark.range(0, 40000, 1, 4).select((F.col("id") % 4).cast("double").alias("b"), F.lit(3.0).alias("y"))
    s = models.row_samples(rows, ["b"], "y", 0.8, 1, range(5, 8)).collect()
    assert len(s) == 4
    for r in s:
        for i in (5, 6, 7):
            assert r[f"_drawn_{i}"] == pytest.approx(8000, rel=0.05) and r[f"_sum_{i}"] == 3.0 * r[f"_drawn_{i}"]
        assert len({r[f"_drawn_{i}"] for i in (5, 6, 7)}) > 1


def test_sampled_boosting_of_mostly_different_rows_gets_the_rows(spark, noisy, monkeypatch):
    monkeypatch.setattr(models, "row_samples", lambda *args: pytest.fail("groups are not few beside the rows"))
    m = models.gbt(["q", "u"], "y", max_iter=2, max_bins=64, subsample=0.8).fit(noisy)
    assert m.stages[-1].getNumTrees == 2
