import math

import pytest
from pyspark.sql import functions as F

from regimen.operators import metrics, ranking


def preds(spark, rows):
    return spark.createDataFrame(rows, "model string, split string, label double, prediction double")


def one(df):
    return df.first()


def test_constant_label_r2(spark):
    r = one(metrics.regression_metrics(preds(spark, [("m", "test", 1.0, 1.2), ("m", "test", 1.0, 0.9),
                                                     ("m", "test", 1.0, 1.0)]), ["model"]))
    assert r.r2 == 0.0
    r = one(metrics.regression_metrics(preds(spark, [("m", "test", 1.0, 1.0)] * 3), ["model"]))
    assert r.r2 == 1.0


def test_one_row_and_unlabelled(spark):
    r = one(metrics.regression_metrics(preds(spark, [("m", "test", 1.0, 2.0)]), ["model"]))
    assert r.r2 is None and r.mae == 1.0
    r = one(metrics.regression_metrics(preds(spark, [("m", "test", None, 2.0)]), ["model"]))
    assert r.n == 0 and r.r2 is None and r.mae is None and r.rmse is None


def test_metrics_values(spark):
    rows = [("m", "test", 1.0, 2.0), ("m", "test", 2.0, 2.0), ("m", "test", 3.0, 2.0), ("m", "val", 4.0, 2.0)]
    ev = one(metrics.evaluate(preds(spark, rows), ["model"]))
    assert ev.test_mae == pytest.approx(2 / 3)
    assert ev.test_rmse == pytest.approx(math.sqrt(2 / 3))
    assert ev.test_r2 == pytest.approx(0.0)
    assert ev.val_r2 is None and ev.val_mae == 2.0


def test_rank_nan_last(spark):
    df = spark.createDataFrame([("d", "a", 0.9), ("d", "b", float("nan")), ("d", "c", 0.1)],
                               "dataset string, model string, test_r2 double")
    got = [r.model for r in ranking.rank_models(df).orderBy("rank").collect()]
    assert got == ["a", "c", "b"]


def test_best_params_tie_and_nan(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, float("nan"))], "grid_index int, score double")
    assert [r.grid_index for r in ranking.best_params(df).collect()] == [0]
    df = spark.createDataFrame([(0, float("nan"))], "grid_index int, score double")
    assert ranking.best_params(df).count() == 0


def test_best_model_suite_order_tie(spark):
    df = spark.createDataFrame([("d", "SVR", 0.5), ("d", "Random Forest", 0.5)],
                               "dataset string, model string, test_r2 double")
    assert one(ranking.best_model(df)).best_model == "Random Forest"


def test_cv_summary_population_std(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 4.0)], "model string, r2 double")
    r = one(metrics.cv_summary(df))
    assert r.cv_std == pytest.approx(1.247219, abs=1e-6)


def test_best_epoch(spark):
    h = spark.createDataFrame([("c", 1, 3.0, 2.0), ("c", 2, 2.0, 1.0), ("c", 3, 1.0, 1.0)],
                              "config string, epoch int, loss double, val_loss double")
    r = one(metrics.best_epoch(h, ["config"]))
    assert (r.best_val_loss, r.best_epoch, r.best_loss, r.epochs) == (1.0, 2, 1.0, 3)


def test_axis_bounds(spark):
    r = one(metrics.axis_bounds(preds(spark, [("m", "t", 1.0, 5.0), ("m", "t", 3.0, 0.5)]), ["model"]))
    assert (r.axis_min, r.axis_max) == (0.5, 5.0)


def test_rmse_r2_identity(spark):
    """Golden identity behind the published tables: RMSE^2 / (1 - R^2) is the
    label's population variance, whatever the predictions."""
    import random

    rnd = random.Random(5)
    rows = []
    for m in ("a", "b", "c"):
        for i in range(50):
            y = float(i % 9) + 0.5 * (i % 4)
            rows.append((m, "test", y, y + rnd.uniform(-2, 2)))
    ys = [r[2] for r in rows[:50]]
    mu = sum(ys) / len(ys)
    var = sum((v - mu) ** 2 for v in ys) / len(ys)
    for r in metrics.regression_metrics(preds(spark, rows), ["model"]).collect():
        assert r.rmse ** 2 / (1 - r.r2) == pytest.approx(var, rel=1e-9)


def test_metrics_permutation_invariant(spark):
    import random

    rnd = random.Random(11)
    rows = [("m", "test", float(rnd.randint(0, 20)), rnd.uniform(0, 20)) for _ in range(500)]
    base = metrics.regression_metrics(preds(spark, rows), ["model"]).first()
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    other = metrics.regression_metrics(preds(spark, shuffled).repartition(7), ["model"]).first()
    for c in ("r2", "mae", "rmse"):
        assert other[c] == pytest.approx(base[c], rel=1e-12)
    assert other.n == base.n == 500


def test_scaler_inverse(spark):
    from regimen.operators import clean

    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "a double")
    stats = clean.standardize_fit(df, ["a"])
    st = stats.first()
    back = clean.standardize_apply(df, stats, ["a"]).select(
        (F.col("a") * st["__std__a"] + st["__mean__a"]).alias("a")).collect()
    assert sorted(r.a for r in back) == pytest.approx([1.0, 2.0, 4.0, 9.0])
