from pyspark.sql import functions as F

from regimen.operators import models, sampling
from regimen.plans import experiments, suite


def planted(spark, n=1200):
    return spark.range(n).select(F.col("id").alias("rid"), (F.col("id") * 7 % 50 + 1).cast("double").alias("q"),
                                 ((F.col("id") * 3) % 11 / 100.0).alias("d")) \
        .withColumn("y", F.when(F.col("q") > 25, 10.0).otherwise(2.0))


def test_cross_validate_suite_exact_on_step(spark):
    folded = sampling.kfold_contiguous(planted(spark), ["rid"], 4)
    ests = {suite.RF: models.random_forest(["q", "d"], "y", num_trees=5, max_depth=5, max_bins=64),
            suite.GB: models.gbt(["q", "d"], "y", max_iter=3, max_bins=64)}
    rows = suite.cross_validate_suite(folded, ests, "y", 4, parallelism=4).collect()
    assert len(rows) == 8 and all(r.r2 == 1.0 and r.mae == 0.0 for r in rows)
    assert sorted(r.n for r in rows) == [300] * 8


def test_grid_search_cv_first_best_wins(spark):
    folded = sampling.kfold_contiguous(planted(spark), ["rid"], 3)
    table, best = suite.grid_search_cv(folded, lambda max_depth: models.gbt(["q", "d"], "y", max_iter=2,
                                                                           max_depth=max_depth, max_bins=64),
                                       {"max_depth": [2, 3]}, "y", 3)
    assert [r.grid_index for r in best.collect()] == [0]
    assert {r.grid_index: r.cv_mean for r in table.collect()} == {0: 1.0, 1: 1.0}


def test_repeated_splits_accepts_exact_runs(spark, tmp_path):
    d = planted(spark)
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    runs = suite.repeated_splits(d, ["rid"], models.random_forest(["q", "d"], "y", num_trees=3, max_depth=4,
                                                                  max_bins=64), "y", d, n_rounds=1, n_splits=2, log_path=str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == [
        f"0    {i}  1.00000    1.00000" for i in (0, 1)]
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before   # nothing stays cached
    rows = runs.collect()
    assert len(rows) == 2 and all(r.accepted and r.score == 1.0 and r.score2 == 1.0 for r in rows)


def test_mean_predictor_cv_matches_direct_means(spark):
    d = planted(spark, 100).withColumn("y", F.col("q"))
    got = {r.fold: r for r in experiments.cv_mean_predictor(d, ["rid"], "y", 5).collect()}
    rows = sorted(d.collect(), key=lambda r: r.rid)
    for f in range(5):
        test = [r.y for r in rows[f * 20:(f + 1) * 20]]
        train = [r.y for i, r in enumerate(rows) if not f * 20 <= i < (f + 1) * 20]
        mu = sum(train) / len(train)
        mae = sum(abs(y - mu) for y in test) / len(test)
        assert abs(got[f].mae - mae) < 1e-9


def test_searches_hold_few_models_and_return_the_winner(spark):
    alive, most = 0, 0

    class Counting:
        """An estimator whose model counts while it lives."""

        def __init__(self, value):
            self.value = value

        def fit(self, df):
            nonlocal alive, most
            alive += 1
            most = max(most, alive)
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.col("y") + F.lit(float(self.value)))

        def __del__(self):
            nonlocal alive
            alive -= 1

    d = planted(spark, 60).cache()
    grid = {"value": list(range(50, 0, -1)) + [0]}
    table, best = suite.grid_search_holdout(d, d, Counting, grid, "y", parallelism=4)
    assert table.count() == 51 and most <= 8
    params, _ = suite.refit_winner(best, Counting, grid, d)
    assert params == {"value": 0}
    d.unpersist()


def test_a_stopped_search_goes_on_from_its_journal(spark, tmp_path):
    """Half the fits fail the first time; the second run makes only those that the journal lacks, with the same result."""
    made, broken = [], True

    class Shift:
        def __init__(self, value):
            self.value = value

        def fit(self, df):
            if broken and self.value > 5:
                raise RuntimeError("lost")
            made.append(self.value)
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.col("y") + F.lit(float(self.value)))

    d = planted(spark, 60)
    grid, path = {"value": list(range(1, 11))}, str(tmp_path / "journal")
    try:
        suite.grid_search_holdout(d, d, Shift, grid, "y", parallelism=1, journal=path)
        raise AssertionError("not stopped")
    except RuntimeError:
        pass
    assert made == [1, 2, 3, 4, 5]
    broken = False
    table, best = suite.grid_search_holdout(d, d, Shift, grid, "y", parallelism=2, journal=path)
    assert sorted(made) == list(range(1, 11))
    whole, _ = suite.grid_search_holdout(d, d, Shift, grid, "y", parallelism=2)
    assert sorted(table.collect()) == sorted(whole.collect()) and best.first()["grid_index"] == 0
    before = len(made)
    suite.grid_search_holdout(d, d, Shift, grid, "y", journal=path)
    assert len(made) == before


def test_staged_rounds_equal_single_fits(spark):
    d = planted(spark, 400).withColumn("y", F.sin(F.col("q") / 5) + F.col("d"))
    grid = {"max_iter": [2, 5], "max_depth": [2]}
    build = lambda max_iter, max_depth: models.gbt(["q", "d"], "y", max_iter=max_iter, max_depth=max_depth, max_bins=64)
    staged, _ = suite.grid_search_boosted(d, d, build, grid, "y")
    alone, _ = suite.grid_search_holdout(d, d, build, grid, "y")
    for a, b in zip(staged.orderBy("grid_index").collect(), alone.orderBy("grid_index").collect()):
        assert abs(a.train_r2 - b.train_r2) < 1e-9 and abs(a.val_r2 - b.val_r2) < 1e-9
    folded = sampling.kfold_contiguous(d, ["rid"], 3)
    staged, best = suite.grid_search_boosted_cv(folded, build, grid, "y", 3)
    alone, _ = suite.grid_search_cv(folded, build, grid, "y", 3)
    for a, b in zip(staged.orderBy("grid_index").collect(), alone.orderBy("grid_index").collect()):
        assert abs(a.cv_mean - b.cv_mean) < 1e-9 and a.cv_folds == 3
    assert best.first().grid_index == 1


def test_network_grid_logs_every_point(spark):
    d = planted(spark, 300).withColumn("y", F.col("q") / 25 - F.col("d"))
    log, best, found = suite.grid_search_networks(d.where("rid % 5 > 0"), d.where("rid % 5 = 0"), ["q", "d"], "y",
                                                  {"hidden_layers": [[8], [16]], "learning_rate": [1e-5, 0.02], "batch_size": [16]}, epochs=6)
    rows = log.orderBy("grid_index").collect()
    assert [r.hidden_layers for r in rows] == [[8], [8], [16], [16]] and all(r.patience == 10 for r in rows)
    assert all(1 <= r.epochs_trained <= 6 and r.val_loss is not None and r.train_loss is not None for r in rows)
    assert best.first().grid_index == min(rows, key=lambda r: (r.val_loss, r.grid_index)).grid_index in (1, 3)
    assert len(found) == 4 and found[1].history[-1][0] == rows[1].epochs_trained
