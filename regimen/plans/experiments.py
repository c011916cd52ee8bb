"""E6-E8 experiment plumbing with the mean predictor.

These are the SQL-checkable forms of cross-validation, the learning curve
and the repeated shuffle-split search: the "model" is a per-group mean, so
every fit is one grouped aggregate and every score another.  The model
versions (forests, boosted trees, ...) live in :mod:`regimen.plans.suite`
and reuse the same split tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimen.functions.exprs import nan_to_null
from regimen.operators import clean, metrics, sampling
from regimen.operators.order import maybe_broadcast
from regimen.plans import baseline
from regimen.session import materialize


def cv_mean_predictor(df: DataFrame, order_cols: list[str], label: str, k: int = 5) -> DataFrame:
    """E6 (mean predictor): contiguous k folds, each scored by the mean of
    the other folds.  ``(fold, n, r2, mae, rmse)``."""
    f = materialize(sampling.kfold_contiguous(df, order_cols, k))
    mu = baseline.other_folds_means(f, label, "fold")
    preds = baseline.predict_means(f, mu, ["fold"], max_groups=k)
    return metrics.regression_metrics(preds, ["fold"], label=label)


def learning_curve_mean(df: DataFrame, order_cols: list[str], label: str, k: int = 5,
                        fractions: Sequence[float] | None = None) -> DataFrame:
    """E7 (mean predictor): per training size, mean and population std over
    the k folds of the train R^2 (on the prefix itself) and of the held-out
    fold R^2.  ``(train_size, train_mean, train_std, test_mean, test_std)``."""
    folded, sizes = sampling.first_sizes(df, order_cols, k, fractions)
    prefixes = sampling.expand_sizes(folded, sizes, k)   # streams into the aggregates, never written
    n_fracs = len(fractions) if fractions is not None else 10
    mu = prefixes.groupBy("cv_fold", "train_size").agg(F.avg(nan_to_null(label)).alias("prediction"))
    mu_b = maybe_broadcast(mu, k * n_fracs)
    train = metrics.regression_metrics(prefixes.join(mu_b, ["cv_fold", "train_size"]),
                                       ["cv_fold", "train_size"], label=label) \
        .select("cv_fold", "train_size", F.col("r2").alias("train_r2"))
    held = folded.join(mu_b, folded["fold"] == mu_b["cv_fold"])
    test = metrics.regression_metrics(held, ["cv_fold", "train_size"], label=label) \
        .select("cv_fold", "train_size", F.col("r2").alias("test_r2"))
    both = train.join(test, ["cv_fold", "train_size"])
    return both.groupBy("train_size").agg(
        F.avg("train_r2").alias("train_mean"), F.stddev_pop("train_r2").alias("train_std"),
        F.avg("test_r2").alias("test_mean"), F.stddev_pop("test_r2").alias("test_std"))


def _constant_r2_on(external: DataFrame, label: str, means: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """R^2 of a constant prediction per group on a whole external table.

    ``sum((y - mu)^2) = sum((y - ybar)^2) + n (ybar - mu)^2``, so the
    external table is aggregated ONCE (n, mean, ss_tot) instead of being
    crossed with every split.
    """
    y = nan_to_null(label)
    st = external.agg(F.count(y).alias("_n"), F.avg(y).alias("_ybar"),
                      (F.var_pop(y) * F.count(y)).alias("_ss_tot"))
    j = means.crossJoin(F.broadcast(st))   # one-row statistics of the external table
    ss_res = F.col("_ss_tot") + F.col("_n") * (F.col("_ybar") - F.col("mean")) ** 2
    r2 = (F.when(F.col("_n") < 2, F.lit(None).cast("double"))
          .when(F.col("_ss_tot") == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - ss_res / F.col("_ss_tot")))
    return j.select(*group_cols, r2.alias("score2"))


def repeated_splits_mean(df: DataFrame, id_cols: list[str], label: str, external: DataFrame | None,
                         n_rounds: int = 2, n_splits: int = 5, test_size: float = 0.2, seed: int = 42,
                         min_score: float = 0.89, min_score2: float = 0.5) -> DataFrame:
    """E8 (mean predictor): ``n_rounds x n_splits`` shuffled hold-outs, all
    scored in one grouped aggregate; ``score2`` on the external table;
    ``accepted`` is the P5 filter as a flag."""
    groups = ["round", "split"]
    n_groups = n_rounds * n_splits
    s = sampling.shuffle_splits(df, id_cols, n_splits=n_splits, test_size=test_size, seed=seed, n_rounds=n_rounds)
    mu = baseline.fit_means(s.where(~F.col("is_test")), label, groups)
    preds = baseline.predict_means(s.where(F.col("is_test")), mu, groups, max_groups=n_groups)
    sc = metrics.regression_metrics(preds, groups, label=label).select(*groups, F.col("r2").alias("score"))
    if external is None:
        return sc
    sc2 = _constant_r2_on(external, label, mu, groups)
    out = sc.join(sc2, groups)
    return out.withColumn("accepted", F.coalesce(clean.accept_condition(min_score=min_score,
                                                                        min_score2=min_score2), F.lit(False)))
