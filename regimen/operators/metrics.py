"""Regression metrics over long-form prediction tables.

A *predictions* table has one row per (row, model, split, ...) with a
``label`` and a ``prediction`` column.  All models, splits and folds are
scored by ONE grouped aggregate (partial aggregation map-side, a shuffle of
one small row per group and task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.functions.exprs import nan_to_null


def _r2(ss_res: Column, ss_tot: Column, n: Column) -> Column:
    """R^2 with the finite rules: n < 2 -> NULL; zero label variance -> 1.0
    for a perfect fit, 0.0 otherwise (never -inf)."""
    return (F.when(n < 2, F.lit(None).cast("double"))
            .when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - ss_res / ss_tot))


def regression_metrics(preds: DataFrame, group_cols: Sequence[str], label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """``(group..., n, r2, mae, rmse)`` per group.

    Only labelled rows count (P4); a group without labelled rows gets
    ``n = 0`` and NULL metrics instead of an error.
    """
    y, p = nan_to_null(label), nan_to_null(prediction)
    ok = y.isNotNull() & p.isNotNull()
    yv, err = F.when(ok, y), F.when(ok, y - p)
    agg = preds.groupBy(*group_cols).agg(
        F.count(yv).alias("n"),
        (F.var_pop(yv) * F.count(yv)).alias("_ss_tot"),
        F.sum(err * err).alias("_ss_res"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"))
    return agg.select(*group_cols, "n", _r2(F.col("_ss_res"), F.col("_ss_tot"), F.col("n")).alias("r2"),
                      "mae", "rmse")


def r2_score(preds: DataFrame, group_cols: Sequence[str], label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    """A4 alone."""
    return regression_metrics(preds, group_cols, label, prediction).select(*group_cols, "r2")


def mae_score(preds: DataFrame, group_cols: Sequence[str], label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """A5 alone (also the ``error_evalue`` helper)."""
    return regression_metrics(preds, group_cols, label, prediction).select(*group_cols, "mae")


def rmse_score(preds: DataFrame, group_cols: Sequence[str], label: str = "label",
               prediction: str = "prediction") -> DataFrame:
    """A6 alone."""
    return regression_metrics(preds, group_cols, label, prediction).select(*group_cols, "rmse")


def evaluate(preds: DataFrame, group_cols: Sequence[str] = ("dataset", "model"), split_col: str = "split",
             splits: Sequence[str] = ("test", "val"), label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    """Bundle of r2/mae/rmse per split pivoted to ``test_*`` / ``val_*``.

    A split that is absent or unlabelled gives NULL metrics.
    """
    m = regression_metrics(preds, [*group_cols, split_col], label, prediction)
    aggs = []
    for s in splits:
        for name in ("r2", "mae", "rmse"):
            aggs.append(F.max(F.when(F.col(split_col) == s, F.col(name))).alias(f"{s}_{name}"))
    return m.groupBy(*group_cols).agg(*aggs)


def cv_summary(fold_scores: DataFrame, group_cols: Sequence[str] = ("model",),
               score: str = "r2") -> DataFrame:
    """Mean and population std of fold scores."""
    s = nan_to_null(score)
    return fold_scores.groupBy(*group_cols).agg(F.avg(s).alias("cv_mean"),
                                               F.stddev_pop(s).alias("cv_std"),
                                               F.count(s).alias("cv_folds"))


def best_epoch(history: DataFrame, config_cols: Sequence[str], epoch: str = "epoch",
               loss: str = "loss", val_loss: str = "val_loss") -> DataFrame:
    """A10: best (min) validation loss, the earliest epoch reaching it, the
    min training loss and the number of epochs trained, per configuration."""
    vl = nan_to_null(val_loss)
    return history.groupBy(*config_cols).agg(
        F.min(vl).alias("best_val_loss"),
        F.min_by(F.col(epoch), F.struct(vl.isNull(), vl, F.col(epoch))).alias("best_epoch"),
        F.min(nan_to_null(loss)).alias("best_loss"),
        F.count(F.lit(1)).alias("epochs"))


def axis_bounds(preds: DataFrame, group_cols: Sequence[str], label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    """Min and max over both actual and predicted values."""
    y, p = nan_to_null(label), nan_to_null(prediction)
    return preds.groupBy(*group_cols).agg(
        F.least(F.min(y), F.min(p)).alias("axis_min"),
        F.greatest(F.max(y), F.max(p)).alias("axis_max"))


def actual_vs_predicted(preds: DataFrame, group_cols: Sequence[str], label: str = "label",
                        prediction: str = "prediction", max_groups: int = 4096) -> DataFrame:
    """Every (y, y_hat) with its group's R^2 and identity-line bounds.

    The per-group statistics (one row per model/split) are broadcast only
    while ``max_groups`` -- the caller's bound on the number of groups --
    is within the broadcast limit; otherwise they are shuffle-joined."""
    from regimen.operators.order import maybe_broadcast

    stats = regression_metrics(preds, group_cols, label, prediction).select(*group_cols, "r2") \
        .join(axis_bounds(preds, group_cols, label, prediction), on=list(group_cols))
    return preds.join(maybe_broadcast(stats, max_groups), on=list(group_cols))
