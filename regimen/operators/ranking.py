"""Ranking of result tables; J1-J3 combining them; E2/E10 shapes.

Result tables hold one row per (dataset, model) or per grid point -- tens
to thousands of rows -- so windows over them are cheap; none of these
functions touches row-level data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimen.functions.exprs import nan_to_null

# Display names of the model suite, in suite order.
SUITE_ORDER = ("Random Forest", "Gradient Boosting", "SVR", "Neural Network", "XGBoost")


def rank_models(results: DataFrame, score: str = "test_r2", partition_cols: Sequence[str] = ("dataset",),
                model_col: str = "model", out: str = "rank") -> DataFrame:
    """Descending score, missing (NULL or NaN) last; ties by model name."""
    s = nan_to_null(score)
    w = Window.partitionBy(*partition_cols).orderBy(s.desc_nulls_last(), F.col(model_col).asc())
    return results.withColumn(out, F.row_number().over(w))


def best_model(results: DataFrame, score: str = "test_r2", partition_cols: Sequence[str] = ("dataset",),
               model_col: str = "model", suite_order: Sequence[str] = SUITE_ORDER) -> DataFrame:
    """The top model per dataset; a tie goes to the earliest in suite order."""
    s = nan_to_null(score)
    idx = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in suite_order]), F.col(model_col)),
                     F.lit(len(suite_order) + 1))
    w = Window.partitionBy(*partition_cols).orderBy(s.desc_nulls_last(), idx.asc(), F.col(model_col))
    return (results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(*partition_cols, F.col(model_col).alias("best_model"), F.col(score).alias("best_score")))


def rank_importance(importances: DataFrame, group_cols: Sequence[str] = ("model",),
                    value: str = "importance", feature: str = "feature") -> DataFrame:
    """Importances descending (ties by feature name) with their rank."""
    w = Window.partitionBy(*group_cols).orderBy(F.col(value).desc(), F.col(feature).asc())
    return importances.withColumn("rank", F.row_number().over(w))


def best_params(grid_scores: DataFrame, score: str = "score", index_col: str = "grid_index",
                group_cols: Sequence[str] = (), higher_is_better: bool = True) -> DataFrame:
    """First strictly better configuration wins; NaN/NULL never wins."""
    s = nan_to_null(score)
    primary = s.desc_nulls_last() if higher_is_better else s.asc_nulls_last()
    w = Window.partitionBy(*group_cols).orderBy(primary, F.col(index_col).asc())
    return (grid_scores.withColumn("_r", F.row_number().over(w))
            .where((F.col("_r") == 1) & s.isNotNull()).drop("_r"))


# ---------------------------------------------------------------- joins and shapes

def compare_datasets(left: DataFrame, right: DataFrame, key: str = "model",
                     metrics: Sequence[str] = ("r2", "mae", "rmse"),
                     names: Sequence[str] = ("original", "synthetic")) -> DataFrame:
    """Side by side for models present in both; ``rank`` counts by the first
    table's R^2 descending (missing last, ties by name)."""
    a = left.select(key, *[F.col(m).alias(f"{names[0]}_{m}") for m in metrics])
    b = right.select(key, *[F.col(m).alias(f"{names[1]}_{m}") for m in metrics])
    first = Window.orderBy(nan_to_null(f"{names[0]}_{metrics[0]}").desc_nulls_last(), F.col(key).asc())
    return a.join(b, on=key, how="inner").withColumn("rank", F.row_number().over(first))  # one row a model


def attach_cv(results: DataFrame, cv: DataFrame, key: str = "model") -> DataFrame:
    """Left-attach CV mean/std; NULL for models without CV."""
    return results.join(cv, on=key, how="left")


def stack_splits(train: DataFrame, test: DataFrame, order_col: str = "split_order") -> DataFrame:
    """Train rows then test rows; ``split_order`` keeps the order meaning."""
    return (train.withColumn(order_col, F.lit(0))
            .unionByName(test.withColumn(order_col, F.lit(1))))


def results_table(metrics: DataFrame, cv: DataFrame | None = None, key: str = "model",
                  partition_cols: Sequence[str] = ("dataset",), score: str = "test_r2") -> DataFrame:
    """Wide results (test/val metrics) + CV summary, ranked by test R^2."""
    out = attach_cv(metrics, cv, key) if cv is not None else metrics
    return rank_models(out, score=score, partition_cols=partition_cols, model_col=key)


def chart_tables(results: DataFrame, id_cols: Sequence[str] = ("dataset", "model"),
                 value_cols: Sequence[str] = ("test_r2", "test_mae", "test_rmse", "val_r2"),
                 zero_missing: Sequence[str] = ("val_r2",)) -> DataFrame:
    """Long ``(id..., metric, value)`` rows behind the bar charts; a
    missing validation score is drawn as 0 (only here)."""
    entries = []
    for c in value_cols:
        v = F.coalesce(F.col(c), F.lit(0.0)) if c in zero_missing else F.col(c)
        entries.append(F.struct(F.lit(c).alias("metric"), v.cast("double").alias("value")))
    return results.select(*id_cols, F.explode(F.array(*entries)).alias("e")).select(*id_cols, "e.*")


def chart_bands(df: DataFrame, id_cols: Sequence[str], mean: str, std: str) -> DataFrame:
    """``(id..., center, low, high)`` of error bars or shaded bands (mean -/+ std)."""
    return df.select(*id_cols, F.col(mean).alias("center"), (F.col(mean) - F.col(std)).alias("low"),
                     (F.col(mean) + F.col(std)).alias("high"))


def chart_importance(ranked: DataFrame) -> DataFrame:
    """``(model, feature, importance, position)`` from ranked importances (W3), the largest at position 0."""
    return ranked.select("model", "feature", "importance", (F.col("rank") - 1).alias("position"))
