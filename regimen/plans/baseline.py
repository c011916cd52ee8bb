"""Mean predictor: the model-free baseline used by the experiment
plumbing (hold-out, CV, learning curve, repeated splits).

Its fitted state is one mean per training group -- a small table joined
back by group key -- so the whole experiment is a handful of aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimen.functions.exprs import nan_to_null
from regimen.operators.order import maybe_broadcast


def fit_means(train: DataFrame, label: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``[groups..., mean]`` over labelled training rows."""
    return train.groupBy(*group_cols).agg(F.avg(nan_to_null(label)).alias("mean"))


def predict_means(df: DataFrame, means: DataFrame, group_cols: Sequence[str] = (),
                  max_groups: int = 1, out: str = "prediction") -> DataFrame:
    side = maybe_broadcast(means.withColumnRenamed("mean", out), max_groups)
    if group_cols:
        return df.join(side, on=list(group_cols), how="left")
    return df.crossJoin(side)


def other_folds_means(df: DataFrame, label: str, fold_col: str,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Per held-out fold f: mean label of all OTHER folds, from fold sums.

    ``[groups..., fold, mean]`` -- total minus the fold's own sum/count, so
    k folds cost one aggregate instead of k training passes.
    """
    y = nan_to_null(label)
    per = df.groupBy(*group_cols, fold_col).agg(F.sum(y).alias("_s"), F.count(y).alias("_c"))
    tot = per.groupBy(*group_cols).agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    j = per.join(tot, on=list(group_cols)) if group_cols else per.crossJoin(tot)
    return j.select(*group_cols, fold_col,
                    F.try_divide(F.col("_ts") - F.col("_s"), (F.col("_tc") - F.col("_c")).cast("double"))
                    .alias("mean"))
