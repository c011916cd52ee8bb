"""Column profiles and correlations, all columns in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.functions.exprs import nan_to_null
from regimen.operators.clean import _s, stats_long


def _pair_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over pairwise-complete rows; constant -> NULL."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    denom = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.try_divide(F.covar_pop(xs, ys), F.when(denom > 0, denom))


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1: ``(column, mean, std, min, max, count)`` -- std is the sample std."""
    aggs = []
    for c in cols:
        x = nan_to_null(c)
        aggs += [F.avg(x).alias(_s(c, "mean")), F.stddev_samp(x).alias(_s(c, "std")),
                 F.min(x).alias(_s(c, "min")), F.max(x).alias(_s(c, "max")),
                 F.count(x).alias(_s(c, "count"))]
    return stats_long(df.agg(*aggs), cols, ["mean", "std", "min", "max", "count"])


def corr_with_target(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """A2: ``(feature, corr)`` of every feature with the label."""
    y = nan_to_null(label)
    stats = df.agg(*[_pair_corr(nan_to_null(c), y).alias(_s(c, "corr")) for c in features])
    return stats_long(stats, features, ["corr"]).withColumnRenamed("column", "feature")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: full pairwise matrix in long form ``(col_a, col_b, corr)``.

    The n(n-1)/2 off-diagonal aggregates and the n standard deviations are
    computed in a single aggregate job.
    """
    cols = list(cols)
    aggs = [F.stddev_pop(nan_to_null(c)).alias(_s(c, "sd")) for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            aggs.append(_pair_corr(nan_to_null(a), nan_to_null(b)).alias(f"__c__{a}__{b}"))
    stats = df.agg(*aggs)
    entries = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                v = F.when(F.col(_s(a, "sd")) > 0, F.lit(1.0))
            else:
                lo, hi = (a, b) if i < j else (b, a)
                v = F.col(f"__c__{lo}__{hi}")
            entries.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                    v.cast("double").alias("corr")))
    return stats.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def shape_and_nulls(df: DataFrame, cols: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """``(column, n_rows, n_cols, n_null[, n_out_of_range])``.

    With ``reference`` the values are checked against the reference
    table's [min, max] of the same column (e.g. a rotated column layout).
    """
    cols = list(cols)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(nan_to_null(c).isNull()).alias(_s(c, "null")) for c in cols]
    stats = df.agg(*aggs)
    names = ["null"]
    if reference is not None:
        rcols = [c for c in cols if c in reference.columns]
        rstats = reference.agg(*[F.min(nan_to_null(c)).alias(_s(c, "rmin")) for c in rcols],
                               *[F.max(nan_to_null(c)).alias(_s(c, "rmax")) for c in rcols])
        checked = df.crossJoin(F.broadcast(rstats))
        oor = checked.agg(*[F.count_if((nan_to_null(c) < F.col(_s(c, "rmin"))) |
                                       (nan_to_null(c) > F.col(_s(c, "rmax")))).alias(_s(c, "oor"))
                            for c in rcols],
                          *[F.lit(None).cast("long").alias(_s(c, "oor")) for c in cols if c not in rcols])
        stats = stats.crossJoin(oor)
        names.append("oor")
    out = stats_long(stats.withColumn("__n_cols", F.lit(len(df.columns))), cols, names)
    out = out.crossJoin(stats.select(F.col("__rows").alias("n_rows"))) \
        .withColumn("n_cols", F.lit(len(df.columns)).cast("long"))
    ren = out.withColumnRenamed("null", "n_null")
    if reference is not None:
        ren = ren.withColumnRenamed("oor", "n_out_of_range")
    return ren


def fidelity(original: DataFrame, synthetic: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per column mean/std/corr-with-label of both tables and their deltas."""
    cols = [*features, label]
    a = column_profile(original, cols).select("column", F.col("mean").alias("orig_mean"),
                                              F.col("std").alias("orig_std"))
    b = column_profile(synthetic, cols).select("column", F.col("mean").alias("syn_mean"),
                                               F.col("std").alias("syn_std"))
    ca = corr_with_target(original, features, label).select(F.col("feature").alias("column"),
                                                            F.col("corr").alias("orig_corr"))
    cb = corr_with_target(synthetic, features, label).select(F.col("feature").alias("column"),
                                                             F.col("corr").alias("syn_corr"))
    out = a.join(b, "column").join(ca, "column", "left").join(cb, "column", "left")
    return out.select("*", (F.col("syn_mean") - F.col("orig_mean")).alias("d_mean"),
                      (F.col("syn_std") - F.col("orig_std")).alias("d_std"),
                      (F.col("syn_corr") - F.col("orig_corr")).alias("d_corr"))
