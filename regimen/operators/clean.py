"""Cleaning, scaling and small projections/filters.

Statistics for any number of columns come from ONE aggregate job and are a
one-row DataFrame joined back with ``crossJoin(broadcast(stats))`` (J4);
nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.functions.exprs import bround_col, clip_non_negative, nan_to_null
from regimen.operators.persist import Stored


def _s(c: str, stat: str) -> str:
    return f"__{stat}__{c}"


def broadcast_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row statistics table to every row (map-side)."""
    return df.crossJoin(F.broadcast(stats))


def _drop_stats(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


# ---------------------------------------------------------------- P ops

def split_features_label(columns: Sequence[str], label: str | None = None) -> tuple[list[str], str]:
    """Last column is the label, every column before it a feature (order kept)."""
    cols = list(columns)
    if label is None:
        return cols[:-1], cols[-1]
    return [c for c in cols if c != label], label


def normalize_nan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN -> NULL once at ingest for double columns."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields
                                                 if f.dataType.typeName() in ("double", "float")]
    return df.select(*[nan_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def labelled_only(df: DataFrame, label: str) -> DataFrame:
    """Keep rows whose label is present (not NULL, not NaN)."""
    return df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label)))


def accept_condition(score: str = "score", score2: str = "score2", min_score: float = 0.89,
                     min_score2: float = 0.5) -> Column:
    """P5 as a predicate: strict thresholds on both scores."""
    return (F.col(score) > F.lit(min_score)) & (F.col(score2) > F.lit(min_score2))


def accept_runs(df: DataFrame, score: str = "score", score2: str = "score2",
                min_score: float = 0.89, min_score2: float = 0.5) -> DataFrame:
    """P5: keep runs passing both strict thresholds."""
    return df.where(accept_condition(score, score2, min_score, min_score2))


def clip_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``max(x, 0)`` with NULL kept."""
    return df.select(*[clip_non_negative(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def round_columns(df: DataFrame, cols: Sequence[str], scale: int = 5) -> DataFrame:
    """Half-even rounding to ``scale`` decimals."""
    return df.select(*[bround_col(c, scale).alias(c) if c in cols else F.col(c) for c in df.columns])


def common_keys(left: DataFrame, right: DataFrame, key: str = "model") -> DataFrame:
    """Rows of ``left`` whose key is present in ``right`` (semi join)."""
    return left.join(right.select(key).distinct(), on=key, how="left_semi")


TREE_MODELS = ("Random Forest", "Gradient Boosting", "XGBoost")  # fixed values: display names


def tree_models_only(df: DataFrame, model_col: str = "model",
                     models: Sequence[str] = TREE_MODELS) -> DataFrame:
    """Only models that expose feature importances."""
    return df.where(F.col(model_col).isin(*models))


def display_name_slug(c: str | Column) -> Column:
    """P10: ``'Random Forest' -> 'random_forest'``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(col, " ", "_"))


# ---------------------------------------------------------------- imputation

def mean_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row table of column means over present values."""
    return df.agg(*[F.avg(nan_to_null(c)).alias(_s(c, "mean")) for c in cols])


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing -> own column mean; an all-missing column stays missing."""
    stats = mean_stats(df, cols)
    out = broadcast_stats(df, stats)
    filled = {c: F.coalesce(nan_to_null(c), F.col(_s(c, "mean"))).alias(c) for c in cols}
    return out.select(*[filled.get(c, F.col(c)) for c in df.columns])


def impute_from_reference(df: DataFrame, reference: DataFrame, cols: Sequence[str],
                          label: str | None = None, fill_label: bool = True) -> DataFrame:
    """Missing -> mean of the same column in ``reference`` (if it has it),
    then remaining missing -> own mean.  ``fill_label=True`` also fills the
    label from the reference (the original behaviour); otherwise a missing
    label stays missing."""
    ref_cols = [c for c in cols if c in reference.columns and (fill_label or c != label)]
    ref_stats = reference.agg(*[F.avg(nan_to_null(c)).alias(_s(c, "ref")) for c in ref_cols]) \
        if ref_cols else None
    out = df if ref_stats is None else broadcast_stats(df, ref_stats)
    stage1 = {c: F.coalesce(nan_to_null(c), F.col(_s(c, "ref"))) if c in ref_cols else nan_to_null(c)
              for c in cols}
    out = out.select(*[stage1[c].alias(c) if c in stage1 else F.col(c) for c in df.columns])
    return impute_mean(out, [c for c in cols if fill_label or c != label])


def zero_if_all_missing(df: DataFrame, label: str) -> DataFrame:
    """A label with no present value becomes 0.0 everywhere."""
    stats = df.agg(F.count(nan_to_null(label)).alias(_s(label, "present")))
    out = broadcast_stats(df, stats)
    fixed = F.when(F.col(_s(label, "present")) == 0, F.lit(0.0)).otherwise(F.col(label)).alias(label)
    return out.select(*[fixed if c == label else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- scaling

def range_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        x = nan_to_null(c)
        aggs += [F.min(x).alias(_s(c, "min")), F.max(x).alias(_s(c, "max")),
                 F.count_if(x.isNull()).alias(_s(c, "nulls"))]
    return df.agg(*aggs)


def _minmax_expr(c: str, nan_policy: str) -> Column:
    lo, hi = F.col(_s(c, "min")), F.col(_s(c, "max"))
    scaled = F.when(hi > lo, (nan_to_null(c) - lo) / (hi - lo)).otherwise(
        F.when(nan_to_null(c).isNotNull(), F.lit(0.0)))
    if nan_policy == "zero":
        return F.when(F.col(_s(c, "nulls")) > 0, F.lit(0.0)).otherwise(scaled)
    return scaled


def minmax_features(df: DataFrame, cols: Sequence[str], nan_policy: str = "skip") -> DataFrame:
    """``(x - min) / (max - min)``; a constant column gives 0.0.

    ``nan_policy='zero'`` reproduces array semantics where a missing value
    poisons min/max and the whole column becomes 0.0.
    """
    out = broadcast_stats(df, range_stats(df, cols))
    return out.select(*[_minmax_expr(c, nan_policy).alias(c) if c in cols else F.col(c) for c in df.columns])


def minmax_target(df: DataFrame, label: str, nan_policy: str = "skip") -> DataFrame:
    """N4 on the label alone."""
    return minmax_features(df, [label], nan_policy)


def minmax_rounded(df: DataFrame, cols: Sequence[str], scale: int = 5) -> DataFrame:
    """Range rounded to 5 decimals, result rounded to 5; zero range -> NULL."""
    out = broadcast_stats(df, range_stats(df, cols))

    def expr(c: str) -> Column:
        rng = F.bround(F.col(_s(c, "max")) - F.col(_s(c, "min")), scale)
        return F.bround(F.try_divide(nan_to_null(c) - F.col(_s(c, "min")), rng), scale)

    return out.select(*[expr(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def minmax_target_rounded(df: DataFrame, label: str, scale: int = 5) -> DataFrame:
    """``bround((y - min) / (max - min), 5)`` (range not rounded)."""
    out = broadcast_stats(df, range_stats(df, [label]))
    y = F.bround(F.try_divide(nan_to_null(label) - F.col(_s(label, "min")),
                              F.col(_s(label, "max")) - F.col(_s(label, "min"))), scale)
    return out.select(*[y.alias(c) if c == label else F.col(c) for c in df.columns])


def standardize_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row table of mean and population std (0 -> 1) per column."""
    aggs = []
    for c in cols:
        x = nan_to_null(c)
        aggs += [F.avg(x).alias(_s(c, "mean")), F.stddev_pop(x).alias(_s(c, "std"))]
    stats = df.agg(*aggs)
    return stats.select(*[F.col(_s(c, "mean")) for c in cols],
                        *[F.when(F.col(_s(c, "std")) == 0, F.lit(1.0)).otherwise(F.col(_s(c, "std")))
                          .alias(_s(c, "std")) for c in cols])


def standardize_apply(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(x - mean) / std`` with statistics fitted elsewhere (training rows)."""
    out = broadcast_stats(df, stats)
    return out.select(*[((nan_to_null(c) - F.col(_s(c, "mean"))) / F.col(_s(c, "std"))).alias(c)
                        if c in cols else F.col(c) for c in df.columns])


def standardize(df: DataFrame, cols: Sequence[str], split_col: str = "split", fit_scope: str = "train") -> DataFrame:
    """N8 + N9: ``(x - mean) / std`` with the statistics of the training rows, or (``fit_scope='all'``) of all rows,
    as a flow that scales before it splits does."""
    if fit_scope not in ("train", "all"):
        raise ValueError(f"unknown fit_scope {fit_scope!r}")
    fitted = df if fit_scope == "all" else df.where(F.col(split_col) == "train")
    return standardize_apply(df, standardize_fit(fitted, cols), cols)


def stats_long(stats: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Pivot a one-row stats table to ``(column, <stat>...)`` rows."""
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(_s(c, n)).alias(n) for n in names]) for c in cols]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---------------------------------------------------------------- pipeline stage

class PopulationScaler(Estimator, Stored):
    """N8/N9 as a Spark ML stage: ``(x - mean) / std`` per named column with
    the population std (0 -> 1), fitted by one aggregate.  Inside a
    ``Pipeline`` it is refitted on every training fold, like a scaler
    inside a cross-validated pipeline."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def to_state(self) -> dict:
        return {"cols": self.cols}

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        row = standardize_fit(dataset, self.cols).first()
        return PopulationScalerModel(self.cols, [float(row[_s(c, "mean")]) if row[_s(c, "mean")] is not None
                                                 else 0.0 for c in self.cols],
                                     [float(row[_s(c, "std")]) if row[_s(c, "std")] is not None else 1.0
                                      for c in self.cols])


class PopulationScalerModel(Model, Stored):
    def __init__(self, cols: Sequence[str], means: Sequence[float], stds: Sequence[float]):
        super().__init__()
        self.cols, self.means, self.stds = list(cols), list(means), list(stds)

    def to_state(self) -> dict:
        return {"cols": self.cols, "means": self.means, "stds": self.stds}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = {c: ((nan_to_null(c) - F.lit(m)) / F.lit(s)).alias(c)
                  for c, m, s in zip(self.cols, self.means, self.stds)}
        return dataset.select(*[scaled.get(c, F.col(c)) for c in dataset.columns])
