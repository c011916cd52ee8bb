"""Synthetic tables drawn from the statistics of a real one.

Per feature ``N(mean, spread * std)`` independently; the label is
``mean_y + std_y * sum_c corr_c * (x_c - mean_c) / std_c + N(0, noise * std_y)``
clipped at 0 (sample std, Pearson correlation with the label).  Draws are
deterministic: Box-Muller on md5 uniforms keyed by (row key, column, seed),
so any partitioning -- and any SQL engine with md5 -- gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.functions.exprs import clip_non_negative, nan_to_null, std_normal
from regimen.operators.clean import _s
from regimen.operators.profile import _pair_corr

# Fixed values of the original generator.
FEATURE_SPREAD = 1.2
LABEL_NOISE = 0.3


def synthesis_stats(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-row table: mean and sample std of every column, corr with label."""
    y = nan_to_null(label)
    aggs = [F.avg(y).alias(_s(label, "mean")), F.stddev_samp(y).alias(_s(label, "std"))]
    for c in features:
        x = nan_to_null(c)
        aggs += [F.avg(x).alias(_s(c, "mean")), F.stddev_samp(x).alias(_s(c, "std")),
                 _pair_corr(x, y).alias(_s(c, "corr"))]
    return df.agg(*aggs)


def synthesize(df: DataFrame, features: Sequence[str], label: str, n: int | None = None,
               key_cols: Sequence[str] | None = None, seed: int = 42,
               spread: float = FEATURE_SPREAD, noise: float = LABEL_NOISE) -> DataFrame:
    """A synthetic table with the same columns.

    ``n=None`` draws one synthetic row per source row, keyed by ``key_cols``
    (so the output grows with the table and stays partitioned like it);
    an explicit ``n`` draws ``spark.range(n)`` rows keyed by ``syn_id``.
    A feature whose correlation is undefined (constant column) contributes 0.
    """
    stats = synthesis_stats(df, features, label)
    if n is None:
        if not key_cols:
            raise ValueError("key_cols is required when n is None")
        base = df.select(*key_cols)
        keys = [F.col(k) for k in key_cols]
    else:
        spark = SparkSession.getActiveSession() or df.sparkSession
        base = spark.range(n).withColumnRenamed("id", "syn_id")
        key_cols, keys = ["syn_id"], [F.col("syn_id")]
    out = base.crossJoin(F.broadcast(stats))
    xs = {c: F.col(_s(c, "mean")) + F.lit(spread) * F.col(_s(c, "std")) * std_normal(*keys, F.lit(c), F.lit(seed))
          for c in features}
    out = out.select(*key_cols, *[xs[c].alias(c) for c in features], *[F.col(c) for c in stats.columns])
    signal = F.lit(0.0)
    for c in features:
        z = F.try_divide(F.col(c) - F.col(_s(c, "mean")), F.col(_s(c, "std")))
        signal = signal + F.coalesce(F.col(_s(c, "corr")), F.lit(0.0)) * F.coalesce(z, F.lit(0.0))
    y = (F.col(_s(label, "mean")) + F.col(_s(label, "std")) * signal
         + F.lit(noise) * F.col(_s(label, "std")) * std_normal(*keys, F.lit(label), F.lit(seed)))
    return out.select(*key_cols, *features, clip_non_negative(y).alias(label))


def write_synthetic(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a synthetic table (CSV with header, or Parquet)."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
