"""Exact, reproducible splits, folds and samples.

Sizes are exact (``ceil(test_size * n)`` test rows, k folds whose first
``n % k`` are one row larger) and do not depend on partitioning: the order
is a content hash (or the row id), positions come from
:mod:`regimen.operators.order`, and membership is a map-side comparison
against a few broadcast boundary keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.operators.order import (
    BUCKET,
    ORDER_KEY,
    Order,
    at_or_below,
    attach_thresholds,
    count_below,
    group_sizes,
    hash_order,
    hash_thresholds,
    key_at_most,
    keys_at,
    value_order,
)
from regimen.functions.exprs import lex_le
from regimen.session import materialize

INTERNAL = ["_thr", "_is_test", "_obkt", ORDER_KEY, BUCKET]


def _n_test(test_size: float | int) -> Column:
    if isinstance(test_size, int) and not isinstance(test_size, bool):
        return F.least(F.lit(test_size).cast("long"), F.col("n"))
    return F.ceil(F.lit(float(test_size)) * F.col("n")).cast("long")


def _drop(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in INTERNAL if c in df.columns])


def _holdout_marked(df: DataFrame, id_cols: list[str], test_size, seed: int):
    b, order = hash_order(df, id_cols, salt=[F.lit(seed)])
    pos = group_sizes(b, order).select(F.lit(0).alias("tag"), (_n_test(test_size) - 1).alias("pos"))
    thr = keys_at(b, order, pos, max_positions=1)
    out = attach_thresholds(b, order, thr, max_groups=1)
    return out.withColumn("_is_test", at_or_below(order).cast("int")), order


def holdout_split(df: DataFrame, id_cols: list[str], test_size: float | int = 0.2, seed: int = 42,
                  split_col: str = "split") -> DataFrame:
    """Seeded hold-out with exactly ``ceil(test_size * n)`` test rows.

    A row is 'test' when its key ``md5(ids-seed)`` is among the first
    ``n_test`` keys.  Disjoint, complete and unchanged under repartition.
    """
    out, _ = _holdout_marked(df, id_cols, test_size, seed)
    return _drop(out.withColumn(split_col, F.when(F.col("_is_test") == 1, "test").otherwise("train")))


def content_holdout(df: DataFrame, cols: list[str], test_size: float | int = 0.2, seed: int = 42,
                    flag_col: str = "is_test") -> DataFrame:
    """An exact, seeded hold-out of rows that have no id: ``flag_col`` is true for exactly ``n_test`` rows.

    Rows are ordered by a hash of the values of ``cols``; equal rows, which are interchangeable, by their number in
    the table that is written here once.  So the flagged values do not depend on partitioning."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols]
    b, order = hash_order(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_vals", F.concat_ws("\1", *parts)),
                          ["_vals"], salt=[F.lit(seed)])
    b = materialize(b.drop("_vals"))
    order = Order(keys=(ORDER_KEY, "_row"), bucket=order.bucket, max_buckets=order.max_buckets, digits=order.digits)
    pos = group_sizes(b, order).select(F.lit(0).alias("tag"), (_n_test(test_size) - 1).alias("pos"))
    out = attach_thresholds(b, order, keys_at(b, order, pos, max_positions=1), max_groups=1)
    return _drop(out.withColumn(flag_col, at_or_below(order)).drop("_row"))


def split_membership(df: DataFrame, id_cols: list[str], n_splits: int = 50, test_size: float | int = 0.2,
                     seed: int = 42, n_rounds: int = 1, first_round: int = 0) -> dict[tuple[int, int], Column]:
    """D2 without copies: for each (round, split) a column that says whether a row of ``df`` is a test row.

    Only one threshold key a split is found beforehand."""
    n = df.count()
    splits = [(r, s) for r in range(first_round, first_round + n_rounds) for s in range(n_splits)]
    wanted = min(test_size, n) if isinstance(test_size, int) and not isinstance(test_size, bool) else math.ceil(
        round(test_size * n, 9))
    if not n or not wanted:
        return {x: F.lit(False) for x in splits}
    keys = hash_thresholds(df, id_cols, seed, splits, wanted, n)
    return {x: key_at_most(id_cols, seed, x, k) for x, k in zip(splits, keys)}


def shuffle_splits(df: DataFrame, id_cols: list[str], n_splits: int = 50, test_size: float | int = 0.2,
                   seed: int = 42, n_rounds: int = 1, first_round: int = 0) -> DataFrame:
    """``n_rounds x n_splits`` independent hold-outs (sets may overlap).

    Output has one row per (input row, round, split) with ``is_test``: the
    only copies are those of the output, made at the scan."""
    member = split_membership(df, id_cols, n_splits, test_size, seed, n_rounds, first_round)
    flags = [F.struct(F.lit(r).alias("round"), F.lit(s).alias("split"), c.alias("is_test")) for (r, s), c in member.items()]
    return df.withColumn("_s", F.explode(F.array(*flags))).select(*df.columns, "_s.*")


def _fold_positions(sizes: DataFrame, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """Last position of folds 0..k-2: ``(i+1)*q + min(i+1, r) - 1``."""
    q = F.floor(F.col("n") / k)
    r = F.col("n") - q * k
    return (sizes.withColumn("tag", F.explode(F.sequence(F.lit(0), F.lit(k - 2))))
            .select(*groups, "tag",
                    ((F.col("tag") + 1) * q + F.least(F.col("tag") + 1, r) - 1).cast("long").alias("pos")))


def _assign_folds(b: DataFrame, order: Order, k: int, fold_col: str) -> DataFrame:
    if k <= 1:
        return b.withColumn(fold_col, F.lit(0))
    pos = _fold_positions(group_sizes(b, order), k, order.groups)
    thr = keys_at(b, order, pos, max_positions=k)
    out = attach_thresholds(b, order, thr, max_groups=1)
    return out.withColumn(fold_col, count_below(order).cast("int"))


def kfold_contiguous(df: DataFrame, order_cols: list[str], k: int = 5, fold_col: str = "fold",
                     n_buckets: int | None = None) -> DataFrame:
    """D3: unshuffled k-fold -- consecutive blocks in ``order_cols`` order.

    Sizes ``n // k + 1`` for the first ``n % k`` folds, ``n // k`` after.
    """
    b, order = value_order(df, order_cols, n_buckets=n_buckets)
    return _drop(_assign_folds(b, order, k, fold_col))


def kfold_after_split(df: DataFrame, id_cols: list[str], k: int = 5, test_size: float | int = 0.2,
                      seed: int = 42, fold_col: str = "fold", split_col: str = "split") -> DataFrame:
    """Contiguous folds over "train rows, then test rows" of D1.

    The D1 rows are stacked as in J3 (train first, each part in its hash
    order), which makes the folds effectively shuffled.
    """
    marked, horder = _holdout_marked(df, id_cols, test_size, seed)
    digits_span = horder.max_buckets
    b = marked.withColumn("_obkt", F.col("_is_test") * F.lit(digits_span) + F.col(BUCKET))
    order = Order(keys=("_is_test", *horder.keys), bucket="_obkt", max_buckets=2 * digits_span)
    out = _assign_folds(b.drop("_thr"), order, k, fold_col)
    out = out.withColumn(split_col, F.when(F.col("_is_test") == 1, "test").otherwise("train"))
    return _drop(out)


def bounded_sample(df: DataFrame, id_cols: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, seeded; the sample is the feature.

    The rows whose key ``md5(ids-seed)`` is among the first ``n`` keys --
    found like a hold-out boundary (bucket counts + one ranked bucket), so
    no task ever merges the per-partition top-n lists of a huge table.
    """
    out, _ = _holdout_marked(df, id_cols, int(n), seed)
    return _drop(out.where(F.col("_is_test") == 1))


def linspace_fractions(start: float = 0.1, stop: float = 1.0, num: int = 10) -> list[float]:
    return [float(x) for x in np.linspace(start, stop, num)]


def first_sizes(df: DataFrame, order_cols: list[str], k: int = 5, fractions: Sequence[float] | None = None,
                fold_col: str = "fold", n_buckets: int | None = None) -> tuple[DataFrame, list[int]]:
    """D5 without copies: ``fold_col`` and, for each held-out fold f, ``first_f``: the smallest
    training size whose subset holds the row (NULL: none).  Also returns the sizes."""
    fractions = list(fractions) if fractions is not None else linspace_fractions()
    b, order = value_order(df, order_cols, n_buckets=n_buckets)
    b = materialize(_assign_folds(b, order, k, fold_col).drop("_thr"))
    n = b.count()
    q, r = n // k, n % k
    n_max = n - (q + (1 if r else 0))
    sizes = sorted({min(max(math.floor(f * n_max), 1), n_max) for f in fractions}) if n_max > 0 else []
    wanted = []
    for f in range(k):
        start, size = f * q + min(f, r), q + (1 if f < r else 0)
        wanted += [(f, m, (m if m <= start else m + size) - 1) for m in sizes]
    positions = df.sparkSession.createDataFrame(wanted, "cv_fold int, m long, pos long") if wanted else None
    found = {}
    if positions is not None:
        at = keys_at(b, order, positions.select(F.struct("cv_fold", "m").alias("tag"), "pos"), max_positions=len(wanted))
        found = {(x["tag"]["cv_fold"], x["tag"]["m"]): [x[c] for c in order.keys] for x in at.collect()}  # k x sizes keys
    keys = [F.col(c) for c in order.keys]
    for f in range(k):
        first = F.lit(None).cast("long")
        for m in reversed(sizes):
            first = F.when(lex_le(keys, [F.lit(v) for v in found[(f, m)]]), F.lit(m).cast("long")).otherwise(first)
        b = b.withColumn(f"first_{f}", F.when(F.col(fold_col) != f, first))
    return _drop(b), sizes


def growing_prefixes(df: DataFrame, order_cols: list[str], k: int = 5,
                     fractions: Sequence[float] | None = None, fold_col: str = "fold",
                     n_buckets: int | None = None) -> DataFrame:
    """Learning-curve training subsets.

    ``n_max`` = training size of the first fold; sizes
    ``m = clip(floor(f * n_max), 1, n_max)`` (deduplicated); for each
    held-out fold ``cv_fold`` the subset is the first ``m`` rows of that
    fold's training part in order.  Output: one row per (row, cv_fold,
    train_size), exploded from :func:`first_sizes`.
    """
    b, sizes = first_sizes(df, order_cols, k, fractions, fold_col, n_buckets)
    return expand_sizes(b, sizes, k)


def expand_sizes(b: DataFrame, sizes: list[int], k: int) -> DataFrame:
    """One row per (row, cv_fold, train_size) from :func:`first_sizes`, made on the fly."""
    every = F.array(*[F.lit(m).cast("long") for m in sizes]) if sizes else F.array().cast("array<long>")

    def of_fold(f: int) -> Column:
        held = F.filter(every, lambda m: m >= F.col(f"first_{f}"))
        return F.transform(held, lambda m: F.struct(F.lit(f).alias("cv_fold"), m.alias("train_size")))

    per_fold = [of_fold(f) for f in range(k)]
    out = b.withColumn("_p", F.explode(F.concat(*per_fold)))
    return out.select(*[c for c in b.columns if not c.startswith("first_")], "_p.*")
