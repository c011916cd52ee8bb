"""Statistics of very many shuffled hold-outs in a handful of passes, without a row per row and split.

A row has, for every (round, split), a key below 2^31 - 1: (h1 * a + h2 * b + c) mod (2^31 - 1), where
h1, h2 come from ONE md5 of the row's id and a, b, c from the md5 of (seed, round, split).  A split's test rows are
the ``wanted`` rows with the smallest keys; equal keys are ordered by the id.

* Thresholds: vector radix selection.  Each pass counts, for all open splits at once, the keys in 256 equal parts of
  the interval that holds the split's threshold; the counts are summed over tasks in two levels, and each interval
  shrinks to one part.  The first interval is where the quantile of evenly spread keys lies, and counts the keys below
  it too: a split whose threshold is elsewhere starts again with all keys.  A split is done when a part's border has
  exactly ``wanted`` keys below it, usually after two passes; equal keys at a threshold are settled among the rows that have them.
* Statistics: one more pass adds every row's values to vectors indexed by split.

What travels is a few numbers a split and task; rows never leave their tasks and no row is written or copied.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimen.functions.exprs import nan_to_null

PRIME = (1 << 31) - 1
PARTS = 256
#: Splits whose keys are worked out together, and rows at a time: their keys stay in a core's cache.
BLOCK, ROWS = 2048, 32
#: Half of the first interval, in standard deviations of the place of a threshold among evenly spread keys.
SPREAD = 8.0
#: Partial sums of a block's vectors before the total.
SUM_PARTS = 16

# The code below travels to the executors by value, so Python workers need only NumPy and Arrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def split_factors(seed: int, n_rounds: int, n_splits: int) -> np.ndarray:
    """(a, b, c) of every split, in order of (round, split)."""
    out = np.empty((n_rounds * n_splits, 3), np.uint64)
    for i in range(len(out)):
        digest = hashlib.md5(f"{seed}-{i // n_splits}-{i % n_splits}".encode()).hexdigest()
        out[i] = [int(digest[k:k + 8], 16) % PRIME for k in (0, 8, 16)]
    return out


def split_keys(h1: np.ndarray, h2: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Keys (rows x splits).  h1 * a + h2 * b + c fits 64 bits, and 2^31 is 1 modulo 2^31 - 1: halves are added, not divided."""
    a, b, c = np.ascontiguousarray(factors.T)
    prime, bits = np.uint64(PRIME), np.uint64(31)
    keys = h1[:, None] * a
    other = h2[:, None] * b
    keys += other
    keys += c
    if PRIME != (1 << 31) - 1:
        return keys % prime
    for _ in range(2):
        np.right_shift(keys, bits, out=other)
        keys &= prime
        keys += other
    keys -= prime * (keys >= prime)
    return keys


def keyed_rows(df: DataFrame, id_cols: Sequence[str], label: str) -> DataFrame:
    """(h1, h2, y, id columns): one md5 a row."""
    digest = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in id_cols]))
    word = lambda at: (F.conv(F.substring("_m", at, 8), 16, 10).cast("long") % F.lit(PRIME))
    return df.withColumn("_m", digest).select(word(1).alias("_h1"), word(9).alias("_h2"), nan_to_null(label).alias("_y"), *id_cols)


def _pieces(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        h1, h2 = (batch.column(c).to_numpy().astype(np.uint64) for c in ("_h1", "_h2"))
        y = batch.column("_y").to_numpy(zero_copy_only=False).astype(float)
        for at in range(0, len(h1), ROWS):
            yield h1[at:at + ROWS], h2[at:at + ROWS], y[at:at + ROWS]


def _sums(rows: DataFrame, count: int, width: int, add) -> np.ndarray:
    """Totals (splits x width) of what ``add(h1, h2, y, first, last, into)`` adds up for blocks of splits, in two levels."""
    blocks = [(b, min(b + BLOCK, count)) for b in range(0, count, BLOCK)]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        held = None
        for h1, h2, y in _pieces(batches):
            held = held or [np.zeros((last - first, width)) for first, last in blocks]
            for (first, last), into in zip(blocks, held):
                add(h1, h2, y, first, last, into)
        part = TaskContext.get().partitionId() % SUM_PARTS
        for i, into in enumerate(held or []):
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([into.tobytes()], pa.binary())],
                                  names=["block", "part", "sums"])

    def total(group):
        import pyarrow as pa
        one = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
        return pa.table({"block": [group.column("block")[0].as_py()], "part": [0], "sums": [one.tobytes()]},
                        schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())]))

    schema = "block int, part int, sums binary"
    parts = rows.select("_h1", "_h2", "_y").mapInArrow(run, schema).groupBy("block", "part").applyInArrow(total, schema)
    found = {r["block"]: r["sums"] for r in parts.groupBy("block").applyInArrow(total, schema).collect()}
    return np.concatenate([np.frombuffer(found[i]).reshape(-1, width) if i in found else np.zeros((last - first, width))
                           for i, (first, last) in enumerate(blocks)])


def thresholds(rows: DataFrame, factors: np.ndarray, wanted: int, id_cols: Sequence[str]) -> tuple[np.ndarray, DataFrame | None]:
    """For every split a bound below which keys are test keys, and the rows that are test rows besides:
    (``_split``, id columns), or None."""
    n = len(factors)
    total = rows.count()
    share = wanted / max(total, 1)
    half = math.ceil(SPREAD * math.sqrt(share * (1 - share) / max(total, 1)) * PRIME) + PARTS
    start = max(0, round(share * PRIME) - half)
    low, width = np.full(n, start, np.int64), np.full(n, 2 * half, np.int64)  # the interval that holds the threshold
    below, bound = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    first_pass = True
    while len(open_ := np.flatnonzero((bound < 0) & (width > 1))):
        step = np.maximum(1, -(-width[open_] // PARTS))
        own, at_low, at_step, at_width = factors[open_], *(v.astype(np.uint64) for v in (low[open_], step, step * PARTS))

        def add(h1, h2, y, first, last, into):
            keys = split_keys(h1, h2, own[first:last])
            if first_pass:
                into[:, PARTS] += (keys < at_low[first:last]).sum(axis=0)
            keys -= at_low[first:last]  # below the interval: wraps, far above its width
            found = np.flatnonzero(keys < at_width[first:last])
            c = found % (last - first)
            part = keys.ravel()[found] // at_step[first:last][c]
            np.add.at(into.reshape(-1), c * (PARTS + 1) + part.astype(np.int64), 1.0)  # few a tile

        counts = _sums(rows, len(open_), PARTS + 1, add).astype(np.int64)
        under = counts[:, PARTS] if first_pass else below[open_]
        upto = under[:, None] + counts[:, :PARTS].cumsum(axis=1)
        inside = ((under < wanted) | (low[open_] == 0)) & (upto[:, -1] >= wanted)
        out = open_[~inside]
        low[out], width[out], below[out] = 0, 1 << 31, 0  # all keys, next
        exact = upto == wanted
        hit = inside & exact.any(axis=1)
        bound[open_[hit]] = (low[open_] + step * (exact.argmax(axis=1) + 1))[hit]
        part = (upto < wanted).sum(axis=1)  # the part that crosses
        go = inside & ~hit
        at = open_[go]
        below[at] = np.where(part > 0, upto[np.arange(len(open_)), np.maximum(part - 1, 0)], under)[go]
        low[at] += (step * part)[go]
        width[at] = step[go]
        first_pass = False
    ties = np.flatnonzero(bound < 0)
    if not len(ties):
        return bound, None
    bound[ties] = low[ties]  # rows with exactly this key: the first ones by id
    need = wanted - below[ties]
    spark = rows.sparkSession
    table = spark.createDataFrame([(int(s), int(low[s]), *map(int, factors[s]), int(k)) for s, k in zip(ties, need)],
                                  "_split int, _key long, _a long, _b long, _c long, _need long")
    key = ((F.col("_h1") * F.col("_a") % PRIME) + (F.col("_h2") * F.col("_b") % PRIME) + F.col("_c")) % PRIME
    same = rows.join(F.broadcast(table), key == F.col("_key"))  # a few splits: those with equal keys at the threshold
    rank = F.row_number().over(Window.partitionBy("_split").orderBy(*id_cols))
    return bound, same.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_need"))


def split_statistics(df: DataFrame, id_cols: Sequence[str], label: str, n_rounds: int = 500, n_splits: int = 50,
                     test_size: float | int = 0.2, seed: int = 42) -> DataFrame:
    """(round, split, n_train, n_test, train_mean, test_mean, score): the mean predictor on every hold-out.

    ``score`` is R^2 on the test rows (A4's rule for constant labels).  Rows without a label are split, but not counted."""
    rows = keyed_rows(df, id_cols, label)
    total = rows.agg(F.count("*").alias("rows"), F.count("_y").alias("n"), F.avg("_y").alias("mean"), F.sum("_y").alias("sum")).first()
    spark, count = df.sparkSession, n_rounds * n_splits
    schema = "round int, split int, n_train long, n_test long, train_mean double, test_mean double, score double"
    if not total["n"]:
        return spark.createDataFrame([], schema)
    wanted = min(test_size, total["rows"]) if isinstance(test_size, int) and not isinstance(test_size, bool) else math.ceil(
        round(test_size * total["rows"], 9))
    factors, centre = split_factors(seed, n_rounds, n_splits), total["mean"]
    bound, extra = thresholds(rows, factors, wanted, id_cols)
    limit = bound.astype(np.uint64)

    def add(h1, h2, y, first, last, into):
        known = ~np.isnan(y)
        test = (split_keys(h1[known], h2[known], factors[first:last]) < limit[first:last]).astype(float)
        d = y[known] - centre
        into += test.T @ np.column_stack([np.ones(len(d)), d, d * d])

    sums = _sums(rows, count, 3, add)
    if extra is not None:
        own = extra.where("_y is not null").groupBy("_split").agg(F.count("*").alias("n"), F.sum(F.col("_y") - centre).alias("s"),
                                                                   F.sum((F.col("_y") - centre) ** 2).alias("ss"))
        for r in own.collect():
            sums[r["_split"]] += [r["n"], r["s"], r["ss"]]
    n, s, ss = sums.T
    all_s = total["sum"] - total["n"] * centre
    with np.errstate(divide="ignore", invalid="ignore"):
        n_train = total["n"] - n
        train, mean = (all_s - s) / n_train, s / n
        spread = ss - s * s / n
        left = ss - 2 * train * s + n * train * train
        spread = np.where(spread <= 1e-12 * np.maximum(ss, 1e-300), 0.0, spread)
        score = np.where(spread > 0, 1 - left / spread, np.where(left <= 1e-12 * np.maximum(ss, 1e-300), 1.0, 0.0))
    number = lambda x: float(x) if np.isfinite(x) else None
    found = [(i // n_splits, i % n_splits, int(n_train[i]), int(n[i]), number(train[i] + centre), number(mean[i] + centre),
              number(score[i]) if n[i] >= 2 and n_train[i] else None) for i in range(count)]
    return spark.createDataFrame(found, schema)
