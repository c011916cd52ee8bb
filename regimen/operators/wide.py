"""A3 over wide tables: pairwise correlations as masked Gram matrices.

Instead of one aggregate expression for each of the n(n-1)/2 pairs, tasks add up, for every pair of column
blocks, four small matrices of their Arrow batches: products, row counts, and sums and sums of squares over the
rows that have both values (missing ones are masked out pair by pair).  The matrices are added in two levels,
and the correlations of a pair of blocks are worked out where its last sum is, so no task and not the driver holds
more than a block's square, however many columns there are.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block; cells (pairs of columns) that one pass accumulates; partial sums of a pair of blocks.
BLOCK, CELLS, SUM_PARTS = 256, 1 << 22, 16
#: Rows that a task multiplies at a time.
SLICE = 2048

# The code below travels to the executors by value, so Python workers need only NumPy and Arrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def masked_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products, counts, sums of left and right values and of their squares over rows that have both (6 matrices)."""
    ml, mr = ~np.isnan(left), ~np.isnan(right)
    x, y = np.where(ml, left, 0.0), np.where(mr, right, 0.0)
    ml, mr = ml.astype(float), mr.astype(float)
    return np.stack([x.T @ y, ml.T @ mr, x.T @ mr, ml.T @ y, (x * x).T @ mr, ml.T @ (y * y)])


def correlations(sums: np.ndarray) -> np.ndarray:
    """Pearson's correlation of every pair; NaN where a column is constant over the pair's rows."""
    xy, n, x, y, xx, yy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = xx - x * x / n, yy - y * y / n
        vx, vy = np.where(vx > 1e-12 * xx, vx, 0.0), np.where(vy > 1e-12 * yy, vy, 0.0)
        return np.where((vx > 0) & (vy > 0), np.clip((xy - x * y / n) / np.sqrt(vx * vy), -1.0, 1.0), np.nan)


def corr_matrix_wide(df: DataFrame, cols: Sequence[str] | None = None, vector: str | None = None, size: int | None = None,
                     block: int = BLOCK) -> DataFrame:
    """``(col_a, col_b, corr)`` of all pairs of ``cols``, or of the ``size`` entries of the array column ``vector``
    (then col_a and col_b are 0-based numbers); NULL where a column is constant.  Null and NaN values are left out pair by pair."""
    if vector is None:
        cols = list(cols)
        values: Column = F.array(*[F.col(c).cast("double") for c in cols])
        size = len(cols)
    else:
        values = F.transform(F.slice(F.col(vector), 1, size), lambda v: v.cast("double"))
    data = df.select(values.alias("v"))
    # a constant near the values keeps the sums exact; any would do
    near = np.full(size, np.nan)
    for r in data.limit(100).collect():
        row = np.array([np.nan if v is None else v for v in (r["v"] or [])] + [np.nan] * size)[:size]
        near = np.where(np.isnan(near), row, near)
    near = np.where(np.isfinite(near), near, 0.0)
    edges = [(a, min(a + block, size)) for a in range(0, size, block)]
    pairs = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))]
    per_pass = max(1, CELLS // (block * block))
    schema = "pair int, part int, sums binary"

    def one_pass(wanted: dict[int, tuple[int, int]]) -> DataFrame:
        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext
            held = {}
            for batch in batches:
                rows = batch.column(0)
                for at in range(0, batch.num_rows, SLICE):
                    x = np.full((min(SLICE, batch.num_rows - at), size), np.nan)
                    for k, v in enumerate(rows.slice(at, SLICE)):
                        if v.is_valid:
                            own = v.values.to_numpy(zero_copy_only=False)[:size]
                            x[k, :len(own)] = own
                    x = np.where(np.isfinite(x), x, np.nan) - near
                    for p, (i, j) in wanted.items():
                        held[p] = held.get(p, 0.0) + masked_sums(x[:, slice(*edges[i])], x[:, slice(*edges[j])])
            part = TaskContext.get().partitionId() % SUM_PARTS
            for p, s in held.items():
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([part], pa.int32()), pa.array([s.tobytes()], pa.binary())],
                                      names=["pair", "part", "sums"])

        def add(group):
            import pyarrow as pa
            total = sum(np.frombuffer(s.as_py()) for s in group.column("sums"))
            return pa.table({"pair": pa.array([group.column("pair")[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()),
                             "sums": pa.array([total.tobytes()], pa.binary())})

        def finish(group):
            import pyarrow as pa
            p = group.column("pair")[0].as_py()
            (a, b), (c, d) = (edges[k] for k in wanted[p])
            total = sum(np.frombuffer(s.as_py()) for s in group.column("sums"))
            corr = correlations(total.reshape(6, b - a, d - c))
            left, right = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
            keep = left <= right if wanted[p][0] == wanted[p][1] else np.ones_like(left, bool)
            left, right, corr = left[keep], right[keep], corr[keep]
            mirror = left != right
            corr = np.where(left == right, np.where(np.isnan(corr), np.nan, 1.0), corr)
            value = np.concatenate([corr, corr[mirror]])
            return pa.table({"a": pa.array(np.concatenate([left, right[mirror]]), pa.int32()),
                             "b": pa.array(np.concatenate([right, left[mirror]]), pa.int32()), "corr": pa.array(value, mask=np.isnan(value))})

        parts = data.mapInArrow(run, schema).groupBy("pair", "part").applyInArrow(add, schema)
        return parts.groupBy("pair").applyInArrow(finish, "a int, b int, corr double")

    found = None
    for at in range(0, len(pairs), per_pass):
        one = one_pass(dict(enumerate(pairs[at:at + per_pass])))
        found = one if found is None else found.unionByName(one)
    if vector is not None:
        return found.select(F.col("a").alias("col_a"), F.col("b").alias("col_b"), "corr")
    name = F.array(*[F.lit(c) for c in cols])
    return found.select(F.get(name, F.col("a")).alias("col_a"), F.get(name, F.col("b")).alias("col_b"), "corr")
