"""Exact positions in a total order without a single-partition window.

A global ``row_number()`` over row data sends every row to one task.  Here
the order is cut into *buckets* by a column that is monotone in the order
key (a hash prefix, or range partitions of the key).  Only the bucket
counts (at most ``n_buckets`` rows per group) are aggregated and summed
into offsets; the rows themselves are ranked inside their bucket.

Two uses:

* ``global_rank`` gives every row its position (one shuffle by bucket).
* ``keys_at`` finds the order key at a handful of exact positions (split
  boundaries, fold ends).  Only the rows of the buckets that contain those
  positions are ranked, so a hold-out split or a k-fold assignment costs a
  count aggregate plus a map-side comparison -- no shuffle of the rows.
  In a hash order, a bucket that holds a wanted position and more rows than
  a task should rank is cut again by the next digits of the hash (radix
  selection), until it is small enough.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimen.functions.exprs import hash_key, lex_le
from regimen.session import materialize

ORDER_KEY = "_okey"
BUCKET = "_bkt"
# Tables with at most this many rows are broadcast; beyond it a shuffle join.
BROADCAST_ROW_LIMIT = 1 << 20
# Hash-prefix digits; 16**4 buckets keep a bucket to about n / 65536 rows
# (15M rows per task at 10^12 rows).
DEFAULT_HASH_DIGITS = 4
#: Rows of one bucket that a task ranks at most, and digits by which a larger one is cut again.
MAX_RANKED, MORE_DIGITS, HASH_LENGTH = 1 << 20, 4, 32


@dataclass(frozen=True)
class Order:
    keys: tuple[str, ...]          # total order, ascending, all non-null
    bucket: str                    # monotone non-decreasing in ``keys``
    groups: tuple[str, ...] = ()   # independent orders per group
    max_buckets: int = 16 ** DEFAULT_HASH_DIGITS  # bound of (group, bucket) pairs
    digits: int = 0                # > 0: the bucket is so many first digits of the hexadecimal hash keys[0]


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast only a side whose row count is bounded by construction."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROW_LIMIT else df


def hash_order(df: DataFrame, id_cols: list[str], salt: list[str | Column] | None = None,
               groups: list[str] | None = None, n_groups: int = 1,
               digits: int = DEFAULT_HASH_DIGITS) -> tuple[DataFrame, Order]:
    """Order rows by ``md5(concat_ws('-', ids..., salt...))`` then ids."""
    okey = hash_key(*id_cols, *(salt or []))
    out = df.withColumn(ORDER_KEY, okey).withColumn(
        BUCKET, F.conv(F.substring(F.col(ORDER_KEY), 1, digits), 16, 10).cast("int"))
    return out, Order(keys=(ORDER_KEY, *id_cols), bucket=BUCKET,
                      groups=tuple(groups or ()), max_buckets=n_groups * 16 ** digits, digits=digits)


def value_order(df: DataFrame, order_cols: list[str], n_buckets: int | None = None,
                groups: list[str] | None = None, n_groups: int = 1) -> tuple[DataFrame, Order]:
    """Order rows by their own columns, of any orderable type (e.g. a row id).

    A bucket is a range partition over ALL order columns, so neither a skewed
    first column nor one value with a third of the rows makes a large bucket.
    The partitioned rows are written once to the shared checkpoint folder
    with their bucket number; without ``n_buckets`` their number is the
    session's shuffle partitions."""
    n_buckets = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_buckets, *order_cols).withColumn(BUCKET, F.spark_partition_id().cast("long"))
    return materialize(ranged), Order(keys=tuple(order_cols), bucket=BUCKET, groups=tuple(groups or ()),
                                      max_buckets=n_groups * n_buckets)


def bucket_counts(df: DataFrame, order: Order) -> DataFrame:
    """``[groups..., _bkt, _n, _off, _total]`` -- one row per non-empty bucket."""
    g = list(order.groups)
    counts = df.groupBy(*g, order.bucket).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*g).orderBy(order.bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (counts
            .withColumn("_off", F.coalesce(F.sum("_n").over(running), F.lit(0)).cast("long"))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy(*g)).cast("long")))


def group_sizes(df: DataFrame, order: Order) -> DataFrame:
    """``[groups..., n]`` from the bucket counts (small)."""
    g = list(order.groups)
    return bucket_counts(df, order).groupBy(*g).agg(F.max("_total").alias("n"))


def global_rank(df: DataFrame, order: Order, out: str = "pos") -> DataFrame:
    """Add the exact 0-based position of every row in ``order`` (per group)."""
    g = list(order.groups)
    offsets = bucket_counts(df, order).select(*g, order.bucket, "_off")
    w = Window.partitionBy(*g, order.bucket).orderBy(*order.keys)
    ranked = df.withColumn("_rn", F.row_number().over(w))
    return (ranked.join(maybe_broadcast(offsets, order.max_buckets), on=[*g, order.bucket])
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_rn", "_off"))


def keys_at(df: DataFrame, order: Order, positions: DataFrame, max_positions: int,
            max_ranked: int = MAX_RANKED) -> DataFrame:
    """Order keys found at exact positions.

    ``positions``: ``[groups..., tag, pos]`` (0-based per group, small).
    Returns ``[groups..., tag, keys...]``; positions outside ``[0, n)`` give
    no row.  Only rows of the buckets holding a wanted position are ranked.
    """
    g = list(order.groups)
    counts = bucket_counts(df, order)
    joined = positions.join(counts, on=g) if g else positions.crossJoin(counts)
    targets = (joined.where((F.col("pos") >= F.col("_off")) & (F.col("pos") < F.col("_off") + F.col("_n")))
               .select(*g, "tag", order.bucket, (F.col("pos") - F.col("_off")).alias("_need"), "_n"))
    if not order.digits or max_positions > BROADCAST_ROW_LIMIT:
        return _ranked_at(df, order, targets.drop("_n"), order.bucket, max_positions)
    spark, schema = df.sparkSession, targets.schema
    found = targets.collect()   # one row a wanted position
    small = [t for t in found if t["_n"] <= max_ranked]
    out = [_ranked_at(df, order, spark.createDataFrame(small, schema).drop("_n"), order.bucket, max_positions)] if small or not found else []
    large = [t for t in found if t["_n"] > max_ranked]
    if large:
        out += _refined(df, order, spark.createDataFrame(large, schema), max_ranked, max_positions)
    return reduce(DataFrame.unionByName, out)


def _ranked_at(df: DataFrame, order: Order, targets: DataFrame, bucket: str, max_positions: int) -> DataFrame:
    """Keys of the rows number ``_need`` of their ``bucket``: ``[groups..., tag, keys...]``."""
    g = list(order.groups)
    boundary = targets.select(*g, bucket).distinct()
    cand = df.join(maybe_broadcast(boundary, max_positions), on=[*g, bucket], how="left_semi")
    w = Window.partitionBy(*g, bucket).orderBy(*order.keys)
    cand = cand.select(*g, bucket, *[k for k in order.keys if k != bucket]).withColumn("_rn0", F.row_number().over(w) - 1)
    return (cand.join(maybe_broadcast(targets, max_positions), on=[*g, bucket])
            .where(F.col("_rn0") == F.col("_need"))
            .select(*g, "tag", *order.keys))


def _refined(df: DataFrame, order: Order, targets: DataFrame, max_ranked: int, max_positions: int) -> list[DataFrame]:
    """Radix selection of positions in large buckets: one count pass a level, over the rows of those buckets only."""
    g, hashed, digits, spark = list(order.groups), order.keys[0], order.digits, df.sparkSession
    start = F.lower(F.lpad(F.conv(F.col(order.bucket).cast("string"), 10, 16), digits, "0"))
    targets = targets.select(*g, "tag", start.alias("_pre"), "_need")
    out, schema = [], None
    while True:
        more = min(MORE_DIGITS, HASH_LENGTH - digits)
        rows = df.withColumn("_pre", F.substring(hashed, 1, digits))
        if not more:  # equal hashes: only the further keys tell the rows apart
            return [*out, _ranked_at(rows, order, targets, "_pre", max_positions)]
        inside = rows.join(maybe_broadcast(targets.select(*g, "_pre").distinct(), max_positions), [*g, "_pre"], "left_semi")
        counts = inside.groupBy(*g, "_pre", F.substring(hashed, digits + 1, more).alias("_sub")).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*g, "_pre").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        hit = (targets.join(counts, [*g, "_pre"]).where("_need >= _off and _need < _off + _n")
               .select(*g, "tag", F.concat("_pre", "_sub").alias("_pre"), (F.col("_need") - F.col("_off")).alias("_need"), "_n"))
        schema, found = hit.schema, hit.collect()   # one row a wanted position
        digits += more
        small, large = [[t for t in found if (t["_n"] <= max_ranked) == fits] for fits in (True, False)]
        if small:
            rows = df.withColumn("_pre", F.substring(hashed, 1, digits))
            out.append(_ranked_at(rows, order, spark.createDataFrame(small, schema).drop("_n"), "_pre", max_positions))
        if not large:
            return out
        targets = spark.createDataFrame(large, schema).drop("_n")


def attach_thresholds(df: DataFrame, order: Order, thresholds: DataFrame, max_groups: int,
                      out: str = "_thr") -> DataFrame:
    """Attach, per group, the array of threshold keys sorted by ``tag``.

    ``thresholds``: output of :func:`keys_at`.  Each group gets one small
    array (its number of thresholds is a parameter, e.g. ``k - 1`` folds).
    """
    g = list(order.groups)
    key_struct = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(order.keys)])
    arr = (thresholds.groupBy(*g)
           .agg(F.array_sort(F.collect_list(F.struct(F.col("tag").alias("tag"), key_struct.alias("key"))))
                .alias(out)))
    side = maybe_broadcast(arr, max_groups)
    if g:
        return df.join(side, on=g, how="left")
    return df.join(side, on=F.lit(True), how="left")


def count_below(order: Order, thr_col: str = "_thr") -> Column:
    """Number of thresholds strictly below the row's key (NULL array -> 0)."""
    keys = [F.col(k) for k in order.keys]

    def above(t: Column) -> Column:
        tk = [t["key"][f"k{i}"] for i in range(len(order.keys))]
        return ~lex_le(keys, tk)

    return F.coalesce(F.size(F.filter(F.col(thr_col), above)), F.lit(0))


def at_or_below(order: Order, thr_col: str = "_thr") -> Column:
    """Row key <= the first threshold of its group (NULL -> false)."""
    keys = [F.col(k) for k in order.keys]
    t = F.get(F.col(thr_col), 0)["key"]
    tk = [t[f"k{i}"] for i in range(len(order.keys))]
    return F.coalesce(lex_le(keys, tk), F.lit(False))


def hash_thresholds(df: DataFrame, id_cols: list[str], seed: int, splits: list[tuple[int, int]], wanted: int,
                    n_rows: int) -> list[tuple]:
    """For each (round, split), the order key (hash, ids...) of the ``wanted``-th row in that split's hash order.

    A hash is uniform, so the wanted row lies near the share wanted / n_rows
    of the hash space: one pass counts the rows below a narrow window of six
    standard deviations and keeps the rows inside it, about sqrt(n_rows) for
    each split; a window that misses (never seen) is widened.  No copy of the
    table is written; what comes back is one key a split."""
    spark = df.sparkSession
    share = wanted / n_rows
    width = 6.0 * ((share * (1 - share) + 1.0 / n_rows) / n_rows) ** 0.5
    found: dict[tuple[int, int], tuple] = {}
    todo = list(splits)
    while todo:
        low, high = (f"{int(min(max(x, 0.0), 1.0) * (2 ** 64 - 1)):016x}" for x in (share - width, share + width))
        low, high = ("" if share - width <= 0 else low), ("g" if share + width >= 1 else high)
        which = spark.createDataFrame(todo, "round int, split int")
        keyed = (df.select(*id_cols).join(F.broadcast(which))  # a parameter's number of rows: the splits asked for
                 .withColumn(ORDER_KEY, hash_key(*id_cols, F.lit(seed), "round", "split")))
        below = {(r["round"], r["split"]): r["n"] for r in keyed.groupBy("round", "split").agg(
            F.count_if(F.col(ORDER_KEY) < low).alias("n")).collect()}
        inside = keyed.where((F.col(ORDER_KEY) >= low) & (F.col(ORDER_KEY) < high))
        rank = F.row_number().over(Window.partitionBy("round", "split").orderBy(ORDER_KEY, *id_cols))
        at = spark.createDataFrame([(r, s, wanted - below.get((r, s), 0)) for r, s in todo], "round int, split int, need long")
        rows = (inside.withColumn("rank", rank).join(F.broadcast(at), ["round", "split"])
                .where(F.col("rank") == F.col("need")).collect())
        for r in rows:
            found[(r["round"], r["split"])] = tuple(r[c] for c in (ORDER_KEY, *id_cols))
        todo = [x for x in todo if x not in found]
        width *= 4
    return [found[x] for x in splits]


def key_at_most(id_cols: list[str], seed: int, split: tuple[int, int], key: tuple) -> Column:
    """Whether a row is at or before ``key`` in the hash order of a (round, split)."""
    own = [hash_key(*id_cols, F.lit(seed), F.lit(split[0]), F.lit(split[1])), *[F.col(c) for c in id_cols]]
    return lex_le(own, [F.lit(x) for x in key])
