from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from regimen.functions.exprs import hash_key
from regimen.operators import sampling
from regimen.operators.order import global_rank, hash_order


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "rid").withColumn("y", F.col("rid") * 1.0)


def test_holdout_exact_sizes(spark):
    for n, n_test in ((152, 31), (11, 3), (10000, 2000)):
        s = sampling.holdout_split(ids(spark, n), ["rid"], 0.2, 42)
        c = Counter(r.split for r in s.collect())
        assert c["test"] == n_test and c["train"] == n - n_test


def test_holdout_unchanged_under_repartition(spark):
    base = ids(spark, 5000)
    ref = {r.rid: r.split for r in sampling.holdout_split(base, ["rid"], 0.2, 42).collect()}
    for p in (1, 7, 50):
        got = {r.rid: r.split for r in sampling.holdout_split(base.repartition(p), ["rid"], 0.2, 42).collect()}
        assert got == ref


def test_holdout_is_first_keys_in_hash_order(spark):
    base = ids(spark, 300)
    expected = sorted(range(300), key=lambda i: (hash_str(spark, i), i))[:60]
    got = sorted(r.rid for r in sampling.holdout_split(base, ["rid"], 0.2, 42).where("split = 'test'").collect())
    assert got == sorted(expected)


_HASH_CACHE = {}


def hash_str(spark, i):
    if not _HASH_CACHE:
        for r in spark.range(300).select("id", hash_key("id", F.lit(42)).alias("h")).collect():
            _HASH_CACHE[r.id] = r.h
    return _HASH_CACHE[i]


def test_kfold_contiguous_sizes(spark):
    for n, sizes in ((152, [31, 31, 30, 30, 30]), (7, [2, 2, 1, 1, 1])):
        f = sampling.kfold_contiguous(ids(spark, n), ["rid"], 5).collect()
        c = Counter(r.fold for r in f)
        assert [c[i] for i in range(5)] == sizes
        # contiguous: fold is non-decreasing in the id order
        folds = [r.fold for r in sorted(f, key=lambda r: r.rid)]
        assert folds == sorted(folds)


def test_kfold_after_split_train_first(spark):
    f = sampling.kfold_after_split(ids(spark, 152), ["rid"], 5, 0.2, 42).collect()
    assert Counter(r.fold for r in f) == Counter({0: 31, 1: 31, 2: 30, 3: 30, 4: 30})
    # the 31 test rows are the last 31 positions -> all in the last folds
    test_folds = {r.fold for r in f if r.split == "test"}
    assert test_folds <= {3, 4}


def test_shuffle_splits_each_exact(spark):
    s = sampling.shuffle_splits(ids(spark, 152), ["rid"], n_splits=4, n_rounds=2).collect()
    c = Counter((r["round"], r.split) for r in s if r.is_test)
    assert len(c) == 8 and set(c.values()) == {31}
    sets = {}
    for r in s:
        if r.is_test:
            sets.setdefault((r["round"], r.split), set()).add(r.rid)
    assert len({frozenset(v) for v in sets.values()}) == 8


def test_global_rank_matches_row_number(spark):
    base = spark.range(2000).withColumnRenamed("id", "k")
    b, order = hash_order(base, ["k"], salt=[F.lit(3)])
    got = {r.k: r.pos for r in global_rank(b, order).collect()}
    w = Window.orderBy(hash_key("k", F.lit(3)), "k")
    exp = {r.k: r.p for r in base.select("k", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert got == exp


def test_bounded_sample(spark):
    assert sampling.bounded_sample(ids(spark, 3000), ["rid"], 1000).count() == 1000
    assert sampling.bounded_sample(ids(spark, 500), ["rid"], 1000).count() == 500


def test_growing_prefixes_are_prefixes(spark):
    n, k = 152, 5
    p = sampling.growing_prefixes(ids(spark, n), ["rid"], k).collect()
    by = {}
    for r in p:
        by.setdefault((r.cv_fold, r.train_size), []).append(r.rid)
    n_max = n - 31
    sizes = sorted({m for _, m in by})
    assert sizes == sorted({max(1, min(int(f * n_max), n_max)) for f in sampling.linspace_fractions()})
    for (f, m), rows in by.items():
        assert len(rows) == m
        train_order = [i for i in range(n) if not (f * 30 + min(f, 2) <= i < (f + 1) * 30 + min(f + 1, 2))]
        assert sorted(rows) == train_order[:m]


def test_plans_have_no_single_partition_over_rows(spark):
    import re

    for s in (sampling.holdout_split(ids(spark, 1000), ["rid"], 0.2, 42), sampling.kfold_contiguous(ids(spark, 1000), ["rid"], 5),
              sampling.shuffle_splits(ids(spark, 1000), ["rid"], n_splits=3)):
        plan = s._jdf.queryExecution().executedPlan().toString().split("\n")
        at = [i for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
        for i in at:  # what goes to one task has been aggregated right below the exchange, or is a partial aggregate
            below = next(line for line in plan[i + 1:] if not re.search(r"WholeStageCodegen|InputAdapter|\(\d+\) Project|- Project|Filter", line))
            assert "Aggregate" in below, below


def test_kfold_with_a_heavy_first_key(spark):
    """A first-column value holding a third of the rows is split by the
    second column: buckets stay small and the folds stay exact."""
    from regimen.operators.order import bucket_counts, value_order

    n = 30000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("a"),
                               F.col("id").alias("b"))
    b, order = value_order(df, ["a", "b"], n_buckets=256)
    assert max(r._n for r in bucket_counts(b, order).collect()) < n // 20
    rows = sampling.kfold_contiguous(df, ["a", "b"], 5, n_buckets=256).collect()
    ranked = {k: i for i, k in enumerate(sorted((r.a, r.b) for r in rows))}
    assert all(r.fold == ranked[(r.a, r.b)] // (n // 5) for r in rows)


def test_value_order_of_text_keys_and_ties(spark):
    n = 999
    text_keys = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("k"))
    rows = sampling.kfold_contiguous(text_keys, ["k"], 3).collect()
    ranked = {k: i for i, k in enumerate(sorted(r.k for r in rows))}
    assert all(r.fold == ranked[r.k] // 333 for r in rows)
    # a hot first key, a text second key, ties on both with a third
    tied = spark.range(n).select(F.lit(1).alias("a"), F.when(F.col("id") % 3 == 0, "x").otherwise(
        F.col("id").cast("string")).alias("b"), F.col("id").alias("c"))
    rows = sampling.kfold_contiguous(tied, ["a", "b", "c"], 3, n_buckets=32).collect()
    ranked = {k: i for i, k in enumerate(sorted((r.a, r.b, r.c) for r in rows))}
    assert all(r.fold == ranked[(r.a, r.b, r.c)] // 333 for r in rows)


def test_hash_thresholds_equal_the_sorted_keys(spark):
    from regimen.operators.order import hash_thresholds

    d = ids(spark, 3000)
    for wanted in (1, 600, 3000):
        got = hash_thresholds(d, ["rid"], 42, [(0, 0), (3, 7)], wanted, 3000)
        for (r, s), key in zip([(0, 0), (3, 7)], got):
            keys = sorted((x[0], x[1]) for x in d.select(hash_key("rid", F.lit(42), F.lit(r), F.lit(s)), "rid").collect())
            assert keys[wanted - 1] == key


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_large_buckets_are_refined_to_the_same_keys(spark, digits):
    """With few digits and a small bound, positions are found by further digits: same keys, no large bucket ranked."""
    from regimen.operators import order as O

    df = spark.range(3000).selectExpr("id % 1500 as i", "id as j")     # every hash occurs twice
    b, order = O.hash_order(df, ["i"], digits=digits)
    order = O.Order(keys=(O.ORDER_KEY, "j"), bucket=order.bucket, max_buckets=order.max_buckets, digits=digits)
    wanted = [0, 1, 2, 599, 600, 1501, 2998, 2999, 5000]
    pos = spark.createDataFrame([(k, p) for k, p in enumerate(wanted)], "tag int, pos long")
    rows = sorted((r[O.ORDER_KEY], r["j"]) for r in b.collect())
    for bound in (1, 5, 1 << 20):
        got = {r["tag"]: (r[O.ORDER_KEY], r["j"]) for r in O.keys_at(b, order, pos, 100, bound).collect()}
        assert got == {k: rows[p] for k, p in enumerate(wanted) if p < 3000}


def test_refined_buckets_hold_no_more_than_the_bound(spark, monkeypatch):
    from regimen.operators import order as O

    seen = []
    ranked = O._ranked_at

    def watched(df, order, targets, bucket, max_positions):
        on = df.join(targets.select(bucket).distinct(), bucket, "left_semi").groupBy(bucket).count()
        seen.extend(r["count"] for r in on.collect())
        return ranked(df, order, targets, bucket, max_positions)

    monkeypatch.setattr(O, "_ranked_at", watched)
    b, order = O.hash_order(spark.range(4000).withColumnRenamed("id", "i"), ["i"], digits=1)
    pos = spark.createDataFrame([(0, 799), (1, 3999)], "tag int, pos long")
    assert len(O.keys_at(b, order, pos, 2, 10).collect()) == 2
    assert seen and max(seen) <= 10
