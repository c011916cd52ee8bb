import math

import pytest

from regimen.operators import clean, profile


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(cols[0]).collect()]


def test_minmax_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, c double")
    out = clean.minmax_features(df, ["a", "c"])
    assert rows(out, "a", "c") == [(0.0, 0.0), (1 / 3, 0.0), (1.0, 0.0)]


def test_minmax_nan_policy_zero(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert sorted(r.x for r in clean.minmax_features(df, ["x"], nan_policy="zero").collect()) == [0.0, 0.0, 0.0]
    skip = clean.minmax_features(df, ["x"]).collect()
    assert sorted((r.x for r in skip), key=lambda v: (v is None, v)) == [0.0, 1.0, None]


def test_minmax_rounded_zero_range_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, 3.0)], "c double, x double")
    out = clean.minmax_rounded(df, ["c", "x"]).collect()
    assert all(r.c is None for r in out)
    assert sorted(r.x for r in out) == [0.0, 0.5, 1.0]


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, c double")
    stats = clean.standardize_fit(df, ["a", "c"]).first()
    assert stats["__std__a"] == pytest.approx(1.247219, abs=1e-6)
    out = clean.standardize_apply(df, clean.standardize_fit(df, ["a", "c"]), ["a", "c"])
    assert all(r.c == 0.0 for r in out.collect())


def test_impute_mean_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    out = clean.impute_mean(df, ["a", "b"]).collect()
    assert sorted(r.a for r in out) == [1.0, 2.0, 3.0]
    assert all(r.b is None for r in out)


def test_impute_from_reference(spark):
    train = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0)], "x double, y double")
    ext = spark.createDataFrame([(None, 5.0, None), (4.0, None, None), (None, 7.0, 1.0)],
                                "x double, z double, y double")
    out = clean.impute_from_reference(ext, train, ["x", "z", "y"], label="y").collect()
    assert sorted(r.x for r in out) == [4.0, 15.0, 15.0]     # from training mean
    assert sorted(r.z for r in out) == [5.0, 6.0, 7.0]       # own mean (not in training)
    assert sorted(r.y for r in out) == [1.0, 2.0, 2.0]       # label filled from training
    keep = clean.impute_from_reference(ext, train, ["x", "z", "y"], label="y", fill_label=False).collect()
    assert [r.y for r in keep if r.y is not None] == [1.0]   # missing labels stay missing


def test_nan_normalised_to_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    out = clean.normalize_nan(df).collect()
    assert sorted((r.x for r in out), key=lambda v: (v is None, v)) == [1.0, None, None]


def test_zero_if_all_missing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, y double")
    assert [r.y for r in clean.zero_if_all_missing(df, "y").collect()] == [0.0, 0.0]


def test_clip_and_bround(spark):
    df = spark.createDataFrame([(-0.2, 0.125), (None, 2.5)], "y double, r double")
    out = clean.round_columns(clean.clip_columns(df, ["y"]), ["r"], 2).collect()
    assert [r.y for r in out] == [0.0, None]
    assert [r.r for r in out] == [0.12, 2.5]


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (4.0, 5.0, 8.0)], "a double, c double, y double")
    res = {r.feature: r.corr for r in profile.corr_with_target(df, ["a", "c"], "y").collect()}
    assert res["c"] is None
    assert res["a"] == pytest.approx(1.0)
    m = {(r.col_a, r.col_b): r.corr for r in profile.corr_matrix(df, ["a", "c", "y"]).collect()}
    assert m[("c", "c")] is None and m[("a", "a")] == 1.0 and m[("a", "y")] == pytest.approx(1.0)


def test_profile_sample_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    r = profile.column_profile(df, ["a"]).first()
    assert r["std"] == pytest.approx(math.sqrt(7 / 3))
    assert (r["min"], r["max"], r["count"]) == (1.0, 4.0, 3)


def test_shape_and_nulls_range_check(spark):
    ref = spark.createDataFrame([(88.0,), (97.0,)], "Al double")
    df = spark.createDataFrame([(0.01,), (95.0,), (None,)], "Al double")
    r = profile.shape_and_nulls(df, ["Al"], reference=ref).first()
    assert (r.n_null, r.n_out_of_range, r.n_rows) == (1, 1, 3)


def test_accept_runs_strict(spark):
    df = spark.createDataFrame([(0.89, 0.9), (0.9, 0.5), (0.95, 0.51)], "score double, score2 double")
    assert [tuple(r) for r in clean.accept_runs(df).collect()] == [(0.95, 0.51)]


def test_slug(spark):
    df = spark.createDataFrame([("Random Forest",)], "m string")
    assert df.select(clean.display_name_slug("m").alias("s")).first().s == "random_forest"


def test_population_scaler_in_a_pipeline(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, c double")
    model = Pipeline(stages=[clean.PopulationScaler(["a", "c"])]).fit(df)
    out = sorted(model.transform(df).collect(), key=lambda r: r.a)
    assert [r.c for r in out] == [0.0, 0.0, 0.0]
    assert out[0].a == pytest.approx((1 - 7 / 3) / 1.247219, abs=1e-6)
