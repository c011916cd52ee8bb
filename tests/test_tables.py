from pyspark.sql import functions as F

import pytest

from regimen.operators import clean, models, ranking, solvers
from regimen.sources import tables


def test_csv_reader_bad_numbers_and_nan(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,y\n1.5,x,NaN\n,2,3\n")
    out = tables.read_table_csv(spark, str(p)).collect()
    assert [(r.a, r.b, r.y) for r in out] == [(1.5, None, None), (None, 2.0, 3.0)]


def test_tsv_reader_crlf(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes(b"1\t2\t3\r\n4\t\t6\r\n")
    out = tables.read_table_tsv(spark, str(p), ["a", "b", "c"]).collect()
    assert [(r.a, r.b, r.c) for r in out] == [(1.0, 2.0, 3.0), (4.0, None, 6.0)]


def test_run_log_append_and_format(spark, tmp_path):
    df = spark.createDataFrame([(3, 7, 0.912345678, 0.6)], "round int, split int, score double, score2 double")
    assert tables.run_records(df).first().record == "3    7  0.91235    0.60000"
    path = str(tmp_path / "log")
    tables.append_run_log(df, path)
    tables.append_run_log(df, path)
    assert spark.read.text(path).count() == 2


def test_scored_name_forms(spark):
    df = spark.createDataFrame([(0.5699, 0.125)], "s double, v double")
    stamp = F.lit("20260101-000000")
    r = df.select(tables.scored_name("s", "v", stamp, integer=True).alias("i"),
                  tables.scored_name("s", None, stamp).alias("f")).first()
    # round(0.5699, 2) * 100 is 56.99999999999999 in doubles (as in Python); %d truncates it to 56
    assert r.i == "56-12-20260101-000000"
    assert r.f == f"{round(0.5699, 2) * 100!r}-20260101-000000"


def test_save_and_load_model_with_registry(spark, tmp_path):
    d = spark.range(200).select((F.col("id") % 50).cast("double").alias("q"),
                                F.when(F.col("id") % 50 > 25, 10.0).otherwise(2.0).alias("y"))
    m = models.random_forest(["q"], "y", num_trees=3, max_depth=3, max_bins=64).fit(d)
    path = tables.save_model(m, str(tmp_path / "models"), "random_forest", 0.93, 0.61,
                             registry=str(tmp_path / "registry"))
    back = tables.load_model(path)
    assert back.transform(d).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] == 0.0
    reg = spark.read.parquet(str(tmp_path / "registry")).first()
    assert reg.model == "random_forest" and reg.path == path


def test_csv_columns_go_by_name(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c\n1,2,3\n")
    assert tuple(tables.read_table_csv(spark, str(p), ["b"]).first()) == (2.0,)
    assert tuple(tables.read_table_csv(spark, str(p), ["c", "a"]).first()) == (3.0, 1.0)
    with pytest.raises(ValueError):
        tables.read_table_csv(spark, str(p), ["a", "z"])


def test_own_models_round_trip(spark, tmp_path):
    d = spark.range(60).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")) \
        .withColumn("y", F.col("a") * 0.5 - F.col("b"))
    fitted = [solvers.SVR(["a", "b"], "y", kernel="rbf", n_components=8, max_iter=2).fit(d),
              solvers.MLPRegressor(["a", "b"], "y", hidden=(4,), epochs=2).fit(d),
              clean.PopulationScaler(["a", "b"]).fit(d)]
    for i, m in enumerate(fitted):
        back = tables.load_model(tables.save_model(m, str(tmp_path), f"m{i}", 0.5))
        assert type(back) is type(m)
        assert back.transform(d).collect() == m.transform(d).collect()


def test_compare_datasets_ranks_by_the_first_r2(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.9), ("z", None)], "model string, r2 double")
    out = ranking.compare_datasets(a, a, metrics=["r2"])
    assert {r["model"]: r["rank"] for r in out.collect()} == {"y": 1, "x": 2, "z": 3}


def test_reference_fill_leaves_a_partly_missing_label(spark):
    ext = spark.createDataFrame([(1.0, 5.0), (None, None), (3.0, 9.0)], "x double, y double")
    out = clean.impute_from_reference(ext, ext, ["x", "y"], label="y", fill_label=False).collect()
    assert [r.y for r in out] == [5.0, None, 9.0] and out[1].x == 2.0


def test_numbers_are_read_alike_by_all_readers(spark, tmp_path):
    from regimen.sources import text

    tokens = ["1.0d", "2.0f", "0x1p3", "1e3", "-.5", "NaN", "inf", "+7.", "abc", "1 2"]
    want = [None, None, None, 1000.0, -0.5, None, float("inf"), 7.0, None, None]
    (tmp_path / "a.csv").write_text("x,i\n" + "".join(f"{t},{i}\n" for i, t in enumerate(tokens)))
    (tmp_path / "a.tsv").write_text("".join(f"{t}\t{i}\n" for i, t in enumerate(tokens)))
    docs = spark.createDataFrame([("".join(f"{t}\t{i}\n" for i, t in enumerate(tokens)),)], "text string")
    for df in (tables.read_table_csv(spark, str(tmp_path / "a.csv")), tables.read_table_tsv(spark, str(tmp_path / "a.tsv"), ["x", "i"]),
               text.parse_annotated_text(docs, ["x", "i"], mode="lenient")):
        assert [r.x for r in df.orderBy("i").collect()] == want


def test_column_map_and_fit_scope(spark):
    from regimen.sources import text

    docs = spark.createDataFrame([("1\t2\t3\n",)], "text string")
    turned = text.parse_annotated_text(docs, ["a", "b", "c"], column_map={"a": "c", "b": "a", "c": "b"}).first()
    assert (turned.a, turned.b, turned.c) == (3.0, 1.0, 2.0)
    with pytest.raises(ValueError):
        text.parse_annotated_text(docs, ["a", "b", "c"], column_map={"a": "z"})
    d = spark.createDataFrame([(0.0, "train"), (2.0, "train"), (10.0, "test")], "x double, split string")
    assert [r.x for r in clean.standardize(d, ["x"]).collect()] == [-1.0, 1.0, 9.0]
    every = [r.x for r in clean.standardize(d, ["x"], fit_scope="all").collect()]
    assert sum(every) == pytest.approx(0.0) and every[2] == pytest.approx(6 / (56 / 3) ** 0.5)
