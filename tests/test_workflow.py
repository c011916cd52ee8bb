from pyspark.sql import functions as F

from regimen.operators import models
from regimen.plans import suite, workflow

COLS = ["a", "b", "y"]


def write_text(path, rows):
    lines = ["### measurements", "### ---Under is the data--- ###", ""]
    lines += ["\t".join("/" if v is None else repr(v) for v in r) for r in rows]
    path.write_bytes(("\r\n".join(lines) + "\r\n").encode())


def test_model_comparison_end_to_end(spark, tmp_path):
    rows = [(float(i % 50 + 1), float(i % 7), 10.0 if i % 50 + 1 > 25 else 2.0) for i in range(400)]
    rows[3] = (None, 3.0, 2.0)                    # a missing feature is imputed
    src = tmp_path / "train"
    src.mkdir()
    write_text(src / "t.txt", rows)
    ext = spark.createDataFrame([(30.0, 1.0, None), (5.0, None, None)], "a double, b double, y double")
    train = workflow.read_measurements(spark, str(src), fmt="text", columns=COLS)
    assert train.count() == 400 and train.select(*workflow.ROW_ID).distinct().count() == 400
    small = {suite.RF: models.random_forest(["a", "b"], "y", num_trees=5, max_depth=5, max_bins=64),
             suite.GB: models.gbt(["a", "b"], "y", max_iter=3, max_bins=64)}
    out = workflow.model_comparison(spark, train, str(tmp_path / "out"), external=ext, suite=small, k=3)
    res = {r.model: r for r in out["results"].collect()}
    assert set(res) == {suite.RF, suite.GB}
    assert all(r.cv_folds == 3 and r.rank in (1, 2) for r in res.values())
    assert all(r.val_r2 is None for r in res.values())          # external table has no label
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "results")).count() == 2
    imp = {r.feature: r.importance for r in out["importances"].collect()}
    assert imp["a"] > imp["b"]
    assert out["predictions"].where(F.col("split") == "val").count() == 4
