import math

import duckdb
import pytest

import __spark_entry__ as E
from regimen.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
FAST = ["flagship_mean_predictor", "holdout_split", "kfold_contiguous", "kfold_after_split", "shuffle_splits",
        "growing_prefixes", "impute_mean", "impute_from_reference", "minmax_rounded", "standardize",
        "column_profile", "corr_matrix", "evaluate", "results_table", "best_model", "synthesize",
        "annotated_text_lenient", "run_log", "cv_mean_predictor", "learning_curve_mean", "repeated_splits_mean"]


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return "NULL" if v is None else str(v)

    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    assert set(df.columns) == {"split", "n", "r2", "mae", "rmse"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(ocols, res.fetchall())
