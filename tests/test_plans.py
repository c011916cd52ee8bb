"""Plan checks: pruning and pushdown reach the scan; no Python in SQL paths;
no single-partition exchange over row data in the split machinery."""

import re

import pytest

from regimen.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["minmax_features", "column_profile", "holdout_split", "evaluate", "synthesize"])
def test_scan_reads_only_needed_columns(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", p):
        assert "l_comment" not in schema and "l_shipinstruct" not in schema and "props" not in schema


@pytest.mark.parametrize("name", ["flagship_mean_predictor", "holdout_split", "kfold_contiguous", "shuffle_splits",
                                  "impute_mean", "standardize", "synthesize", "evaluate", "annotated_text_lenient"])
def test_sql_paths_stay_in_the_jvm(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_filters_are_pushed_to_the_scan(spark):
    from pyspark.sql import functions as F

    from regimen.sources.tables import read_table
    df = read_table(spark, SF, "lineitem").where(F.col("l_quantity") > 10).select("l_tax")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p


def test_holdout_ranks_only_bucket_counts_in_one_partition(spark):
    """The only SinglePartition exchanges sit under global aggregates or the
    bucket-count window (bounded by the number of buckets), never under the
    row-level window that ranks rows inside buckets."""
    p = plan(catalog.QUERIES["holdout_split"](spark, SF))
    # the row-level window is partitioned by the bucket column
    assert re.search(r"Window \[row_number\(\).*\], \[_bkt", p)
