import numpy as np
import pytest

from regimen.operators import profile, wide


@pytest.mark.parametrize("block,cells", [(256, 1 << 22), (3, 1 << 22), (2, 4)])
def test_wide_matrix_equals_pairwise_aggregates(spark, monkeypatch, block, cells):
    monkeypatch.setattr(wide, "CELLS", cells)
    r = np.random.default_rng(2)
    x = r.normal(1e6, 3, size=(120, 7))
    x[:, 3] = x[:, 0] * 2 + x[:, 1]
    x[:, 5] = 4.0
    rows = [[None if r.random() < 0.1 else float(v) for v in row] for row in x]
    rows[0][2] = float("nan")
    cols = list("abcdefg")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(4)
    key = lambda m: {(t.col_a, t.col_b): t.corr for t in m.collect()}
    got, want = key(wide.corr_matrix_wide(df, cols, block=block)), key(profile.corr_matrix(df, cols))
    assert got.keys() == want.keys() and len(got) == 49
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-8)), k


def test_wide_matrix_of_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 5.0],), ([2.0, 1.0],), (None,), ([3.0, 0.5, None, 9.0],)], "v array<double>")
    got = {(t.col_a, t.col_b): t.corr for t in wide.corr_matrix_wide(df, vector="v", size=3).collect()}
    assert got[0, 1] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 0.5])[0, 1]) and got[0, 0] == 1.0
    assert got[2, 2] is None and got[0, 2] is None and len(got) == 9
