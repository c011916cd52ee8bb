import hashlib
import math

import numpy as np
import pytest

from regimen.operators import split_stats


def brute(rows, n_rounds, n_splits, test_size, seed, prime=split_stats.PRIME):
    """(round, split) -> (train mean, test mean, R^2) by sorting all rows for every split."""
    hashed = []
    for i, y in rows:
        d = hashlib.md5(str(i).encode()).hexdigest()
        hashed.append((int(d[:8], 16) % prime, int(d[8:16], 16) % prime, i, y))
    out = {}
    for r in range(n_rounds):
        for s in range(n_splits):
            d = hashlib.md5(f"{seed}-{r}-{s}".encode()).hexdigest()
            a, b, c = (int(d[k:k + 8], 16) % prime for k in (0, 8, 16))
            order = sorted(hashed, key=lambda x: ((x[0] * a % prime + x[1] * b % prime + c) % prime, x[2]))
            m = math.ceil(round(test_size * len(rows), 9))
            test = [x[3] for x in order[:m] if x[3] is not None]
            train = [x[3] for x in order[m:] if x[3] is not None]
            mu = sum(train) / len(train)
            mean = sum(test) / len(test)
            spread = sum((y - mean) ** 2 for y in test)
            out[r, s] = len(train), len(test), mu, mean, 1 - sum((y - mu) ** 2 for y in test) / spread
    return out


@pytest.mark.parametrize("prime", [split_stats.PRIME, 61])   # a small prime: nearly every threshold has equal keys
def test_statistics_of_all_splits_equal_sorting(spark, monkeypatch, prime):
    monkeypatch.setattr(split_stats, "PRIME", prime)
    monkeypatch.setattr(split_stats, "BLOCK", 7)
    monkeypatch.setattr(split_stats, "ROWS", 50)
    r = np.random.default_rng(1)
    rows = [(i, None if i % 17 == 0 else float(v)) for i, v in enumerate(r.normal(5, 3, 233))]
    df = spark.createDataFrame(rows, "i long, y double").repartition(3)
    got = {(x.round, x.split): x for x in split_stats.split_statistics(df, ["i"], "y", 4, 5, 0.2, 9).collect()}
    want = brute(rows, 4, 5, 0.2, 9, prime)
    assert got.keys() == want.keys()
    for k, (n_train, n_test, mu, mean, score) in want.items():
        x = got[k]
        assert (x.n_train, x.n_test) == (n_train, n_test)
        assert (x.train_mean, x.test_mean, x.score) == pytest.approx((mu, mean, score), rel=1e-9, abs=1e-9)


def test_no_rows_and_constant_labels(spark):
    df = spark.createDataFrame([(i, 2.0) for i in range(20)], "i long, y double")
    assert {r.score for r in split_stats.split_statistics(df, ["i"], "y", 2, 2).collect()} == {1.0}
    assert split_stats.split_statistics(df.where("false"), ["i"], "y", 2, 2).collect() == []


def test_keys_are_residues():
    f = split_stats.split_factors(3, 2, 9)
    h1, h2 = (np.array(v, np.uint64) for v in ([0, split_stats.PRIME - 1, 12345, split_stats.PRIME - 1], [0, split_stats.PRIME - 1, 999, 1]))
    want = [[(int(x) * int(a) + int(y) * int(b) + int(c)) % split_stats.PRIME for a, b, c in f] for x, y in zip(h1, h2)]
    assert split_stats.split_keys(h1, h2, f).tolist() == want


def test_thresholds_take_few_passes(spark, monkeypatch):
    """The first interval is narrow: two passes for the thresholds and one for the statistics, whatever the keys."""
    passes, sums = [], split_stats._sums
    monkeypatch.setattr(split_stats, "_sums", lambda rows, count, *a: passes.append(count) or sums(rows, count, *a))
    df = spark.range(20000).selectExpr("id AS i", "id % 7 + 0.5 AS y")
    wide = split_stats.split_statistics(df, ["i"], "y", 2, 5, 0.2, 9).collect()
    assert sum(passes[:-1]) <= 25 and passes[0] == passes[-1] == 10
    monkeypatch.setattr(split_stats, "SPREAD", 0.0)  # intervals that miss most thresholds
    assert split_stats.split_statistics(df, ["i"], "y", 2, 5, 0.2, 9).collect() == wide
