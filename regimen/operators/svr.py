"""Support vector regression by iteratively reweighted least squares.

The epsilon-insensitive loss with an L2 penalty is minimised over an explicit
feature map: identity (linear), monomials (poly), or Nystrom features (rbf;
Williams & Seeger 2001): kernel values against landmarks that k-means|| picks on
Spark, whitened by the landmark kernel's eigen-decomposition.

Each round is ONE pass: tasks map their Arrow batches and add up, for every
state (one kernel map, C, epsilon and training part), the weighted Gram matrix, its
right-hand side and the loss; these sums (D x D numbers a state) are added in two
levels and solved on the driver.  Rows with the same features and label are one row with a number, if there are many of them
(:func:`numbered`): the sums, and so the fit, are those of the rows.  A grid search runs all its points and folds as states of
the same passes and maps each batch once per kernel map, so it costs as many
passes as its slowest state has rounds, not one fit per point and fold.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from regimen.functions.exprs import nan_to_null
from regimen.operators.persist import Stored
from regimen.session import compact, materialize

PREDICTION = "prediction"
#: Partial sums of the states before the total.
SUM_PARTS = 16
#: Rows that a task maps at a time.
SLICE = 4096
#: Rows scored at a time: their kernel values fit a core's cache.
SCORED = 512
#: Equal rows are grouped if there are at least this many on average.
EQUAL_ROWS = 4

# The code below travels to the executors by value, so Python workers need only NumPy and Arrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class KernelMap:
    """An explicit feature map of raw features."""

    kind: str
    means: tuple
    stds: tuple
    degree: int = 3
    gamma: float = 1.0
    landmarks: tuple = ()  # raw feature values
    whiten: tuple = ()

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.means)) / np.array(self.stds)

    def powers(self) -> list[tuple[int, ...]]:
        """Feature numbers of every monomial."""
        d = len(self.means)
        return [c for k in range(1, self.degree + 1) for c in itertools.combinations_with_replacement(range(d), k)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        xs = self.scaled(x)
        if self.kind == "linear":
            return xs
        if self.kind == "poly":
            return np.column_stack([np.prod(xs[:, list(c)], axis=1) for c in self.powers()])
        return rbf(xs, self.scaled(np.array(self.landmarks)), self.gamma) @ np.array(self.whiten)

    def size(self) -> int:
        if self.kind == "linear":
            return len(self.means)
        return len(self.powers()) if self.kind == "poly" else np.array(self.whiten).shape[1]


def rbf(x: np.ndarray, centres: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - centre|^2): one product of rows (x, |x|^2, 1) gives the exponents."""
    left = np.column_stack([x, (x * x).sum(1), np.ones(len(x))])
    right = np.vstack([2.0 * gamma * centres.T, np.full(len(centres), -gamma), -gamma * (centres * centres).sum(1)])
    out = left @ right
    np.minimum(out, 0.0, out=out)
    return np.exp(out, out=out)


def rbf_map(means, stds, gamma: float, landmarks: np.ndarray) -> KernelMap:
    """Nystrom features: K(x, L) U S^-1/2 with K(L, L) = U S U'."""
    xs = (landmarks - np.array(means)) / np.array(stds)
    values, vectors = np.linalg.eigh(rbf(xs, xs, gamma))
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    return KernelMap("rbf", tuple(means), tuple(stds), gamma=gamma, landmarks=tuple(map(tuple, landmarks.tolist())),
                     whiten=tuple(map(tuple, whiten.tolist())))


@dataclass
class State:
    """One fit on its way: a map (by number), its parameters and the training part (all folds but one)."""

    map: int
    C: float
    epsilon: float
    without: int | None = None
    coef: np.ndarray | None = None
    trace: list[float] = field(default_factory=list)
    done: bool = False


def _batches(batches: Iterator, features: Sequence[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """(features, labels, folds, numbers of rows) of slices of Arrow batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x = np.column_stack([part.column(f).to_numpy(zero_copy_only=False) for f in features])
            yield x, *(part.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_fold", "_n"))


def _state_sums(table: DataFrame, run) -> dict[int, np.ndarray]:
    """Sums by state of the vectors that tasks emit, in two levels."""
    parts = table.mapInArrow(run, "state int, part int, vec array<double>")
    level = parts.groupBy("state", "part").agg(Summarizer.sum(array_to_vector("vec")).alias("s"))
    total = level.groupBy("state").agg(Summarizer.sum(F.col("s")).alias("s"))
    return {r["state"]: r["s"].toArray() for r in total.collect()}


def _emit(found: dict[int, np.ndarray]):
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() % SUM_PARTS
    for s, vec in found.items():
        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([part], pa.int32()),
                               pa.array([vec], pa.list_(pa.float64()))], names=["state", "part", "vec"])


def _gram_pass(table: DataFrame, features: Sequence[str], maps: list[KernelMap], states: dict[int, State], delta: float):
    """For every state: (loss, weighted Gram matrix, right-hand side) of its training rows."""
    upper = {m: np.triu_indices(maps[m].size() + 1) for m in {s.map for s in states.values()}}

    def run(batches):
        found = {k: [0.0, 0.0, 0.0] for k in states}
        for x, y, fold, n in _batches(batches, features):
            for m in upper:
                z = np.column_stack([maps[m](x), np.ones(len(x))])
                for k, s in states.items():
                    if s.map != m:
                        continue
                    e = y - (z @ s.coef if s.coef is not None else 0.0)
                    own = n if s.without is None else np.where(fold != s.without, n, 0.0)
                    i1 = 1.0 / np.maximum(np.abs(e - s.epsilon), delta)
                    i2 = 1.0 / np.maximum(np.abs(e + s.epsilon), delta)
                    q = own * (s.C / 2.0) * (i1 + i2)
                    t = y - s.epsilon * (i1 - i2) / (i1 + i2)
                    sums = found[k]
                    sums[0] += float(own @ np.maximum(np.abs(e) - s.epsilon, 0.0))
                    half = z * np.sqrt(q)[:, None]
                    sums[1] = sums[1] + half.T @ half  # one triangle's work
                    sums[2] = sums[2] + z.T @ (q * t)
        yield from _emit({k: np.concatenate([[v[0]], v[2], v[1][upper[states[k].map]]])
                          for k, v in found.items() if not np.isscalar(v[1])})

    out = {}
    for k, vec in _state_sums(table, run).items():
        n = maps[states[k].map].size() + 1
        gram = np.zeros((n, n))
        gram[upper[states[k].map]] = vec[1 + n:]
        out[k] = vec[0], gram + np.triu(gram, 1).T, vec[1:1 + n]
    return out


def irls(table: DataFrame, features: Sequence[str], maps: list[KernelMap], states: list[State], max_iter: int, tol: float,
         delta: float) -> None:
    """Fit all ``states`` over ``table`` (features, _y, _fold, _n); one pass a round serves every state that is not done."""
    for _ in range(max_iter):
        open_ = {k: s for k, s in enumerate(states) if not s.done}
        if not open_:
            return
        sums = _gram_pass(table, features, maps, open_, delta)
        for k, s in open_.items():
            if k not in sums:  # no training row
                s.coef, s.done = np.zeros(maps[s.map].size() + 1), True
                continue
            loss, gram, right = sums[k]
            penalty = 0.5 * float(s.coef[:-1] @ s.coef[:-1]) if s.coef is not None else 0.0
            s.trace.append(penalty + s.C * loss)
            if len(s.trace) > 1 and abs(s.trace[-2] - s.trace[-1]) <= tol * max(abs(s.trace[-2]), 1e-12):
                s.done = True
                continue
            ridge = np.eye(len(right))
            ridge[-1, -1] = 0.0  # the intercept is free
            try:
                s.coef = np.linalg.solve(gram + ridge, right)
            except np.linalg.LinAlgError:
                s.coef = np.linalg.lstsq(gram + ridge, right, rcond=None)[0]


def fold_r2(table: DataFrame, features: Sequence[str], maps: list[KernelMap], states: list[State]) -> dict[int, tuple[int, float | None]]:
    """(n, R^2) of every state on the fold that it was fitted without: one pass for all."""
    centre = table.agg(F.sum(F.col("_y") * F.col("_n")) / F.sum("_n")).first()[0] or 0.0

    def run(batches):
        found = {k: np.zeros(4) for k in range(len(states))}
        for x, y, fold, n in _batches(batches, features):
            for m in sorted({s.map for s in states}):
                z = np.column_stack([maps[m](x), np.ones(len(x))])
                for k, s in enumerate(states):
                    at = fold == s.without if s.map == m else np.zeros(len(y), bool)
                    if at.any():
                        e, c, w = y[at] - z[at] @ s.coef, y[at] - centre, n[at]
                        found[k] += [w.sum(), w @ c, w @ (c * c), w @ (e * e)]
        yield from _emit(found)

    out = {}
    for k, (n, s, ss, left) in _state_sums(table, run).items():
        total = ss - s * s / n if n else 0.0
        score = None if n < 2 else float(1.0 - left / total) if total > 1e-12 * max(ss, 1e-300) else float(left == 0)
        out[k] = int(n), score
    return out


# ------------------------------------------------------------------ preparation

def fit_scalers(table: DataFrame, features: Sequence[str], folds: Sequence[int | None]) -> list[tuple[tuple, tuple, int]]:
    """Mean and population std (0 -> 1) of the features and how many of them vary, without each of ``folds``
    (None: of all rows): one aggregate."""
    aggs = []
    for f in folds:
        for c in features:
            x = F.col(c) if f is None else F.when(F.col("_fold") != f, F.col(c))
            aggs += [F.avg(x), F.stddev_pop(x)]
    row, d, out = table.agg(*aggs).first(), len(features), []
    for i in range(len(folds)):
        own = row[2 * d * i:2 * d * (i + 1)]
        out.append((tuple(float(v or 0.0) for v in own[::2]), tuple(float(v or 0.0) or 1.0 for v in own[1::2]),
                    sum(bool(v) for v in own[1::2])))
    return out


def find_landmarks(table: DataFrame, features: Sequence[str], means, stds, count: int, seed: int) -> np.ndarray:
    """At most ``count`` landmarks in raw feature values: k-means|| centres of the scaled rows, each ``_n`` times."""
    xs = [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(features, means, stds)]
    rows = table.select(array_to_vector(F.array(*xs)).alias("features"), "_n")
    model = KMeans(k=count, initMode="k-means||", maxIter=5, seed=seed, weightCol="_n").fit(rows)
    return np.unique(np.array(model.clusterCenters()), axis=0) * np.array(stds) + np.array(means)


def gamma_value(gamma: str | float, d: int, variance: float) -> float:
    """'scale' (1 / (d var X)), 'auto' (1 / d) or the number."""
    if isinstance(gamma, (int, float)):
        return float(gamma)
    if gamma == "auto":
        return 1.0 / d
    if gamma != "scale":
        raise ValueError(f"unknown gamma {gamma!r}")
    return 1.0 / (d * variance) if variance > 0 else 1.0


def _variance(table: DataFrame, features: Sequence[str]) -> float:
    """Population variance of all feature values together."""
    values = F.explode(F.array(*[F.col(c) for c in features])).alias("v")
    return table.select(values).agg(F.var_pop("v")).first()[0] or 0.0


def training_table(df: DataFrame, features: Sequence[str], label: str, fold_col: str | None = None) -> DataFrame:
    """Rows with a label and all features, as doubles, with ``_y`` and ``_fold``."""
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(0)
    cols = [nan_to_null(c).alias(c) for c in features]
    return df.select(*cols, nan_to_null(label).alias("_y"), fold.alias("_fold")).dropna()


def numbered(table: DataFrame, keep: bool) -> DataFrame:
    """``table`` with ``_n``, how many equal rows a row stands for: written with one row for all equal ones if they are
    ``EQUAL_ROWS`` or more on average, else the rows themselves with 1 (written if ``keep``)."""
    rows, kinds = table.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*table.columns))).first()
    if rows and kinds * EQUAL_ROWS <= rows:
        return compact(materialize(table.groupBy(*table.columns).agg(F.count(F.lit(1)).cast("double").alias("_n"))), SLICE)
    table = table.withColumn("_n", F.lit(1.0))
    return materialize(table) if keep else table


# ------------------------------------------------------------------ estimator

def _balanced_sum(terms: list[Column]) -> Column:
    """Sum as a tree of logarithmic depth."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2:]
    return terms[0]


class SVRModel(Model, Stored):
    """Fitted SVR: kernel map and linear weights (driver-side numbers)."""

    def __init__(self, features, label, kernel, means, stds, degree, gamma, landmarks, whiten, coef, intercept,
                 objective_trace):
        super().__init__()
        self.features, self.label, self.kernel = list(features), label, kernel
        self.means, self.stds, self.degree, self.gamma = means, stds, degree, gamma
        self.landmarks, self.whiten = landmarks, whiten
        self.coef, self.intercept, self.objective_trace = coef, intercept, objective_trace

    def to_state(self) -> dict:
        names = ("features", "label", "kernel", "means", "stds", "degree", "gamma", "landmarks", "whiten", "coef", "intercept",
                 "objective_trace")
        return {n: getattr(self, n) for n in names}

    def kernel_map(self) -> KernelMap:
        return KernelMap(self.kernel, tuple(self.means), tuple(self.stds), self.degree, self.gamma, tuple(map(tuple, self.landmarks)),
                         tuple(map(tuple, self.whiten)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Linear and polynomial: plain column arithmetic.  rbf: a pandas UDF over the feature columns only."""
        if self.kernel == "rbf":
            return dataset.withColumn(PREDICTION, self._rbf_column())
        xs = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.means, self.stds)]
        groups = [(i,) for i in range(len(xs))] if self.kernel == "linear" else self.kernel_map().powers()
        terms = []
        for weight, which in zip(self.coef, groups):
            term = F.lit(float(weight))
            for i in which:
                term = term * xs[i]
            terms.append(term)
        return dataset.withColumn(PREDICTION, _balanced_sum([*terms, F.lit(float(self.intercept))]))

    def _rbf_column(self) -> Column:
        import pandas as pd

        own, coef, intercept = self.kernel_map(), np.array(self.coef), self.intercept
        # K(x, L) W w: one weight a landmark
        weights, centres = np.array(own.whiten) @ coef, own.scaled(np.array(own.landmarks))

        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            p = np.concatenate([rbf(own.scaled(x[i:i + SCORED]), centres, own.gamma) @ weights + intercept
                                for i in range(0, len(x), SCORED)] or [np.zeros(0)])
            return pd.Series(p)

        score.__annotations__ = {"cols": pd.Series, "return": pd.Series}
        found = F.pandas_udf(score, DoubleType())(*[F.col(c).cast("double") for c in self.features])
        return F.nanvl(found, F.lit(None).cast("double"))


class SVR(Estimator, Stored):
    """Epsilon-insensitive support vector regression by IRLS.

    Minimises ``0.5 |w|^2 + C * sum(max(|y - f(x)| - epsilon, 0))``.  With
    ``m1 = max(|e - eps|, delta)`` and ``m2 = max(|e + eps|, delta)`` each
    round solves the weighted ridge problem with weight
    ``q = C/2 (1/m1 + 1/m2)`` and target ``y - eps (1/m1 - 1/m2) / (1/m1 + 1/m2)``.
    ``gamma``: 'scale' (1 / (d var X)), 'auto' (1 / d) or a number.  The rbf kernel is a Nystrom map over
    ``n_components`` landmarks, exact when there are no more distinct rows than landmarks.
    ``keep_table`` writes the training rows once to the shared folder, else each round reads the source again; rows that
    are equal in features and label are always written as one with their number, if they are many (:func:`numbered`).
    Rows without a label or with a missing feature are not fitted; a missing feature gives no prediction.
    """

    def __init__(self, features: Sequence[str], label: str, kernel: str = "rbf", C: float = 1.0,
                 epsilon: float = 0.1, gamma: str | float = "scale", degree: int = 3,
                 n_components: int = 256, scale: bool = True, max_iter: int = 20, tol: float = 1e-3,
                 delta: float = 0.01, seed: int = 42, keep_table: bool = False):
        super().__init__()
        if kernel not in ("linear", "poly", "rbf"):
            raise ValueError(f"unknown kernel {kernel!r}")
        self.features, self.label = list(features), label
        self.kernel, self.C, self.epsilon, self.gamma = kernel, float(C), float(epsilon), gamma
        self.degree, self.n_components, self.scale = degree, n_components, scale
        self.max_iter, self.tol, self.delta, self.seed = max_iter, tol, delta, seed
        self.keep_table = keep_table

    def to_state(self) -> dict:
        names = ("features", "label", "kernel", "C", "epsilon", "gamma", "degree", "n_components", "scale", "max_iter", "tol",
                 "delta", "seed", "keep_table")
        return {n: getattr(self, n) for n in names}

    def _fit(self, dataset: DataFrame) -> SVRModel:
        d = len(self.features)
        table = training_table(dataset, self.features, self.label)
        means, stds = fit_scalers(table, self.features, [None])[0][:2] if self.scale else ((0.0,) * d, (1.0,) * d)
        gamma = 1.0
        if self.kernel == "rbf":
            scaled = table.select(*[((F.col(c) - m) / s).alias(c) for c, m, s in zip(self.features, means, stds)])
            gamma = gamma_value(self.gamma, d, _variance(scaled, self.features) if self.gamma == "scale" else 1.0)
            table = numbered(table, self.keep_table)
            landmarks = find_landmarks(table, self.features, means, stds, self.n_components, self.seed)
            own = rbf_map(means, stds, gamma, landmarks)
        else:
            table = numbered(table, self.keep_table)
            own = KernelMap(self.kernel, tuple(means), tuple(stds), degree=self.degree)
        state = State(0, self.C, self.epsilon)
        irls(table, self.features, [own], [state], self.max_iter, self.tol, self.delta)
        coef = state.coef if state.coef is not None else np.zeros(own.size() + 1)
        return SVRModel(self.features, self.label, self.kernel, list(means), list(stds), self.degree, gamma,
                        [list(x) for x in own.landmarks], [list(x) for x in own.whiten], coef[:-1].tolist(), float(coef[-1]),
                        state.trace)


# ------------------------------------------------------------------ grid search

def grid_fold_scores(folded: DataFrame, points: list[dict], features: Sequence[str], label: str, k: int, fold_col: str = "fold",
                     n_components: int = 256, max_iter: int = 20, tol: float = 1e-3, delta: float = 0.01,
                     seed: int = 42) -> list[tuple[int, int, int, float | None]]:
    """E4 for SVR: ``(grid_index, fold, n, r2)`` of every point (``kernel``, ``C``, ``epsilon``, ``gamma``,
    ``degree``) and fold, all fitted by the same passes.

    Scalers are fitted on each fold's training rows; points that come to the same kernel values share
    their states (gamma has no meaning for the linear kernel).  The landmarks are picked once, from the features of all rows."""
    table = training_table(folded, features, label, fold_col)
    d, folds = len(features), list(range(k))
    whole, *scalers = fit_scalers(table, features, [None, *folds])
    table = numbered(table, keep=True)
    landmarks = None
    if any(p.get("kernel", "rbf") == "rbf" for p in points):
        landmarks = find_landmarks(table, features, *whole[:2], n_components, seed)
    maps, states, of = [], [], {}
    known: dict[tuple, int] = {}
    fits: dict[tuple, int] = {}
    for gi, p in enumerate(points):
        kernel = p.get("kernel", "rbf")
        for f in folds:
            means, stds, varied = scalers[f]
            extra = None
            if kernel == "rbf":  # scaled columns have variance 1, or 0 where they are constant
                extra = round(gamma_value(p.get("gamma", "scale"), d, varied / d), 12)
            elif kernel == "poly":
                extra = p.get("degree", 3)
            if (kernel, extra, f) not in known:
                known[kernel, extra, f] = len(maps)
                maps.append(rbf_map(means, stds, extra, landmarks) if kernel == "rbf"
                            else KernelMap(kernel, means, stds, degree=p.get("degree", 3)))
            key = (known[kernel, extra, f], float(p.get("C", 1.0)), float(p.get("epsilon", 0.1)))
            if key not in fits:
                fits[key] = len(states)
                states.append(State(*key, without=f))
            of[gi, f] = fits[key]
    irls(table, features, maps, states, max_iter, tol, delta)
    scores = fold_r2(table, features, maps, states)
    return [(gi, f, *scores.get(s, (0, None))) for (gi, f), s in of.items()]
