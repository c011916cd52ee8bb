"""Model experiments.  Each fit is a distributed Spark job; the
driver only loops over models, folds and grid points, keeps at most
``parallelism`` fitted models at a time, and holds one metrics row per fit.

Split tables are tagged once (exact hold-out / folds from
:mod:`regimen.operators.sampling`) and written to the shared checkpoint
folder, so every fit of an experiment reads the same rows; nothing stays
cached afterwards.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimen.operators import metrics, models, ranking, sampling, solvers, svr, synth
from regimen.operators.clean import accept_condition, impute_from_reference, impute_mean
from regimen.session import compact, materialize
from regimen.sources import tables

Builder = Callable[..., object]

# Display names of the suite (result tables use these).
RF, GB, SVR_NAME, NN, XGB = "Random Forest", "Gradient Boosting", "SVR", "Neural Network", "XGBoost"


def default_suite(features: Sequence[str], label: str, trees: int = 100, boost_rounds: int = 100,
                  landmarks: int = 256, epochs: int = 100, seed: int = 42) -> dict[str, object]:
    """The model suite with its original parameters (RF 100 trees all features;
    GB 100 x 0.1 depth 3; SVR rbf C=1 eps=0.1 on scaled features; network
    [64, 32] dropout 0.2, Adam 1e-3, batch 32)."""
    return {
        RF: models.random_forest(features, label, num_trees=trees, seed=seed),
        GB: models.gbt(features, label, max_iter=boost_rounds, seed=seed),
        SVR_NAME: solvers.SVR(features, label, kernel="rbf", n_components=landmarks, seed=seed),
        NN: solvers.MLPRegressor(features, label, epochs=epochs, seed=seed),
    }


# Fits submitted at once from driver threads (like CrossValidator's
# ``parallelism``): each fit is its own set of Spark jobs, and small fits
# are dominated by per-job latency, so several in flight fill the cluster.
DEFAULT_PARALLELISM = 4


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def fit_many(tasks: Sequence[tuple[object, object, DataFrame]], parallelism: int = DEFAULT_PARALLELISM) -> dict:
    """``{key: est.fit(df)}`` for ``(key, est, df)`` tasks, ``parallelism`` at a time."""
    if parallelism <= 1 or len(tasks) <= 1:
        return {k: est.fit(df) for k, est, df in tasks}
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        futures = {k: pool.submit(est.fit, df) for k, est, df in tasks}
        return {k: f.result() for k, f in futures.items()}


class Journal:
    """An append-only table of scored fits in a shared folder: what a stopped search has done already.

    Every fit appends its rows as it ends; a search that is started again with the same journal runs
    only the fits that it lacks.  ``None`` as path keeps no journal."""

    def __init__(self, spark, path: str | None):
        self.spark, self.path, self.done = spark, path, {}
        if path is None:
            return
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            for r in spark.read.schema("fit string, rows string").json(f"{path}/fit-*").collect():  # one row a fit
                self.done.setdefault(r["fit"], [tuple(x) for x in json.loads(r["rows"])])

    def run(self, key: tuple, fit: Callable[[], list[tuple]]) -> list[tuple]:
        """The rows of the fit ``key``: those of the journal, or those that ``fit`` makes now."""
        name = json.dumps(key)
        if name not in self.done:
            self.done[name] = fit()
            if self.path is not None:
                row = self.spark.createDataFrame([(name, json.dumps(self.done[name]))], "fit string, rows string")
                row.coalesce(1).write.json(f"{self.path}/fit-{uuid.uuid4().hex}")  # a folder each: fits end at the same time
        return self.done[name]


def score_each(tasks: Sequence[tuple[tuple, Callable[[], object], DataFrame, dict[str, DataFrame]]], label: str,
               parallelism: int = DEFAULT_PARALLELISM, journal: str | None = None) -> list[tuple]:
    """``(*key, part, n, r2, mae, rmse)`` for every ``(key, build, train, {part: rows})``.

    Each fit is scored as it ends and dropped: at most ``parallelism`` models
    exist at a time, and one metrics row per part is all that is kept (in ``journal``, too: see :class:`Journal`)."""
    book = Journal(tasks[0][2].sparkSession, journal) if tasks else None

    def one(task):
        key, build, train, parts = task

        def fit():
            model = build().fit(train)
            preds = _union([model.transform(rows).select(F.lit(part).alias("part"), F.col(label).cast("double").alias("label"),
                                                         F.col(models.PREDICTION).cast("double").alias("prediction"))
                            for part, rows in parts.items()])
            return [(*key, r["part"], r["n"], r["r2"], r["mae"], r["rmse"])
                    for r in metrics.regression_metrics(preds, ["part"]).collect()]

        return book.run(key, fit)

    if parallelism <= 1 or len(tasks) <= 1:
        found = [one(t) for t in tasks]
    else:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            found = list(pool.map(one, tasks))
    return [row for rows in found for row in rows]


SCORES = "part string, n long, r2 double, mae double, rmse double"


def compare_models(train: DataFrame, test: DataFrame, suite: dict[str, object], label: str,
                   key_cols: Sequence[str], dataset: str = "original",
                   validation: DataFrame | None = None,
                   parallelism: int = DEFAULT_PARALLELISM) -> tuple[DataFrame, DataFrame, dict]:
    """Fit every model on ``train``; predictions on ``test`` (and the
    optional ``validation`` table) in long form; A7 metrics in one job.
    Callers pass parts of a written split table (``session.materialize``).

    Returns ``(predictions, metrics_wide, fitted_models)``.
    """
    fitted = fit_many([(name, est, train) for name, est in suite.items()], parallelism)
    preds = []
    for name, m in fitted.items():
        preds.append(models.predict(m, test, label, key_cols, name, dataset, "test"))
        if validation is not None:
            preds.append(models.predict(m, validation, label, key_cols, name, dataset, "val"))
    p = _union(preds)
    return p, metrics.evaluate(p, ["dataset", "model"]), fitted


def cross_validate_suite(folded: DataFrame, suite: dict[str, object], label: str, k: int,
                         fold_col: str = "fold", parallelism: int = DEFAULT_PARALLELISM,
                         journal: str | None = None) -> DataFrame:
    """Per model and fold, fit on the other folds and score the fold.
    ``(model, fold, n, r2, mae, rmse)``."""
    folded = compact(materialize(folded))
    rows = score_each([((name, f), lambda est=est: est, folded.where(F.col(fold_col) != f),
                        {"test": folded.where(F.col(fold_col) == f)})
                       for name, est in suite.items() for f in range(k)], label, parallelism, journal)
    return folded.sparkSession.createDataFrame(rows, f"model string, fold int, {SCORES}").drop("part")


def param_grid(grid: dict[str, Sequence]) -> list[dict]:
    """Cartesian product in the order given (the grid index is the position)."""
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def _with_params(spark, points: list[dict], scores: DataFrame) -> DataFrame:
    keys = list(points[0])
    params = spark.createDataFrame([(i, *[str(p[k]) for k in keys]) for i, p in enumerate(points)], ["grid_index", *keys])
    return params.join(scores, "grid_index")


def refit_winner(best: DataFrame, build: Builder, grid: dict[str, Sequence], train: DataFrame) -> tuple[dict, object]:
    """The best point's parameters, with their own types, and the model refitted with them on all of ``train``."""
    row = best.first()
    if row is None:
        raise ValueError("no grid point has a score")
    params = param_grid(grid)[row["grid_index"]]
    return params, build(**params).fit(train)


def grid_search_cv(folded: DataFrame, build: Builder, grid: dict[str, Sequence], label: str, k: int,
                   fold_col: str = "fold", parallelism: int = DEFAULT_PARALLELISM,
                   journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every grid point scored by k-fold R^2 (mean, population std);
    the best is the first strictly better mean (W4).

    Returns ``(grid_table, best_row)``; ``grid_table`` has the parameters as
    columns plus ``grid_index, cv_mean, cv_std``.  :func:`refit_winner` fits
    the winner on all training rows.
    """
    points = param_grid(grid)
    folded = materialize(folded)
    rows = score_each([((gi, f), lambda p=params: build(**p), folded.where(F.col(fold_col) != f),
                        {"test": folded.where(F.col(fold_col) == f)})
                       for gi, params in enumerate(points) for f in range(k)], label, parallelism, journal)
    spark = folded.sparkSession
    fold_scores = spark.createDataFrame(rows, f"grid_index long, fold int, {SCORES}").drop("part")
    table = _with_params(spark, points, metrics.cv_summary(fold_scores, ["grid_index"]))
    return table, ranking.best_params(table, score="cv_mean", index_col="grid_index")


def grid_search_holdout(train: DataFrame, val: DataFrame, build: Builder, grid: dict[str, Sequence],
                        label: str, parallelism: int = DEFAULT_PARALLELISM,
                        journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every grid point fitted on ``train`` and scored on ``train``
    and ``val`` (``train_r2``, ``val_r2``); best = first strictly better
    ``val_r2`` (W4)."""
    points = param_grid(grid)
    rows = score_each([((gi,), lambda p=params: build(**p), train, {"train": train, "val": val})
                       for gi, params in enumerate(points)], label, parallelism, journal)
    spark = train.sparkSession
    wide = spark.createDataFrame(rows, f"grid_index long, {SCORES}").groupBy("grid_index").agg(
        F.max(F.when(F.col("part") == "train", F.col("r2"))).alias("train_r2"),
        F.max(F.when(F.col("part") == "val", F.col("r2"))).alias("val_r2"))
    table = _with_params(spark, points, wide)
    return table, ranking.best_params(table, score="val_r2", index_col="grid_index")


def _staged_fits(grid: dict[str, Sequence], build: Builder, rounds: str) -> tuple[list[dict], list[tuple[dict, list[tuple[int, int]]]]]:
    """The grid's points, and for each fit that they need its parameters and the (grid index, rounds) read off it.

    Boosting adds one tree a round: a model of 100 rounds holds the model of 50 rounds with the same other
    parameters and seed, so one fit of the most rounds serves all of them."""
    points = param_grid(grid)
    fits: dict[tuple, list[tuple[int, int]]] = {}
    for gi, p in enumerate(points):
        fits.setdefault(tuple((k, v) for k, v in p.items() if k != rounds), []).append((gi, p[rounds]))
    return points, [({**dict(rest), rounds: max(r for _, r in at)}, at) for rest, at in fits.items()]


def staged_r2(model, rows: DataFrame, label: str) -> list[float | None]:
    """R^2 on ``rows`` after each boosting round (A4's rule for constant labels)."""
    y = F.col(label).cast("double")
    n, spread = rows.agg(F.count(y), F.var_pop(y)).first()
    losses = models.round_losses(model, rows)
    if n < 2:
        return [None] * len(losses)
    return [(1.0 - x / spread) if spread else float(x == 0) for x in losses]


def score_staged(fits, build: Builder, parts: Sequence[tuple[object, DataFrame, dict[str, DataFrame]]], label: str,
                 parallelism: int) -> list[tuple]:
    """``(grid_index, key, part, r2)`` for every fit, every (key, training rows, {part: rows}) and each number of
    rounds wanted of it; a model is dropped once it is read off."""
    def one(task):
        params, at, key, train, rows = task
        model = build(**params).fit(train)
        found = []
        for part, part_rows in rows.items():
            scores = staged_r2(model, part_rows, label)
            found += [(gi, key, part, scores[min(r, len(scores)) - 1]) for gi, r in at]
        return found

    tasks = [(params, at, key, train, rows) for params, at in fits for key, train, rows in parts]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [row for rows in pool.map(one, tasks) for row in rows]


def grid_search_boosted(train: DataFrame, val: DataFrame, build: Builder, grid: dict[str, Sequence], label: str,
                        rounds: str = "max_iter", parallelism: int = 2 * DEFAULT_PARALLELISM) -> tuple[DataFrame, DataFrame]:
    """E3 for boosted trees: as :func:`grid_search_holdout`, with one fit for all numbers of rounds."""
    points, fits = _staged_fits(grid, build, rounds)
    rows = score_staged(fits, build, [(0, train, {"train": train, "val": val})], label, parallelism)
    wide = {}
    for gi, _, part, r2 in rows:
        wide.setdefault(gi, {})[part] = r2
    scores = train.sparkSession.createDataFrame([(gi, v["train"], v["val"]) for gi, v in wide.items()],
                                                "grid_index long, train_r2 double, val_r2 double")
    table = _with_params(train.sparkSession, points, scores)
    return table, ranking.best_params(table, score="val_r2", index_col="grid_index")


def grid_search_boosted_cv(folded: DataFrame, build: Builder, grid: dict[str, Sequence], label: str, k: int,
                           fold_col: str = "fold", rounds: str = "max_iter",
                           parallelism: int = 2 * DEFAULT_PARALLELISM) -> tuple[DataFrame, DataFrame]:
    """E4 for boosted trees: as :func:`grid_search_cv`, with one fit a fold for all numbers of rounds."""
    points, fits = _staged_fits(grid, build, rounds)
    folded = compact(materialize(folded))
    parts = [(f, folded.where(F.col(fold_col) != f), {"test": folded.where(F.col(fold_col) == f)}) for f in range(k)]
    rows = score_staged(fits, build, parts, label, parallelism)
    scores = folded.sparkSession.createDataFrame([(gi, f, r2) for gi, f, _, r2 in rows], "grid_index long, fold int, r2 double")
    table = _with_params(folded.sparkSession, points, metrics.cv_summary(scores, ["grid_index"]))
    return table, ranking.best_params(table, score="cv_mean", index_col="grid_index")


def grid_search_svr(folded: DataFrame, features: Sequence[str], label: str, grid: dict[str, Sequence], k: int,
                    fold_col: str = "fold", **fit) -> tuple[DataFrame, DataFrame]:
    """E4 for SVR: as :func:`grid_search_cv`, with all points and folds fitted by the same passes over the table
    (:func:`regimen.operators.svr.grid_fold_scores`)."""
    points = param_grid(grid)
    rows = svr.grid_fold_scores(folded, points, features, label, k, fold_col, **fit)
    spark = folded.sparkSession
    scores = spark.createDataFrame(rows, "grid_index long, fold int, n long, r2 double")
    table = _with_params(spark, points, metrics.cv_summary(scores, ["grid_index"]))
    return table, ranking.best_params(table, score="cv_mean", index_col="grid_index")


def grid_search_networks(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, grid: dict[str, Sequence],
                         epochs: int = 50, patience: int | None = 10, seed: int = 42) -> tuple[DataFrame, DataFrame, dict]:
    """E5: the grid's networks (``hidden_layers``, ``dropout_rate``, ``learning_rate``, ``batch_size``) trained together
    on ``train`` with early stopping on ``val``; the first point with the strictly least validation loss wins.

    Returns ``(log, best_row, models by grid_index)``; the log has, for each point, its parameters and
    ``train_loss``, ``val_loss`` (both the least of the history), ``epochs_trained`` and ``patience``."""
    points = param_grid(grid)
    rows = train.select(*features, label, F.lit(False).alias("_is_val")).unionByName(
        val.select(*features, label, F.lit(True).alias("_is_val")))
    names = {"hidden_layers": "hidden", "dropout_rate": "dropout", "learning_rate": "learning_rate", "batch_size": "batch_size"}
    found = solvers.train_networks(rows, features, label, [{names[k]: v for k, v in p.items()} for p in points], epochs, patience,
                                   "_is_val", seed=seed)
    log = []
    for gi, (p, m) in enumerate(zip(points, found)):
        losses, vals = [h[1] for h in m.history], [h[3] for h in m.history if h[3] is not None]
        log.append((gi, [int(x) for x in p.get("hidden_layers", (64, 32))], float(p.get("dropout_rate", 0.2)),
                    float(p.get("learning_rate", 1e-3)), int(p.get("batch_size", 32)), min(losses, default=None),
                    min(vals, default=None), len(m.history), patience))
    table = train.sparkSession.createDataFrame(
        log, "grid_index long, hidden_layers array<int>, dropout_rate double, learning_rate double, batch_size int, "
             "train_loss double, val_loss double, epochs_trained int, patience int")
    return table, ranking.best_params(table, "val_loss", "grid_index", higher_is_better=False), dict(enumerate(found))


def learning_curve(df: DataFrame, order_cols: list[str], estimator, label: str, k: int = 5,
                   fractions: Sequence[float] | None = None, parallelism: int = DEFAULT_PARALLELISM,
                   journal: str | None = None) -> DataFrame:
    """Per training size, train and held-out R^2 mean/std over folds."""
    folded, sizes = sampling.first_sizes(df, order_cols, k, fractions)
    folded = compact(folded)  # written there; every fit reads it a few times

    def prefix(f, m_size):
        return folded.where(F.col(f"first_{f}") <= m_size)

    rows = score_each([((m_size, f), lambda: estimator, prefix(f, m_size),
                        {"train": prefix(f, m_size), "test": folded.where(F.col("fold") == f)})
                       for m_size in sizes for f in range(k)], label, parallelism, journal)
    sc = folded.sparkSession.createDataFrame(rows, f"train_size long, cv_fold int, {SCORES}")
    return sc.groupBy("train_size").agg(
        F.avg(F.when(F.col("part") == "train", F.col("r2"))).alias("train_mean"),
        F.stddev_pop(F.when(F.col("part") == "train", F.col("r2"))).alias("train_std"),
        F.avg(F.when(F.col("part") == "test", F.col("r2"))).alias("test_mean"),
        F.stddev_pop(F.when(F.col("part") == "test", F.col("r2"))).alias("test_std"))


def repeated_splits(df: DataFrame, id_cols: list[str], estimator, label: str, external: DataFrame | None,
                    n_rounds: int = 1, n_splits: int = 5, test_size: float = 0.2, seed: int = 42,
                    min_score: float = 0.89, min_score2: float = 0.5,
                    parallelism: int = DEFAULT_PARALLELISM, log_path: str | None = None, journal: str | None = None) -> DataFrame:
    """Fit a model per shuffled split, score on its test rows and on the
    external table, and flag runs passing both thresholds (P5).  With
    ``log_path`` the records of the accepted runs are appended there (S6).

    A split is one threshold key: no copy of the table is written."""
    member = sampling.split_membership(df, id_cols, n_splits, test_size, seed, n_rounds)
    rows = score_each([((r, sp), lambda: estimator, df.where(~is_test),
                        {"test": df.where(is_test)} | ({} if external is None else {"external": external}))
                       for (r, sp), is_test in member.items()], label, parallelism, journal)
    sc = df.sparkSession.createDataFrame(rows, f"round int, split int, {SCORES}")
    wide = sc.groupBy("round", "split").agg(
        F.max(F.when(F.col("part") == "test", F.col("r2"))).alias("score"),
        F.max(F.when(F.col("part") == "external", F.col("r2"))).alias("score2"))
    out = wide.withColumn("accepted", F.coalesce(accept_condition(min_score=min_score, min_score2=min_score2),
                                                 F.lit(False)))
    if log_path is not None:
        tables.append_run_log(out.where("accepted"), log_path)
    return out


def original_vs_synthetic(original: DataFrame, external: DataFrame | None, features: Sequence[str], label: str,
                          key_cols: Sequence[str], suite_builder: Callable[[], dict], n_synthetic: int | None = None,
                          test_size: float = 0.2, seed: int = 42, k: int = 5) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Impute (N1, N2 for the external table), hold-out, compare the suite
    on the original table, synthesize (D6) and compare again -- both validated
    on the same external table and cross-validated over "train rows then test
    rows" (D3b; the network is left out) -- then join side by side (J1).

    Returns ``(comparison, {"original": results_table, "synthetic": results_table})``."""
    cols = [*features, label]
    orig = materialize(impute_mean(original, cols))
    ext = impute_from_reference(external, orig, cols, label=label, fill_label=False) if external is not None else None
    syn = materialize(synth.synthesize(orig, features, label, n=n_synthetic, key_cols=None if n_synthetic else key_cols,
                                       seed=seed))
    syn_keys = ["syn_id"] if n_synthetic else list(key_cols)
    results = {}
    for name, table, keys in (("original", orig, list(key_cols)), ("synthetic", syn, syn_keys)):
        split = materialize(sampling.holdout_split(table, keys, test_size, seed))
        train = split.where(F.col("split") == "train")
        test = split.where(F.col("split") == "test")
        _, wide, _ = compare_models(train, test, suite_builder(), label, keys, name, validation=ext)
        folded = sampling.kfold_after_split(table, keys, k, test_size, seed)
        scores = cross_validate_suite(folded, {n: m for n, m in suite_builder().items() if n != NN}, label, k)
        results[name] = materialize(ranking.results_table(wide, metrics.cv_summary(scores)))
    sides = [results[n].select("model", F.col("test_r2").alias("r2"), F.col("test_mae").alias("mae"),
                               F.col("test_rmse").alias("rmse")) for n in ("original", "synthetic")]
    return ranking.compare_datasets(*sides), results
