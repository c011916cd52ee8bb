"""Spark ML tree ensembles, prediction tables, importances.

A tree learner looks at its features through ``max_bins`` bins, and squared loss at a group of rows with the same
bins through their number and mean label.  So boosting first groups the rows (:class:`BoostedTrees`): two aggregates
find the bins, one ``groupBy`` the groups, at most ``max_bins ** features`` of them, and the rounds run Spark ML's
learner over weighted groups.  The trees are those of the rows.  Row samples (stochastic boosting, bootstrap forests)
are drawn as exact counts where the label has few values; boosting on other labels draws the rows of many rounds in one
pass and keeps their number and sum by group; else Spark ML's learner gets the rows.
The original workflow's parameters are the defaults; Spark's own defaults differ (20
trees, depth 5, 'auto' features), so every value is passed explicitly.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.session import compact, deal_up, materialize

FEATURES = "features"
PREDICTION = "prediction"
# Deepest tree Spark ML accepts; stands in for "unlimited depth".
MAX_TREE_DEPTH = 30
# Checkpoint the node-id cache every this many iterations (cuts lineage of
# deep forests and long boosting runs; uses the session's checkpoint dir).
CHECKPOINT_INTERVAL = 10
#: Rows of a group, and rows of it that a sample drew.
COUNT, DRAWN = "_n", "_drawn"
#: A forest, or sampled boosting on a label of many values, draws groups if they have at least this many rows on average.
GROUP_ROWS = 8
#: Boosting rounds whose row samples one pass over the rows draws; far apart, as a task adds its number to the seed.
ROUNDS_A_PASS, SEED_STEP = 20, 1_000_003

# The code below travels to the executors by value, so Python workers need only NumPy and Arrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def assembler(features: Sequence[str], out: str = FEATURES) -> VectorAssembler:
    """Named numeric columns -> one vector column (impute before: NULL raises)."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def bin_name(feature: str) -> str:
    return f"_bin_{feature}"


def fit_bins(df: DataFrame, features: Sequence[str], label: str, max_bins: int) -> tuple[Bucketizer, int, int]:
    """(bins of the features, rows, about how many values the label has) by two aggregates.

    A feature of at most ``max_bins`` values has a bin for each, with borders halfway; others have quantile bins."""
    xs = [F.col(c).cast("double") for c in features]
    y = F.col(label).cast("double")
    unfit = [x.isNull() | F.isnan(x) for x in (*xs, y)]
    first = df.agg(F.count(F.lit(1)), *[F.count_if(u) for u in unfit], F.approx_count_distinct(y),
                   *[F.approx_count_distinct(x) for x in xs]).first()
    rows, missing, values = first[0], first[1:2 + len(xs)], first[2 + len(xs):]
    if not rows:
        raise ValueError("no training rows")
    for c, n in zip((*features, label), missing):
        if n:
            raise ValueError(f"{n} rows without a value of {c}: impute or drop them before the fit")
    few = [v <= 2 * max_bins for v in values[1:]]  # the sets below stay small
    steps = [i / max_bins for i in range(1, max_bins)]
    second = df.agg(*[F.percentile_approx(x, steps, 100 * max_bins) for x in xs],
                    *[F.collect_set(F.when(F.lit(f), x)) for f, x in zip(few, xs)]).first()
    splits = []
    for i in range(len(xs)):
        known = sorted(second[len(xs) + i])
        if few[i] and len(known) <= max_bins:
            inner = [(a + b) / 2 for a, b in zip(known, known[1:])] or known
        else:
            inner = second[i]
        splits.append([-float("inf"), *sorted({float(v) for v in inner if np.isfinite(v)}), float("inf")])
    return Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=[bin_name(c) for c in features],
                      handleInvalid="error"), rows, values[0]


def grouped(binned: DataFrame, bins: Sequence[str], label: str, extra: Sequence[str] = (), spread: Column | None = None) -> DataFrame:
    """One weighted row for the rows of equal bins (and ``extra``): their mean label and number.

    Where ``spread`` holds, a group whose labels differ is two rows, a standard deviation below and above the mean with
    half the weight each: they have the group's squared error against any prediction."""
    y = F.col(label).cast("double")
    groups = binned.groupBy(*bins, *extra).agg(F.count(F.lit(1)).cast("double").alias(COUNT), F.avg(y).alias(label), F.stddev_pop(y).alias("_sd"))
    if spread is None:
        return groups.drop("_sd")
    one = F.array(F.struct(F.col(label).alias("y"), F.col(COUNT).alias("n")))
    two = F.array(*[F.struct((F.col(label) + s * F.col("_sd")).alias("y"), (F.col(COUNT) / 2).alias("n")) for s in (-1, 1)])
    return groups.withColumn("_part", F.explode(F.when(spread & (F.col("_sd") > 0), two).otherwise(one))).select(
        *bins, *extra, F.col("_part.y").alias(label), F.col("_part.n").alias(COUNT))


def draw(groups: DataFrame, rate: float, replace: bool, seed: int, number: int) -> DataFrame:
    """``groups`` with ``_drawn``, how many of a group's rows sample ``number`` has: each row with probability ``rate``,
    or, with ``replace``, Poisson(``rate``) times."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        rng = np.random.default_rng([seed, number, TaskContext.get().partitionId()])
        for batch in batches:
            n = batch.column(COUNT).to_numpy()
            k = rng.poisson(n * rate) if replace else rng.binomial(n.astype(np.int64), rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.astype(float))], names=[*batch.schema.names, DRAWN])

    schema = ", ".join(f"`{c}` double" for c in (*groups.columns, DRAWN))
    return groups.mapInArrow(run, schema).where(F.col(DRAWN) > 0)


def row_samples(binned: DataFrame, bins: Sequence[str], label: str, rate: float, seed: int, rounds: Sequence[int]) -> DataFrame:
    """Groups of equal bins with, for each round, how many of their rows its sample has (``_drawn_i``; each row with
    probability ``rate``, drawn anew for every round) and the sum of those rows' labels (``_sum_i``)."""
    rows = binned.select(*bins, F.col(label).cast("double").alias("_label"),
                         *[(F.rand(seed + SEED_STEP * i) < rate).alias(f"_in_{i}") for i in rounds])
    return rows.groupBy(*bins).agg(*[F.count_if(f"_in_{i}").cast("double").alias(f"_drawn_{i}") for i in rounds],
                                   *[F.sum(F.when(F.col(f"_in_{i}"), F.col("_label"))).alias(f"_sum_{i}") for i in rounds])


def _ensemble(kind: type, trees: list, label: str, *args):
    """A Spark ML model of fitted single trees."""
    sc = SparkSession.active().sparkContext
    own = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    for i, t in enumerate(trees):
        own[i] = t._java_obj
    uid = f"{kind.__name__}_{trees[0].uid[-12:]}"
    java = getattr(sc._jvm.org.apache.spark.ml.regression, kind.__name__)(uid, own, *args)
    for name, value in (("featuresCol", FEATURES), ("labelCol", label), ("predictionCol", PREDICTION), ("weightCol", COUNT),
                        ("numTrees" if kind is RandomForestRegressionModel else "maxIter", len(trees))):
        if java.hasParam(name):
            java.set(java.getParam(name), value)
    model = kind(java)
    model._transfer_params_from_java()
    return model


def _single_tree(label: str, max_depth: int, max_bins: int, subset: str, min_instances: int, seed: int) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION, weightCol=DRAWN, numTrees=1,
                                 bootstrap=False, subsamplingRate=1.0, maxDepth=max_depth, maxBins=max_bins,
                                 featureSubsetStrategy=subset, minInstancesPerNode=min_instances, seed=seed, maxMemoryInMB=512)


class _Trees(Estimator):
    """Features, label and the learner's parameters; ``_fit`` gives the pipeline (bins, vector, ensemble)."""

    def __init__(self, features: Sequence[str], label: str, **settings):
        super().__init__()
        self.features, self.label, self.settings = list(features), label, settings

    def _bins(self) -> list[str]:
        return [bin_name(c) for c in self.features]

    def _vectors(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector of bin numbers, which are numbers to the learner and not categories."""
        return assembler(self._bins()).transform(df).withMetadata(FEATURES, {})

    def _pipeline(self, bucketizer: Bucketizer, model) -> PipelineModel:
        return PipelineModel([bucketizer, assembler(self._bins()), model])

    def _by_label(self, dataset: DataFrame, bucketizer: Bucketizer) -> DataFrame:
        """Groups of equal bins and label, written once."""
        binned = bucketizer.transform(dataset.withColumn("_label", F.col(self.label).cast("double")))
        groups = binned.groupBy(*self._bins(), "_label").agg(F.count(F.lit(1)).cast("double").alias(COUNT))
        return compact(materialize(groups.withColumnRenamed("_label", self.label)))


class BoostedTrees(_Trees):
    """M2/M3: squared-loss boosting over groups of rows.

    Without row sampling a group is its mean label.  With row sampling each round draws every group's rows anew: group
    by label value, if the label has no more values than a feature has bins; else row by row, where groups are few beside
    the rows.  Other tables, and early stopping with row sampling, are boosted row by row."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        p, val = self.settings, self.settings["validation_col"]
        bucketizer, rows, labels = fit_bins(dataset, self.features, self.label, p["max_bins"])
        kw = dict(featuresCol=FEATURES, labelCol=self.label, predictionCol=PREDICTION, lossType="squared",
                  maxIter=p["max_iter"], stepSize=p["step_size"], maxDepth=p["max_depth"], maxBins=p["max_bins"],
                  subsamplingRate=p["subsample"], featureSubsetStrategy=p["subset"], seed=p["seed"], cacheNodeIds=True,
                  checkpointInterval=CHECKPOINT_INTERVAL, maxMemoryInMB=512)
        if val:
            kw.update(validationIndicatorCol=val, validationTol=p["validation_tol"])
        if p["subsample"] >= 1.0:
            spread = F.col(val) if val else None
            groups = grouped(bucketizer.transform(dataset), self._bins(), self.label, [val] if val else [], spread)
            model = GBTRegressor(weightCol=COUNT, **kw).fit(self._vectors(compact(materialize(groups))))
        elif labels <= p["max_bins"] and not val:
            groups = self._by_label(dataset, bucketizer)
            model = self._sampled(lambda i: draw(groups, p["subsample"], False, p["seed"], i))
        elif not val and self._group_number(dataset, bucketizer) * GROUP_ROWS <= rows:
            model = self._sampled(self._row_samples(bucketizer.transform(dataset)))
        else:
            model = GBTRegressor(**kw).fit(self._vectors(bucketizer.transform(deal_up(dataset))))
        return self._pipeline(bucketizer, model)

    def _group_number(self, dataset: DataFrame, bucketizer: Bucketizer) -> int:
        return bucketizer.transform(dataset).select(*self._bins()).distinct().count()

    def _row_samples(self, binned: DataFrame) -> Callable[[int], DataFrame]:
        """The groups that a round draws; a pass over the rows draws for :data:`ROUNDS_A_PASS` rounds, and its groups are
        written once."""
        p, table = self.settings, None

        def drawn(i: int) -> DataFrame:
            nonlocal table
            if i % ROUNDS_A_PASS == 0:
                rounds = range(i, min(i + ROUNDS_A_PASS, p["max_iter"]))
                table = compact(materialize(row_samples(binned, self._bins(), self.label, p["subsample"], p["seed"], rounds)))
            return table.select(*self._bins(), (F.col(f"_sum_{i}") / F.col(f"_drawn_{i}")).alias(self.label),
                                F.col(f"_drawn_{i}").alias(DRAWN)).where(F.col(DRAWN) > 0)

        return drawn

    def _sampled(self, drawn: Callable[[int], DataFrame]) -> GBTRegressionModel:
        """Rounds over drawn groups, as Spark ML boosts: the first tree in full, the others at the rate, on the
        negative gradient of the squared loss."""
        p, trees, target = self.settings, [], "_target"
        for i in range(p["max_iter"]):
            groups, y = self._vectors(drawn(i)), F.col(self.label)
            if trees:
                groups = self._boosted(trees).transform(groups).withColumn(target, 2.0 * (y - F.col(PREDICTION))).drop(PREDICTION)
            else:
                groups = groups.withColumn(target, y)
            tree = _single_tree(target, p["max_depth"], p["max_bins"], p["subset"], 1, p["seed"] + i).fit(groups)
            trees.append(tree.trees[0])
        return self._boosted(trees)

    def _boosted(self, trees: list) -> GBTRegressionModel:
        sc = SparkSession.active().sparkContext
        weights = sc._gateway.new_array(sc._jvm.double, len(trees))
        for i in range(len(trees)):
            weights[i] = 1.0 if i == 0 else float(self.settings["step_size"])
        return _ensemble(GBTRegressionModel, trees, self.label, weights)


class Forest(_Trees):
    """M1: a bootstrap forest.

    If the label has no more values than a feature has bins, and groups of equal bins and label are few beside the rows,
    every tree draws the rows of each group (a bootstrap takes Poisson(n) of n rows); else Spark ML's forest gets the rows."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        p = self.settings
        bucketizer, rows, labels = fit_bins(dataset, self.features, self.label, p["max_bins"])
        groups = self._by_label(dataset, bucketizer) if labels <= p["max_bins"] and p["bootstrap"] else None
        if groups is not None and groups.count() * GROUP_ROWS <= rows:
            table = materialize(groups)

            def one(i: int):
                own = draw(table, 1.0, True, p["seed"], i)
                return _single_tree(self.label, p["max_depth"], p["max_bins"], p["subset"], p["min_instances"], p["seed"] + i).fit(
                    self._vectors(own)).trees[0]

            with ThreadPoolExecutor(max_workers=4) as pool:
                trees = list(pool.map(one, range(p["num_trees"])))
            model = _ensemble(RandomForestRegressionModel, trees, self.label, len(self.features))
        else:
            model = RandomForestRegressor(
                featuresCol=FEATURES, labelCol=self.label, predictionCol=PREDICTION, numTrees=p["num_trees"], maxDepth=p["max_depth"],
                maxBins=p["max_bins"], featureSubsetStrategy=p["subset"], bootstrap=p["bootstrap"],
                minInstancesPerNode=p["min_instances"], seed=p["seed"], cacheNodeIds=True, checkpointInterval=CHECKPOINT_INTERVAL,
                maxMemoryInMB=512).fit(self._vectors(bucketizer.transform(deal_up(dataset))))
        return self._pipeline(bucketizer, model)


def random_forest(features: Sequence[str], label: str, num_trees: int = 100,
                  max_depth: int = MAX_TREE_DEPTH, max_bins: int = 32, subset: str = "all",
                  bootstrap: bool = True, min_instances: int = 1, seed: int = 42) -> Forest:
    """M1: bootstrap forest, all features tried at every split."""
    return Forest(features, label, num_trees=num_trees, max_depth=max_depth, max_bins=max_bins, subset=subset,
                  bootstrap=bootstrap, min_instances=min_instances, seed=seed)


def gbt(features: Sequence[str], label: str, max_iter: int = 100, step_size: float = 0.1,
        max_depth: int = 3, max_bins: int = 32, subsample: float = 1.0, colsample: float = 1.0,
        validation_col: str | None = None, validation_tol: float = 0.01, seed: int = 42) -> BoostedTrees:
    """M2: squared-loss gradient boosting (100 rounds, rate 0.1, depth 3).

    ``validation_col`` (boolean) turns on early stopping (M8 for trees).
    """
    return BoostedTrees(features, label, max_iter=max_iter, step_size=step_size, max_depth=max_depth, max_bins=max_bins,
                        subsample=subsample, subset="all" if colsample >= 1.0 else repr(float(colsample)),
                        validation_col=validation_col, validation_tol=validation_tol, seed=seed)


def gbt_stochastic(features: Sequence[str], label: str, max_iter: int = 100, step_size: float = 0.1,
                   max_depth: int = 3, subsample: float = 0.8, colsample: float = 0.8,
                   max_bins: int = 32, seed: int = 42) -> Pipeline:
    """M3: boosted trees with row subsampling and per-node column sampling."""
    return gbt(features, label, max_iter=max_iter, step_size=step_size, max_depth=max_depth,
               max_bins=max_bins, subsample=subsample, colsample=colsample, seed=seed)


def predict(model, df: DataFrame, label: str, key_cols: Sequence[str], model_name: str,
            dataset: str = "original", split: str | Column = "test") -> DataFrame:
    """``(keys..., dataset, model, split, label, prediction)`` rows.

    Key columns absent from ``df`` (e.g. an external table) become NULL."""
    split_c = F.lit(split) if isinstance(split, str) else split
    out = model.transform(df)
    keys = [F.col(k) if k in out.columns else F.lit(None).alias(k) for k in key_cols]
    return out.select(*keys, F.lit(dataset).alias("dataset"), F.lit(model_name).alias("model"),
                      split_c.alias("split"), F.col(label).cast("double").alias("label"),
                      F.col(PREDICTION).cast("double").alias("prediction"))


def last_stage(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def feature_importance(model, features: Sequence[str], model_name: str) -> DataFrame | None:
    """``(model, feature, importance)``; None for models without them.

    The vector has one entry per feature (a fitted artefact, not row data).
    """
    m = last_stage(model)
    if not hasattr(m, "featureImportances"):
        return None
    values = m.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = [(model_name, f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def round_losses(model, df: DataFrame) -> list[float]:
    """Mean squared error on ``df`` of the first 1, 2, ... trees of a boosted model."""
    boosted = last_stage(model)
    if isinstance(model, PipelineModel):
        bucketizer, vector = model.stages[:2]
        bins, label = bucketizer.getOutputCols(), boosted.getLabelCol()
        df = vector.transform(grouped(bucketizer.transform(df), bins, label, spread=F.lit(True)))
    return list(boosted.evaluateEachIteration(df, "squared"))


def training_history_gbt(model, df: DataFrame, model_name: str) -> DataFrame:
    """M9 for boosted trees: squared-error loss after each boosting round."""
    losses = round_losses(model, df)
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(model_name, i + 1, float(v)) for i, v in enumerate(losses)],
                                 "model string, epoch int, loss double")
