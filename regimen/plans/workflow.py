"""End-to-end model comparison over measurement files (E1, E2, E6, S3/S1,
N1/N2, D1, D3b, W2, M11/W3, S5, S7 composed).

This is the whole original batch flow as one call: read the training table
(annotated text or CSV; the last column is the label), fill missing values,
make the exact seeded hold-out, fit and score the suite (optionally also on
an external table whose missing values are filled from the training means),
cross-validate over "train rows then test rows", write the ranked results
table as CSV, and persist the best model with its importances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.operators import clean, metrics, models, ranking, sampling
from regimen.plans import suite as S
from regimen.session import materialize
from regimen.sources import tables, text

#: What identifies a row of a measurement file.
ROW_ID = ("source_file", "line_no")


def read_measurements(spark: SparkSession, path: str, fmt: str = "csv", columns=None,
                      mode: str = "strict") -> DataFrame:
    """A measurement table with the file and line of every row (``ROW_ID``).

    ``fmt='text'``: annotated text (S1/S2; ``columns`` default to the
    measurement layout); ``fmt='csv'``: header CSV (S3).  The id is the same
    however the files are split, so splits made from it are reproducible.
    """
    if fmt == "text":
        cols = list(columns or text.MEASUREMENT_COLUMNS)
        return text.read_annotated_text(spark, path, columns=cols, mode=mode).select(*ROW_ID, *cols)
    return tables.read_table_csv(spark, path, columns, positions=True)


def model_comparison(spark: SparkSession, train: DataFrame, out_dir: str, external: DataFrame | None = None,
                     label: str | None = None, suite: dict | None = None, k: int = 5, test_size: float = 0.2,
                     seed: int = 42, dataset: str = "original") -> dict[str, DataFrame]:
    """Run the comparison; returns the result tables and writes
    ``out_dir/results`` (CSV) and ``out_dir/models/...`` (best model)."""
    cols = [c for c in train.columns if c not in ROW_ID]
    features, label = clean.split_features_label(cols, label)
    data = clean.impute_mean(train, cols)
    ext = None
    if external is not None:
        ext = clean.impute_from_reference(external, data, cols, label=label, fill_label=False)
    models_ = suite or S.default_suite(features, label, seed=seed)

    split = materialize(sampling.holdout_split(data, list(ROW_ID), test_size, seed))
    tr = split.where(F.col("split") == "train")
    te = split.where(F.col("split") == "test")
    preds, wide, fitted = S.compare_models(tr, te, models_, label, list(ROW_ID), dataset, validation=ext)

    # CV over "train rows then test rows" (D3b); the network is left out as in the original flow
    cv_models = {n: m for n, m in models_.items() if n != S.NN}
    folded = sampling.kfold_after_split(data, list(ROW_ID), k, test_size, seed)
    fold_scores = S.cross_validate_suite(folded, cv_models, label, k)
    cv = metrics.cv_summary(fold_scores)
    results = materialize(ranking.results_table(wide, cv))
    tables.write_table_csv(results, f"{out_dir.rstrip('/')}/results")

    best = ranking.best_model(results).first()
    importances = None
    if best is not None and best["best_model"] in fitted:
        name = best["best_model"]
        score = best["best_score"]
        tables.save_model(fitted[name], f"{out_dir.rstrip('/')}/models", name.replace(" ", "_").lower(),
                          score if score is not None else 0.0, registry=f"{out_dir.rstrip('/')}/registry")
        imp = models.feature_importance(fitted[name], features, name)
        importances = ranking.rank_importance(imp) if imp is not None else None
    return {"results": results, "predictions": preds, "fold_scores": fold_scores, "importances": importances}
