"""Table readers/writers, the run log and model persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.functions.exprs import as_col, number

# The run-record layout and the file-stamp format.
RUN_RECORD_FORMAT = "%d    %d  %.5f    %.5f"
STAMP_FORMAT = "yyyyMMdd-HHmmss"

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def double_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType(), True) for c in columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (Parquet; filters and projections reach the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_position() -> list[Column]:
    """Columns that place a row of a text or CSV scan: file, block of the file, and running number."""
    return [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_id")]


def with_line_numbers(rows: DataFrame) -> DataFrame:
    """Replace ``_block`` and ``_id`` (:func:`scan_position`) by ``line_no``, the exact 0-based row of its file.

    Rows of a block follow each other in one task, so one count per block
    gives every block's first line; ``(source_file, line_no)`` is unique for
    any number and size of files and does not depend on how they are split."""
    blocks = rows.groupBy("source_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (rows.join(blocks, ["source_file", "_block"])
            .withColumn("line_no", (F.col("_before") + F.col("_id") - F.col("_first")).cast("long"))
            .drop("_block", "_id", "_first", "_before"))


def read_table_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                   positions: bool = False) -> DataFrame:
    """S3: header CSV -> all-double table (bad numbers -> NULL, NaN -> NULL).

    ``columns`` selects and orders columns by their header names; a name that
    the header lacks is an error.  ``positions`` adds ``source_file`` and ``line_no``."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in columns or () if c not in raw.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header of {path}")
    values = [number(F.trim(F.col(f"`{c}`"))).alias(c) for c in columns or raw.columns]
    if not positions:
        return raw.select(*values)
    return with_line_numbers(raw.select(*scan_position(), *values))


def read_table_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Headerless tab-separated rows (CRLF tolerated)."""
    df = (spark.read.schema(T.StructType([T.StructField(c, T.StringType(), True) for c in columns]))
          .option("sep", "\t").option("header", False).csv(path))
    return df.select(*[number(F.btrim(F.col(c), F.lit(" \r\n\t"))).alias(c)
                       for c in columns])


def write_table_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Table -> CSV directory with header (parallel part files)."""
    df.write.mode(mode).option("header", True).csv(path)


def run_record(round_col: str = "round", split_col: str = "split", score: str = "score",
               score2: str = "score2") -> Column:
    """S6 (the string): ``'%d    %d  %.5f    %.5f'`` of one run."""
    return F.format_string(RUN_RECORD_FORMAT, F.col(round_col).cast("long"), F.col(split_col).cast("long"),
                           F.col(score).cast("double"), F.col(score2).cast("double"))


def run_records(df: DataFrame, round_col: str = "round", split_col: str = "split",
                score: str = "score", score2: str = "score2") -> DataFrame:
    """One ``record`` string per run."""
    return df.select(run_record(round_col, split_col, score, score2).alias("record"))


def append_run_log(df: DataFrame, path: str, **cols) -> None:
    """Append run records to a text log directory."""
    run_records(df, **cols).write.mode("append").text(path)


def scored_name(score: str | Column, val_score: str | Column | None = None,
                stamp: Column | None = None, integer: bool = False) -> Column:
    """``round(score, 2) * 100`` [``-`` same for val] ``-`` timestamp.

    ``integer=True`` gives the ``%d`` (truncating) form of the run log.
    """
    def part(c):
        v = F.bround(as_col(c), 2) * F.lit(100)
        return v.cast("int").cast("string") if integer else v.cast("string")

    stamp = stamp if stamp is not None else F.date_format(F.current_timestamp(), STAMP_FORMAT)
    parts = [part(score)] + ([part(val_score)] if val_score is not None else []) + [stamp]
    return F.concat_ws("-", *parts)


def save_model(model, base_dir: str, model_name: str, score: float, val_score: float | None = None,
               registry: str | None = None) -> str:
    """Persist a fitted Spark ML model under a score-derived name and
    append ``(model, path, score, val_score, saved_at)`` to a registry table."""
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(model_name, float(score), None if val_score is None else float(val_score))],
                                "model string, score double, val_score double")
    name = row.select(scored_name("score", "val_score" if val_score is not None else None).alias("n")) \
        .first()["n"]
    path = f"{base_dir.rstrip('/')}/{model_name}/{name}"
    model.write().overwrite().save(path)
    if registry:
        (row.withColumn("path", F.lit(path)).withColumn("saved_at", F.current_timestamp())
         .write.mode("append").parquet(registry))
    return path


def best_saved(registry: DataFrame, model_name: str | None = None) -> DataFrame:
    """The registry's row with the best score (ties: the latest) of each model, or of ``model_name`` alone."""
    rows = registry if model_name is None else registry.where(F.col("model") == model_name)
    order = F.struct(F.nanvl("score", F.lit(None).cast("double")).alias("score"), "saved_at", "path")
    best = rows.groupBy("model").agg(F.max(F.struct(order.alias("o"), "val_score")).alias("b"))
    return best.select("model", "b.o.path", "b.o.score", "b.val_score", "b.o.saved_at")


def load_best(registry: str, model_name: str):
    """The saved model of that name with the best score."""
    row = best_saved(SparkSession.getActiveSession().read.parquet(registry), model_name).first()
    if row is None:
        raise ValueError(f"no saved model {model_name!r}")
    return load_model(row["path"])


def load_model(path: str):
    """Load a persisted pipeline or model (Spark ML's, or one of this library)."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.util import DefaultParamsReader

    meta = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession().sparkContext)
    cls = meta["class"]
    if cls.endswith("PipelineModel"):
        return PipelineModel.load(path)
    module, _, name = cls.rpartition(".")
    py_module = module.replace("org.apache.spark.ml", "pyspark.ml")
    mod = __import__(py_module, fromlist=[name])
    return getattr(mod, name).load(path)
