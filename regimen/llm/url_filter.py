"""Operator 8: URL filter by rules and a character language-model ratio.

Rules decide the URLs they fit: a rule (host, path) fits its host and all its
subdomains, if the URL's path starts with the rule's; the longest fitting rule
wins.  All other URLs are judged by two smoothed variable-order Markov models
of bytes, one of URLs that rules allow and one of URLs that they block: orders
0 to ``ORDER`` are interpolated with weight total / (total + kinds).  The
difference of the log-likelihoods per byte is calibrated by isotonic regression
on rule-decided URLs that trained no model, and 0.5 or more allows.

The statistics are counted over every rule-decided URL of the corpus (one in
``HOLD`` kept for the calibration, by a hash of the URL) and all are kept, in
tables of the shared folder; tasks hold the most frequent grams, and the others
are joined (``bytelm.Model``).

Defined cases: null, or no ``://``: host and path are empty, no rule fits, and
the method judges the empty string; an empty path fits no rule that starts with
a slash; ports and user names are part of the host; equally long rules go to
the first in the order given; with rules of one kind seen only, or none, the
method answers that kind, or allows; repeated URLs are judged each; an empty
table gives no rows; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import bytelm, common

ORDER = 4
#: One in so many rule-decided URLs calibrates; at most so many rows are used for it.
HOLD, FIT_ROWS = 5, 20_000

# Fixed values: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """All columns, host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(u_, locate('://', u_) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract("r_", r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract("r_", r"^[^/?#]*([^?#]*)", 1)
    return (pages.withColumn("u_", url).withColumn("r_", rest).withColumn("host", host).withColumn("path", path)
            .drop("u_", "r_"))


def rule_order(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def fits(host: str, path: str) -> Column:
    own = (F.col("host") == host) | F.col("host").endswith("." + host)
    return own & F.col("path").startswith(path)


def first_fit(rules: list[tuple[str, str, str]], what) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(rule_order(rules)):
        out = F.when(fits(rule[1], rule[2]), F.lit(what(rule))).otherwise(out)
    return out


class RatioModel:
    """Difference of two byte models, per byte, and its calibration."""

    def __init__(self, model: bytelm.Model | None, flat: float = 1.0):
        self.model, self.flat = model, flat
        self.bounds, self.levels = [0.0], [flat]

    def judge(self, rows: DataFrame, text_col: str, ratio_col: str, score_col: str) -> DataFrame:
        """All columns but the text, the ratio, and the calibrated score (of being allowed)."""
        if self.model is None:
            return rows.drop(text_col).withColumn(ratio_col, F.lit(0.0)).withColumn(score_col, F.lit(self.flat))
        ratio = F.expr("(sums_[0] - sums_[1]) / greatest(1, bytes_)")
        source = self.model.sums(rows, text_col).withColumn(ratio_col, ratio).drop("sums_", "bytes_")
        schema = T.StructType([*source.schema.fields]).add(score_col, "double")
        bounds, levels = np.array(self.bounds), np.array(self.levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = np.interp(batch.column(batch.num_columns - 1).to_numpy(), bounds, levels)
                yield pa.record_batch([*batch.columns, pa.array(score)], names=[*batch.schema.names, score_col])

        return source.mapInArrow(run, schema)


def fit(decided: DataFrame, order: int = ORDER) -> RatioModel:
    """Learn from (text, allowed boolean)."""
    hold = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(HOLD)) == 0
    found = decided.select(hold.alias("hold"), "allowed").distinct().collect()  # four rows at most
    kinds = {r["allowed"] for r in found if not r["hold"]}
    if len(kinds) < 2:
        return RatioModel(None, float(next(iter(kinds), True)))
    rows = decided.where(~hold).select(F.when(F.col("allowed"), "a").otherwise("b").alias("cls"), "text")
    model = RatioModel(bytelm.Model(bytelm.count_grams(rows, order, ["a", "b"]), 2, order, "log_likelihoods"))
    part = decided.where(hold)
    if sum(r["hold"] for r in found) < 2:  # too few to keep apart
        part = decided
    part = part.orderBy(F.xxhash64("text"), "text").limit(FIT_ROWS)
    pairs = model.judge(part, "text", "ratio", "score_").select("ratio", F.col("allowed").cast("double").alias("y"))
    curve = IsotonicRegression(featuresCol="ratio", labelCol="y").fit(common.write_shared(pairs))
    model.bounds, model.levels = [float(x) for x in curve.boundaries], [float(x) for x in curve.predictions]
    return model


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """All columns, host, path, rule, verdict, ratio and score (in place of columns of these names)."""
    outputs = ["host", "path", "rule", "verdict", "ratio", "score"]
    return common.beside(pages, url_col, lambda rows: judged_urls(rows, rules), {c: c for c in outputs}, keep_text=True)


def judged_urls(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (row, text: the URL) and the filter's columns."""
    rows = with_host_and_path(urls, "text")
    rows = (rows.withColumn("rule", first_fit(rules, lambda r: r[1] + r[2]))
            .withColumn("by_rule", first_fit(rules, lambda r: r[0]))
            .withColumn("judged", F.concat("host", "path")))
    decided = rows.where("by_rule is not null").select(F.col("judged").alias("text"), (F.col("by_rule") == "allow").alias("allowed"))
    judged = fit(decided).judge(rows, "judged", "ratio", "score")
    return judged.withColumn("verdict", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "allow").otherwise("block")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return filter_urls(common.table(spark, sf_dir, "pages", "page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "ratio", "score")
