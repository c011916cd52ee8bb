"""Operator 1: language identification by prediction by partial matching.

For each language a tree of byte contexts of 0 to ``ORDER`` bytes holds how
often each byte followed; the counts are frozen after training.  A text's code
length under a language is the sum over all its bytes of
-log2 P(byte | longest known context), where a byte that a context has not seen
costs an escape to the next shorter context, whose known-absent bytes are
excluded.  The shortest code wins.

Training counts every byte of every training text on Spark and keeps all grams
in tables of the shared folder; tasks hold the most frequent ones, and the
others are joined (``bytelm.Model``).  Every language of the training rows is
learned.  Language, source and id are no inputs of a prediction.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
so is everything if there is no training text; rows without language teach
nothing; equal code lengths go to the alphabetically first language; repeated
rows are judged each; an empty table gives no rows; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import bytelm, common
from regimen.llm.quality import remainder

ORDER = 3
#: Bytes of evidence that the score counts at most.
EVIDENCE = 40
UNKNOWN = "und"


class LanguageModel:
    def __init__(self, languages: list[str], model: bytelm.Model | None):
        self.languages, self.model = languages, model

    def predict(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang_pred",
                score_col: str = "score") -> DataFrame:
        """All columns but the text, the language and its score from 0 to 1 (in place of columns of these names)."""
        return common.beside(docs, text_col, self.found, {"lang": lang_col, "score": score_col})

    def found(self, rows: DataFrame) -> DataFrame:
        """``rows`` (row, text), lang and score."""
        if self.model is None:
            return rows.withColumns({"lang": F.lit(UNKNOWN), "score": F.lit(0.0)})
        letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has_letter")
        source = self.model.sums(rows.select("row", "text", letters), "text")
        schema = T.StructType([*source.select("row").schema.fields]).add("lang", "string").add("score", "double")
        languages = self.languages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = np.array(languages, object)
            for batch in batches:
                letter, sums, size = batch.columns[-3:]
                bits = pc.list_flatten(sums).to_numpy().reshape(-1, len(names))
                size = np.maximum(1, size.to_numpy())
                best = bits.argmin(axis=1)
                gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1, EVIDENCE / size)[:, None]
                score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
                letter = letter.to_numpy(zero_copy_only=False).astype(bool)
                lang = np.where(letter, names[best], UNKNOWN)
                yield pa.record_batch([*batch.columns[:-3], pa.array(lang.tolist(), pa.string()),
                                       pa.array(np.where(letter, score, 0.0))], names=["row", "lang", "score"])

        return source.mapInArrow(run, schema)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> LanguageModel:
    """Learn from every row of ``docs`` with a language."""
    rows = docs.select(F.col(lang_col).alias("cls"), F.col(text_col).alias("text")).where("cls is not null and text <> ''")
    names = sorted(r["cls"] for r in rows.select("cls").distinct().collect())
    if not names:
        return LanguageModel([], None)
    return LanguageModel(names, bytelm.Model(bytelm.count_grams(rows, order, names), len(names), order, "code_lengths"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(remainder(5) != 0))
    return model.predict(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
