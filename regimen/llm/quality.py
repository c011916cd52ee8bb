"""Operator 6: a compression classifier of text quality.

Two zstandard dictionaries are trained, on texts labelled good and on texts
labelled bad.  A text is compressed with each, in blocks of ``BLOCK`` bytes so
that a long text is judged like a short one; the difference of the two
compressed sizes per byte becomes a score by isotonic regression on labelled
texts that built no dictionary.

The fit uses a bounded sample of labelled rows (parameters ``DICT_ROWS``,
``DICT_TEXT`` and ``FIT_ROWS``), drawn by a hash of the id; scoring reads every
byte of every text.  Labels, language, source and id are no inputs of a score.

Defined cases: null text is scored like the empty text (difference zero); with
labels of one class only, or none, every score is that class's share, or 0.5;
rows with null labels teach nothing; repeated rows are scored each; an empty
table gives no rows; all other columns are kept by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import common

BLOCK = 2048
#: Labelled rows of each class that build its dictionary, the bytes drawn from all of each, and the dictionary's size.
DICT_ROWS, DICT_TEXT, DICT_BYTES = 2000, 16_384, 112_640
#: Labelled rows, at most, that fit the calibration.
FIT_ROWS = 20_000
#: Bytes added to a text's length, so that a few bytes decide little.
DAMP = 64
LEVEL = 3
ACCEPT = 0.7


def labelled_sample(labels: DataFrame, label: str, per_class: int, salt: int) -> DataFrame:
    """(doc_id, y): at most ``per_class`` rows of each class, the first by a hash of the id; broadcast safely."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null").distinct()
    order = F.xxhash64("doc_id", F.lit(salt))
    return rows.where("y = 1").orderBy(order, "doc_id").limit(per_class).union(
        rows.where("y = 0").orderBy(order, "doc_id").limit(per_class))


def drawn_blocks() -> Column:
    """At most ``DICT_TEXT`` bytes of ``text``: blocks drawn from all of it by a hash of place and id, in text order."""
    places = "sequence(0, greatest(0, octet_length(text) - 1) div {0})".format(BLOCK)
    drawn = f"slice(array_sort(transform({places}, x -> struct(xxhash64(x, doc_id) as h, x as x))), 1, {DICT_TEXT // BLOCK})"
    return F.expr(f"aggregate(array_sort({drawn}.x), cast('' as binary), "
                  f"(a, x) -> concat(a, substring(cast(text as binary), cast(x * {BLOCK} + 1 as int), {BLOCK})))")


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> zstandard.ZstdCompressionDict:
    blocks = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks)
    except zstandard.ZstdError:  # too little text to train on: its bytes are the dictionary
        raw = b"".join(blocks)[-size:]
        return zstandard.ZstdCompressionDict(raw.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Difference:
    """Bad size less good size, per byte."""

    def __init__(self, good: bytes, bad: bytes, raw: tuple[bool, bool]):
        self.made = [self.compressor(d, r) for d, r in zip((good, bad), raw)]

    def compressor(self, data: bytes, raw: bool) -> zstandard.ZstdCompressor:
        kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind),
                                        write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: bytes) -> float:
        sizes = [sum(len(c.compress(text[i:i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self.made]
        return (sizes[1] - sizes[0]) / (len(text) + DAMP)


class QualityModel:
    """Fitted dictionaries and calibration; a few hundred kilobytes, shipped to tasks."""

    def __init__(self, dicts: tuple | None, bounds: list[float], levels: list[float]):
        self.dicts, self.bounds, self.levels = dicts, bounds, levels

    def differences(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns and ``difference``."""
        schema = T.StructType([*docs.schema.fields]).add("difference", "double")
        where, dicts = docs.columns.index(text_col), self.dicts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            measure = Difference(*dicts)
            for batch in batches:
                found = [measure(t.as_py() or b"") for t in batch.column(where).cast(pa.binary())]
                yield pa.record_batch([*batch.columns, pa.array(found, pa.float64())],
                                      names=[*batch.schema.names, "difference"])

        return docs.mapInArrow(run, schema)

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """All columns and the score, from 0 to 1 (in place of a column of its name)."""
        return common.beside(docs, text_col, self.found, {"score": score_col}, keep_text=True)

    def found(self, rows: DataFrame) -> DataFrame:
        """``rows`` (row, text) and score."""
        if self.dicts is None:
            return rows.withColumn("score", F.lit(self.levels[0]))
        schema = T.StructType([*rows.schema.fields]).add("score", "double")
        dicts, bounds, levels = self.dicts, np.array(self.bounds), np.array(self.levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            measure = Difference(*dicts)
            for batch in batches:
                found = [measure(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
                yield pa.record_batch([*batch.columns, pa.array(np.interp(found, bounds, levels))], names=["row", "text", "score"])

        return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", dict_rows: int = DICT_ROWS,
        fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learn from the rows of ``labels`` (doc_id and ``label``), which the caller has restricted to training rows."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    first = labelled_sample(labels, label, dict_rows, 1)
    part = texts.join(F.broadcast(first), "doc_id").select("y", drawn_blocks().alias("t"))  # bounded: 2 * dict_rows * DICT_TEXT
    found = part.where("octet_length(t) > 0").collect()
    good, bad = ([bytes(r["t"]) for r in found if r["y"] == y] for y in (1, 0))
    if not good or not bad:
        return QualityModel(None, [0.0], [1.0 if good else 0.0 if bad else 0.5])
    made = [dictionary(x) for x in (good, bad)]
    raw = tuple(d.dict_id() == 0 for d in made)
    model = QualityModel((made[0].as_bytes(), made[1].as_bytes(), raw), [0.0], [0.5])
    more = labels.join(F.broadcast(first.select("doc_id")), "doc_id", "left_anti")
    # the calibration keeps the shares of the classes: one hash order over both
    rest = (more.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)").distinct()
            .orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(fit_rows))
    pairs = common.write_shared(
        model.differences(texts.join(F.broadcast(rest), "doc_id").select("y", "text")).select("y", "difference"))
    if pairs.select("y").distinct().count() < 2:  # too few rows: calibrate on those of the dictionaries
        pairs = model.differences(texts.join(F.broadcast(first), "doc_id").select("y", "text")).select("y", "difference")
    curve = IsotonicRegression(featuresCol="difference", labelCol="y").fit(pairs)
    return QualityModel(model.dicts, [float(x) for x in curve.boundaries], [float(x) for x in curve.predictions])


def remainder(by: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % by


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    labels = common.table(spark, sf_dir, "labels", "doc_id", "quality").where(remainder(4) != 2)
    return fit(docs, labels)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    scored = trained(spark, docs, sf_dir).score(docs)
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
