"""Operator 7: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, all rates over its words or bytes:

* lexicon densities: words (and word beginnings of 4 to 7 bytes, for inflected
  or unseen forms) that are far more frequent in texts labelled toxic, learned
  from labelled rows, with their summed log-odds and number of distinct hits;
* second-person proximity: lexicon hits within three words of a second-person
  pronoun;
* capitals: share of capital letters, of words in capitals;
* punctuation: exclamation and question marks, other marks, their longest run;
* obfuscation: words that mix letters with digits or masking signs, and lexicon
  hits that appear only after common substitutions are undone.

The lexicon is counted on Spark; boosted trees and isotonic regression are
Spark ML's.  Labelled rows are a bounded sample by a hash of the id, in three
disjoint parts (lexicon, trees, calibration).  Scoring reads all of every text;
labels, language, source and id are no inputs of a score.

Defined cases: null text is scored like the empty text (all features zero);
with labels of one class only, or none, every score is that class's share, or
0.5; repeated rows are scored each; an empty table gives no rows; all other
columns are kept by ``score``, but one of the score's own name gives way to it.  The features of a text do not
depend on its neighbours, on their order or on how long texts are cut into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import common
from regimen.llm.decontaminate import Words
from regimen.llm.quality import ACCEPT, labelled_sample, remainder

#: Labelled rows of each class in the sample; half go to the lexicon, a quarter each to trees and calibration.
ROWS = 3000
BEGINNINGS = (4, 5, 6, 7)
NEAR = 3
TREES, DEPTH = 20, 3

# Second-person pronouns of common languages, lower case.
SECOND_PERSON = ("you your yours yourself ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner "
                 "ihr euch euer tú ti usted ustedes vosotros vuestro su voi lei você vocês")
# Signs used for letters, and the letters they stand for.
MASKED, MEANT = "013457@$!|", "oieastasil"

FEATURES = ["word_hits", "begin_hits", "odds", "distinct", "near_you", "capitals", "capital_words", "exclaims",
            "marks", "mark_run", "mixed", "unmasked"]


def tokens(scan: Words, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(word hashes, hashes of their beginnings, row boundaries): a short word is its own beginning."""
    words, bounds = scan.tile(data, offs)
    start, end = scan.last
    return words, [scan.rolling.spans(start, np.minimum(end, start + p)) for p in BEGINNINGS] if len(words) else [
        words for _ in BEGINNINGS], bounds


class Unmasked(Words):
    """Words after common substitutions are undone; the masking signs belong to words."""

    def __init__(self):
        super().__init__()
        for sign, letter in zip(MASKED, MEANT):
            self.low[ord(sign)], self.word[ord(sign)] = ord(letter), True
        self.word[ord("*")] = True
        self.rolling = common.Rolling(common.byte_values()[self.low])


def word_hash(words: list[str]) -> np.ndarray:
    scan, text = Words(), " ".join(words).encode()
    return np.unique(scan.tile(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


def seen_in(sorted_set: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_set):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values, at


class LongRow:
    """What a row longer than a tile carries from tile to tile."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)  # lexicon entries found
        self.run = 0  # marks at the end
        self.you = self.hit = self.counted = np.zeros(0, bool)  # of the last words


def near_any(flags: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Is a flagged word of the same row within ``NEAR`` words (not the word itself)."""
    near = np.zeros(len(flags), bool)
    for d in range(1, NEAR + 1):
        near[d:] |= flags[:-d] & (row[d:] == row[:-d])
        near[:-d] |= flags[d:] & (row[d:] == row[:-d])
    return near


class Features:
    def __init__(self, lexicon: np.ndarray, odds: np.ndarray):
        self.lexicon, self.odds = lexicon, odds
        self.scan, self.plain = Words(), Unmasked()
        self.you = word_hash(SECOND_PERSON.split())
        b = np.arange(256)
        self.upper = ((b >= 65) & (b <= 90)).astype(np.int64)
        self.letter = (self.upper == 1) | ((b >= 97) & (b <= 122)) | (b >= 128)
        self.digit = (b >= 48) & (b <= 57)
        self.exclaim = (b == 33) | (b == 63)
        self.mark = ((b > 32) & (b < 48)) | ((b > 57) & (b < 65)) | ((b > 90) & (b < 97)) | ((b > 122) & (b < 127))

    def rates(self, col: pa.Array) -> np.ndarray:
        data, offs = common.text_buffers(col)
        out = np.zeros((len(offs) - 1, len(FEATURES)))
        size = np.zeros((len(offs) - 1, 3))  # words, bytes, letters
        state = None
        for i, j, lo, hi in common.segments(data, offs, common.TILE, self.plain.cut):
            if j == i + 1 and (lo > offs[i] or hi < offs[j]):  # part of a long row
                state = LongRow() if lo == offs[i] else state
            else:
                state = None
            bounds = np.clip(offs[i:j + 1], lo, hi) - lo
            self.tile(data[lo:hi], bounds, out[i:j], size[i:j], state)
        words, length, letters = (np.maximum(1, size[:, k]) for k in range(3))
        for k, by in enumerate([words, words, words, np.ones(len(words)), words, letters, words, length, length,
                                np.ones(len(words)), words, words]):
            out[:, k] /= by
        return out

    def tile(self, data: np.ndarray, bounds: np.ndarray, out: np.ndarray, size: np.ndarray, state: "LongRow | None" = None) -> None:
        """Add one tile's counts to its rows; ``mark_run`` is a maximum, ``distinct`` of a long row a count so far."""
        if not len(data):
            return
        rows = len(bounds) - 1
        words, begins, at = tokens(self.scan, data, bounds)
        row = np.repeat(np.arange(rows), np.diff(at))
        add = lambda k, weight, to=out, by=row: to.__setitem__(
            (slice(None), k), to[:, k] + np.bincount(by, weight, rows)[:rows])
        hit, where = seen_in(self.lexicon, words)
        best = np.where(hit, self.odds[where] if len(self.odds) else 0, 0)
        any_hit, key = hit.copy(), words.copy()
        for b in begins:
            found, where = seen_in(self.lexicon, b)
            key = np.where(found & ~any_hit, b, key)
            any_hit |= found
            best = np.maximum(best, np.where(found, self.odds[where] if len(self.odds) else 0, 0))
        add(0, hit)
        add(1, any_hit)
        add(2, best)
        if state is not None:
            state.keys = np.union1d(state.keys, key[any_hit])
            out[0, 3] = len(state.keys)
        elif any_hit.any():
            pairs = np.unique(np.stack([row[any_hit].astype(np.uint64), key[any_hit]]), axis=1)[0].astype(np.int64)
            out[:, 3] += np.bincount(pairs, minlength=rows)[:rows]
        you = seen_in(self.you, words)[0]
        if state is None:
            add(4, any_hit & near_any(you, row))
        else:  # with the last words of the row's earlier tiles
            both = state.you, state.hit, state.counted = [np.concatenate(x) for x in (
                (state.you, you), (state.hit, any_hit), (state.counted, np.zeros(len(you), bool)))]
            now = both[1] & near_any(both[0], np.zeros(len(both[0]), np.int64))
            out[0, 4] += np.count_nonzero(now & ~both[2])
            state.you, state.hit, state.counted = (x[-NEAR:] for x in (both[0], both[1], now))
        by_byte = np.repeat(np.arange(rows), np.diff(bounds))
        upper, mark = self.upper[data], self.mark[data]
        add(5, upper, by=by_byte)
        start, end = self.scan.last
        count = lambda x: np.concatenate([[0], np.cumsum(x)])
        ups, letters, digits = count(upper), count(self.letter[data]), count(self.digit[data])
        of = lambda x: x[end] - x[start]
        add(6, (of(ups) > 1) & (of(ups) == of(letters)))
        add(7, self.exclaim[data], by=by_byte)
        add(8, mark, by=by_byte)
        joined = mark[1:] & mark[:-1] & (by_byte[1:] == by_byte[:-1])  # a run ends with its row
        first = np.flatnonzero(mark & ~np.concatenate([[False], joined]))
        last = np.flatnonzero(mark & ~np.concatenate([joined, [False]])) + 1
        run = last - first
        if state is not None:
            if len(run) and first[0] == 0:
                run[0] += state.run
            state.run = int(run[-1]) if len(run) and last[-1] == len(data) else 0
        np.maximum.at(out[:, 9], by_byte[first], run)
        add(10, (of(letters) > 0) & (of(digits) > 0))
        own = self.plain.tile(data, bounds)[0]
        s2, e2 = self.plain.last
        found = seen_in(self.lexicon, own)[0]
        inner = e2 - s2 > 2
        # hits whose word, as written, is no lexicon word
        as_written = seen_in(np.sort(start[any_hit]).astype(np.int64), s2)[0]
        signs = count(~self.scan.word[data] | self.digit[data])
        add(11, found & inner & ~as_written & (signs[e2] - signs[s2] > 0), by=by_byte[s2])
        size[:, 0] += np.diff(at)
        size[:, 1] += np.diff(bounds)
        size[:, 2] += np.bincount(by_byte, self.letter[data], rows)[:rows]


class ToxicityModel:
    def __init__(self, lexicon: np.ndarray, odds: np.ndarray, trees=None, curve=None, flat: float = 0.5):
        self.lexicon, self.odds, self.trees, self.curve, self.flat = lexicon, odds, trees, curve, flat

    def features(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns but the text, and one column of rates."""
        keep = [c for c in docs.columns if c != text_col]
        source = docs.select(*keep, F.col(text_col))
        schema = T.StructType([*docs.select(*keep).schema.fields]).add("rates", T.ArrayType(T.DoubleType(), False))
        lexicon, odds = self.lexicon, self.odds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            measure = Features(lexicon, odds)
            for batch in batches:
                rates = measure.rates(batch.column(len(keep)))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(rates) + 1) * len(FEATURES), pa.int32()),
                                                  pa.array(rates.ravel()))
                yield pa.record_batch([*batch.columns[:-1], values],
                                      schema=pa.schema([*list(batch.schema)[:-1], pa.field("rates", values.type)]))

        named = source.mapInArrow(run, schema).select(
            *keep, *(F.col("rates")[i].alias(f"rate_{f}") for i, f in enumerate(FEATURES)))
        return VectorAssembler(inputCols=[f"rate_{f}" for f in FEATURES], outputCol="rate_vector").transform(named).drop(
            *(f"rate_{f}" for f in FEATURES))

    def raw(self, features: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        own = ["raw_margin", "raw_probability", "raw_prediction"]
        made = self.trees.transform(features)
        return made.withColumn("margin", vector_to_array("raw_probability")[1]).drop(*own, "rate_vector")

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """All columns but the text, and the score from 0 to 1 (in place of a column of its name)."""
        return common.beside(docs, text_col, self.found, {"raw_score": score_col})

    def found(self, rows: DataFrame) -> DataFrame:
        """``rows`` (row, text) with ``raw_score`` in place of the text."""
        if self.trees is None:
            return rows.withColumn("raw_score", F.lit(self.flat))
        return self.curve.transform(self.raw(self.features(rows)))


def learn_lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and beginnings that mark label 1 in ``rows`` (y, text), with their log-odds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held = Words(), []
        for batch in batches:
            data, offs = common.text_buffers(batch.column(1))
            y = batch.column(0).to_numpy()
            for i, j, lo, hi in common.segments(data, offs, common.TILE, scan.cut):
                words, begins, at = tokens(scan, data[lo:hi], np.clip(offs[i:j + 1], lo, hi) - lo)
                row = np.repeat(np.arange(i, j), np.diff(at))
                every = np.stack([np.tile(row, 1 + len(begins)).astype(np.uint64), np.concatenate([words, *begins])])
                held.append(np.unique(every, axis=1) if every.shape[1] else every)
                if hi < offs[j]:  # a long row counts each token once
                    continue
                every, held = np.concatenate(held, axis=1), []
                row, token = np.unique(every, axis=1) if every.shape[1] else every
                label = y[row.astype(np.int64)]
                token, inverse = np.unique(token, return_inverse=True)
                yield pa.record_batch([pa.array(token.view(np.int64)),
                                       pa.array(np.bincount(inverse, label, len(token)).astype(np.int64)),
                                       pa.array(np.bincount(inverse, 1 - label, len(token)).astype(np.int64))],
                                      names=["token", "bad", "fine"])

    counts = rows.mapInArrow(run, "token long, bad long, fine long").groupBy("token").agg(
        F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    odds = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1) / ((F.col("fine") + 0.5) / (n.get(0, 0) + 1)))
    least = max(3, n.get(1, 0) // 200)
    found = (counts.withColumn("odds", odds).where((F.col("bad") >= least) & (F.col("odds") > 2.5))
             .collect())  # bounded by the sample: every entry is in ``least`` of its toxic texts
    token = np.array([r["token"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([r["odds"] for r in found])[order]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, id_col: str = "doc_id",
        text_col: str = "text") -> ToxicityModel:
    """Learn from the rows of ``labels`` (doc_id and ``label``), which the caller has restricted to training rows."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))
    sample = common.write_shared(texts.join(F.broadcast(labelled_sample(labels, label, rows, 3)), "doc_id")
                                 .select(part.alias("part"), "y", "text"))  # bounded: 2 * rows
    shares = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(shares) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), flat=float(next(iter(shares), 0.5)))
    lexicon, odds = learn_lexicon(sample.where("part < 2").select("y", "text"))
    model = ToxicityModel(lexicon, odds)
    rated = common.write_shared(model.features(sample))
    fits = [rated.where("part = 2"), rated.where("part = 3")]
    if any(x.select("y").distinct().count() < 2 for x in fits):  # too few rows to keep the parts apart
        fits = [rated, rated]
    trees = GBTClassifier(featuresCol="rate_vector", labelCol="y", predictionCol="raw_prediction", maxIter=TREES,
                          maxDepth=DEPTH, seed=11)
    model.trees = trees.setRawPredictionCol("raw_margin").setProbabilityCol("raw_probability").fit(fits[0])
    # the sample has more toxic rows than the labels do: weights restore their shares
    every = {r["y"]: r["count"] for r in labels.groupBy(F.col(label).alias("y")).count().collect()}
    weight = F.when(F.col("y") == 1, every.get(1, 1) / shares[1]).otherwise(every.get(0, 1) / shares[0])
    model.curve = IsotonicRegression(featuresCol="margin", labelCol="y", weightCol="w", predictionCol="raw_score").fit(
        model.raw(fits[1]).withColumn("w", weight))
    return model


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic").where(remainder(3) != 1)
    scored = fit(docs, labels).score(docs)
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
