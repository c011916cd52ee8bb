"""Operator 2: benchmark decontamination by winnowing.

Words are maximal runs of digits, lower-cased ASCII letters and non-ASCII
characters.  A window is ``span`` (13) consecutive words of a benchmark item,
or all words of a shorter item.

* Winnowing: a window's fingerprint is the smallest of its ``span - k + 1``
  k-gram hashes.  Equal windows have equal fingerprints, so every shared span
  of 13 words is found; neighbouring windows mostly share theirs.
* Join: document fingerprints that are absent from a fixed-size bitmap of the
  benchmark's cannot match and stay in the task; the bitmap's size is a
  parameter, whatever the benchmark's.  The others are joined with the
  benchmark's on (fingerprint, window hash) by an ordinary Spark join, so
  neither side needs to fit anywhere.
* Extension: a joined hit covers all words of the window; the union of a
  document's hits gives its hit words.  Windows are compared by two
  independent 64-bit values (the fingerprint, the hash of all words).
* Items of fewer words than a window are below what winnowing guarantees:
  for each such length that occurs (at most 12), documents' n-grams go through
  the same bitmap and join.

Defined cases: null or wordless text has no words and is not contaminated;
wordless items have no window; ``decontaminate`` judges rows with the same id
together, ``decontaminate_rows`` (the query) each row by itself, also with null
or shared ids; repeated items count by their distinct ids; empty tables give no
rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import common

SPAN, GRAM = 13, 5
#: log2 of the bits of the benchmark bitmap (half a megabyte).
BITMAP_LOG2 = 22


def lowered() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased byte, is it part of a word) by byte value."""
    b = np.arange(256, dtype=np.uint8)
    low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    return low, ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)


class Words:
    """Hashes of the words of a text column, tile by tile."""

    def __init__(self):
        self.low, self.word = lowered()
        self.rolling = common.Rolling(common.byte_values()[self.low])

    def cut(self, data: np.ndarray, stop: int, end: int) -> int:
        """The first place from ``stop`` on that is no word byte."""
        while stop < end:
            other = np.flatnonzero(~self.word[data[stop:stop + 4096][:end - stop]])
            if len(other):
                return stop + int(other[0])
            stop += 4096
        return end

    def groups(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, word hashes, row boundaries in them), for runs of rows or one long row."""
        data, offs = common.text_buffers(col)
        held: list[np.ndarray] = []
        for i, j, lo, hi in common.segments(data, offs, common.TILE, self.cut):
            hashes, bounds = self.tile(data[lo:hi], offs[i:j + 1] - lo)
            if j == i + 1 and (lo > offs[i] or hi < offs[j]):  # part of a long row
                held.append(hashes)
                if hi < offs[j]:
                    continue
                hashes, held = np.concatenate(held), []
                bounds = np.array([0, len(hashes)])
            yield i, j, hashes, bounds

    def locate(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of every word; rows that touch are kept apart."""
        inside = self.word[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        cuts = np.flatnonzero(edge)
        inner = offs[(offs > 0) & (offs < len(data))]
        joined = np.unique(inner[inside[inner] & inside[inner - 1]])
        if len(joined):
            cuts = np.sort(np.concatenate([cuts, joined, joined]), kind="stable")
        return cuts[::2], cuts[1::2]

    def tile(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, row boundaries in them); ``last`` keeps where the words are."""
        if not len(data):
            self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
        self.last = self.locate(data, offs)
        self.rolling.load(data)
        return self.rolling.spans(*self.last), np.searchsorted(self.last[0], offs)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, by its first."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(common.BASE) + words[i:i + m]
    return common.mix64(out + np.uint64(n))


def windows(words: np.ndarray, bounds: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, fingerprint) of every window that lies within one row; words count over all rows."""
    low = common.sliding_min(grams(words, k), span - k + 1)
    row = np.searchsorted(bounds, np.arange(len(low)), side="right") - 1
    fits = np.arange(len(low)) + span <= bounds[row + 1] if len(low) else np.zeros(0, bool)
    at = np.flatnonzero(fits)
    return row[at], at, low[at]


ITEM_SCHEMA = "fp long, win long, n int"


def item_windows(bench: DataFrame, span: int = SPAN, k: int = GRAM, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """(item_id, fp, win, n words): every window of every item."""
    source = bench.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    schema = source.select("item_id").schema.add("fp", "long").add("win", "long").add("n", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Words()
        for batch in batches:
            for i, _, words, bounds in scan.groups(batch.column(1)):
                row, at, fp = windows(words, bounds, span, k)
                win, n = grams(words, span)[at], np.full(len(at), span)
                for r in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < span)):
                    own = words[bounds[r]:bounds[r + 1]]
                    row, win = np.append(row, r), np.append(win, grams(own, len(own)))
                    fp, n = np.append(fp, grams(own, len(own))), np.append(n, len(own))
                yield pa.record_batch([batch.column(0).take(pa.array(i + row)), pa.array(fp.view(np.int64)),
                                       pa.array(win.view(np.int64)), pa.array(n.astype(np.int32))],
                                      names=["item_id", "fp", "win", "n"])

    return source.mapInArrow(run, schema).distinct()


def bitmap(items: DataFrame, log2: int = BITMAP_LOG2) -> np.ndarray:
    """2^log2 bits: those of the items' fingerprints and window hashes are set.  A fixed size, built on Spark."""
    bit = F.explode(F.array("fp", "win"))
    at = items.select(bit.alias("h")).select(F.expr(f"pmod(h, {1 << log2})").alias("p")).distinct()
    parts = (at.groupBy((F.col("p") / 32768).cast("long").alias("part"))
             .agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits")).collect())  # 2^log2 / 32768 rows at most
    out = np.zeros((1 << log2) // 8, np.uint8)
    for r in parts:
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    p = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def candidates(docs: DataFrame, bits: np.ndarray, short: list[int], span: int = SPAN, k: int = GRAM,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, fp, win, n, starts): windows of each document that the bitmap does not rule out,
    one row for each distinct window, and one row without window that holds the word count."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (source.select("doc_id").schema.add("n_words", "long").add("fp", "long").add("win", "long")
              .add("n", "integer").add("starts", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Words()
        for batch in batches:
            for i, j, words, bounds in scan.groups(batch.column(1)):
                row, at, fp = windows(words, bounds, span, k)
                maybe = has(bits, fp)
                row, at, fp = row[maybe], at[maybe], fp[maybe]
                win = grams(words, span)[at] if len(at) else fp
                n = np.full(len(at), span)
                for size in short:
                    each = grams(words, size)
                    hit = np.flatnonzero(has(bits, each))
                    r = np.searchsorted(bounds, hit, side="right") - 1
                    hit, r = hit[hit + size <= bounds[r + 1]], r[hit + size <= bounds[r + 1]]
                    row, at, n = np.append(row, r), np.append(at, hit), np.append(n, np.full(len(hit), size))
                    fp, win = np.append(fp, each[hit]), np.append(win, each[hit])
                sure = has(bits, win)
                row, at, fp, win, n = (x[sure] for x in (row, at, fp, win, n))
                order = np.lexsort((at, win, fp, n, row))
                row, at, fp, win, n = (x[order] for x in (row, at, fp, win, n))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (win[1:] != win[:-1]) | (fp[1:] != fp[:-1]) | (n[1:] != n[:-1])
                first = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(row)), pa.int32()), pa.array((at - bounds[row]).astype(np.int32)))
                rows = np.arange(i, j)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.diff(bounds)), pa.nulls(j - i, pa.int64()),
                     pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.list_(pa.int32()))],
                    schema=found_schema(batch))
                if len(first):
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(i + row[first])), pa.nulls(len(first), pa.int64()),
                         pa.array(fp[first].view(np.int64)), pa.array(win[first].view(np.int64)),
                         pa.array(n[first].astype(np.int32)), lists], schema=found_schema(batch))

    return source.mapInArrow(run, schema)


def found_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([pa.field("doc_id", batch.schema.field(0).type), ("n_words", pa.int64()), ("fp", pa.int64()),
                      ("win", pa.int64()), ("n", pa.int32()), ("starts", pa.list_(pa.int32()))])


def covered(intervals: str) -> str:
    """SQL: how many whole numbers lie in a sorted array of structs (s, e) of half-open intervals."""
    return (f"aggregate({intervals}, named_struct('hit', 0L, 'top', -1), "
            "(a, x) -> named_struct('hit', a.hit + greatest(0, x.e - greatest(x.s, a.top)), "
            "'top', greatest(a.top, x.e)), a -> a.hit)")


def decontaminate(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = GRAM, share: int = 20,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Per document id: n_words, n_hit, items (sorted array of strings), contaminated
    (any hit, and at least one word in ``share`` hit), and how many rows have the id."""
    items = common.write_shared(item_windows(bench, span, k, item_col, item_text_col))
    short = sorted(r["n"] for r in items.select("n").distinct().collect() if r["n"] < span)  # at most span - 1
    found = common.write_shared(candidates(docs, bitmap(items), short, span, k, id_col, text_col))
    # windows with the same items are one class, so that a long shared passage does not repeat its items
    classes = items.groupBy("fp", "win", "n").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    hits = found.where("win is not null").join(classes, ["fp", "win", "n"]).select("doc_id", "n", "starts", "ids")
    spans = F.expr("transform(starts, x -> named_struct('s', x, 'e', x + n))")
    per_doc = hits.groupBy("doc_id").agg(
        F.array_sort(F.flatten(F.collect_set(spans))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    per_doc = per_doc.select("doc_id", F.expr(covered("spans")).alias("n_hit"), F.col("ids").alias("items"))
    counts = found.where("win is null").groupBy("doc_id").agg(F.max("n_words").alias("n_words"),
                                                                   F.count("*").alias("n_rows"))
    return (counts.join(per_doc.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "n_rows")
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def decontaminate_rows(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       **options) -> DataFrame:
    """The same for every row by itself, whether ids are null or shared: rows are told apart by id and text."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    found = decontaminate(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), bench, **options)
    each = found.withColumn("row_", F.explode(F.expr("sequence(1L, n_rows)")))  # equal rows have equal results
    return each.select(F.col("doc_id.id").alias("doc_id"), "n_words", "n_hit", "items", "contaminated")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark items."""
    out = decontaminate_rows(common.table(spark, sf_dir, "documents", "doc_id", "text"),
                             common.table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
