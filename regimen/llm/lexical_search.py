"""Operator 13: ranked lexical search by accumulator-limited term-at-a-time evaluation.

Terms are maximal runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII
characters.  The weights are the contract's integers: a term's
w = floor(1000 ln((2N+2)/(2df+1))), a document's m = 50 + (50 n N div L), and a
score is the sum of w * (10^9 tf div (1000 tf + 20 m)) over an item's distinct terms.

1. The query set (items) is handled in blocks of at most about ``BLOCK_TERMS`` distinct terms, so what the
   driver and the tasks hold of it is bounded, however many items there are.
2. Every document is indexed: tasks write inverted blocks (postings sorted by term, of at most
   ``INDEX_DOCS`` documents) as a table in the shared folder, with the block's own df; Spark sums N, L and df.
3. Each inverted block answers all items term at a time, rarest (smallest df) first.  A term's bound is its
   largest contribution in the block.  Once the kth best partial score (or the kth best final
   score of the task's earlier blocks) exceeds the sum of the remaining terms' bounds, no document
   without an accumulator can reach the first k: no more accumulators are made, and those
   that exist go on being updated exactly.
4. A task emits k documents an item; a window over items ranks them (Spark limits each
   partition's group to k before the shuffle).

Defined cases: null, empty or wordless texts and items have no terms and neither rank nor are ranked; repeated
document rows and shared ids are ranked each on their own; null ids come last among equal scores; every
row of the items is a query of its own, also with a null or shared item_id; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import common
from regimen.llm.decontaminate import Words

K = 50
#: Distinct terms of one block of the query set (about), of one index block's documents, and its postings.
BLOCK_TERMS = 1 << 20
INDEX_DOCS = 1 << 13
INDEX_POSTINGS = 1 << 19


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms: sorted hashes of the distinct terms) of every item that has terms."""
    source = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    schema = source.select("item_id").schema.add("terms", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Words()
        for batch in batches:
            for i, _, words, bounds in scan.groups(batch.column(1)):
                own = [(i + r, np.unique(words[bounds[r]:bounds[r + 1]].view(np.int64)))
                       for r in np.flatnonzero(np.diff(bounds))]
                if own:
                    yield pa.record_batch([batch.column(0).take(pa.array([r for r, _ in own])),
                                           pa.array([t for _, t in own], pa.list_(pa.int64()))], names=["item_id", "terms"])

    return source.mapInArrow(run, schema)


def index_schema(id_type: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    return (T.StructType().add("with_terms", "long").add("n_terms", "long")
            .add("ids", T.ArrayType(id_type)).add("n", T.ArrayType(T.LongType()))
            .add("term", ints).add("df", ints).add("row", ints).add("tf", ints))


class IndexBlock:
    """Documents and postings on their way to one inverted block."""

    def __init__(self):
        self.with_terms = self.n_terms = self.docs = self.postings = 0
        self.ids, self.n, self.row, self.term, self.tf = [], [], [], [], []

    def add(self, ids: pa.Array, words: np.ndarray, bounds: np.ndarray, vocab: np.ndarray) -> None:
        n = np.diff(bounds)
        self.with_terms += int((n > 0).sum())
        self.n_terms += len(words)
        if not len(vocab):
            return
        at = np.searchsorted(vocab, words)
        at[at == len(vocab)] = 0
        hit = np.flatnonzero(vocab[at] == words)
        row = np.searchsorted(bounds, hit, side="right") - 1
        code, tf = np.unique(row * np.int64(len(vocab)) + at[hit], return_counts=True)
        row, term = code // len(vocab), code % len(vocab)
        rows, place = np.unique(row, return_inverse=True)  # only documents that hold some term of the items
        self.ids.append(ids.take(pa.array(rows)))
        self.n.append(n[rows])
        self.row.append(place + self.docs)
        self.term.append(term)
        self.tf.append(tf)
        self.docs += len(rows)
        self.postings += len(row)

    def batch(self, ids_type: pa.DataType) -> pa.RecordBatch:
        def one(values, kind):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        row, term, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.row, self.term, self.tf))
        order = np.argsort(term, kind="stable")
        terms, df = np.unique(term, return_counts=True)
        ids = pa.chunked_array(self.ids, ids_type).combine_chunks() if self.ids else pa.array([], ids_type)
        n = np.concatenate(self.n) if self.n else np.zeros(0, np.int64)
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks)
        return pa.record_batch([
            pa.array([self.with_terms]), pa.array([self.n_terms]),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(n, pa.int64()),
            one(terms, pa.int32()), one(df, pa.int32()), one(row[order], pa.int32()), one(tf[order], pa.int32())],
            names=["with_terms", "n_terms", "ids", "n", "term", "df", "row", "tf"])


def index_documents(docs: DataFrame, vocab: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Inverted blocks over the terms ``vocab`` (sorted hashes) of every document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, block, kind = Words(), IndexBlock(), None
        for batch in batches:
            kind = batch.column(0).type
            for i, j, words, bounds in scan.groups(batch.column(1)):
                block.add(batch.column(0).slice(i, j - i), words, bounds, shared.value)
                if block.docs >= INDEX_DOCS or block.postings >= INDEX_POSTINGS:
                    yield block.batch(kind)
                    block = IndexBlock()
        if block.n_terms:
            yield block.batch(kind)

    return source.mapInArrow(run, index_schema(source.schema["doc_id"].dataType))


def document_norms(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents of n terms; exact beyond 64-bit products."""
    if not len(n) or int(n.max()) * 50 * docs < 1 << 63:
        return 50 + (50 * n * docs) // words
    return np.array([50 + (50 * int(x) * docs) // words for x in n], np.int64)


def best_documents(block: dict, items: list[np.ndarray], weight: np.ndarray, rank: np.ndarray, docs: int, words: int,
                   k: int, kept: list[list], made: list[int] | None = None) -> None:
    """Evaluate all ``items`` (their term numbers) on one inverted block; ``kept`` has each item's best
    (-score, id is null, id) so far.  ``rank`` orders terms by df; ``made`` counts accumulators."""
    m = document_norms(block["n"], docs, words)
    offs = np.concatenate([[0], np.cumsum(block["df"])])
    row, tf = block["row"], block["tf"].astype(np.int64)
    impact = np.repeat(weight[block["term"]], block["df"]) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
    bound = np.maximum.reduceat(impact, offs[:-1]) if len(impact) else np.zeros(0, np.int64)
    score, alive = np.zeros(len(m), np.int64), np.zeros(len(m), bool)
    for q, terms in enumerate(items):
        at = np.flatnonzero(np.isin(block["term"], terms))
        if not len(at):
            continue
        at = at[np.argsort(rank[block["term"][at]], kind="stable")]
        left = np.cumsum(bound[at][::-1])[::-1]
        final = -kept[q][-1][0] if len(kept[q]) == k else 0
        score[:], alive[:] = 0, False
        growing = True
        for i, t in enumerate(at):
            r, v = row[offs[t]:offs[t + 1]], impact[offs[t]:offs[t + 1]]
            if growing:
                partial = final
                if score.max() > left[i] and np.count_nonzero(score > left[i]) >= k:
                    partial = int(left[i]) + 1
                growing = partial <= left[i]
            if not growing:
                known = alive[r]
                r, v = r[known], v[known]
            score[r] += v
            alive[r] = True
        if made is not None:
            made[q] += int(alive.sum())
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[score[found] >= final]
        if len(found):
            ids = block["ids"].take(pa.array(found)).to_pylist()
            kept[q] = heapq.nsmallest(k, kept[q] + [(-s, x is None, x) for s, x in zip(score[found].tolist(), ids)],
                                      key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))


def search_block(docs: DataFrame, items: list[tuple], first: int, item_type: T.DataType, id_col: str, text_col: str,
                 k: int) -> DataFrame:
    """(q, item_id, doc_id, score): each task's best documents for the collected ``items`` (item_id, terms)."""
    spark = docs.sparkSession
    vocab = np.unique(np.concatenate([np.array(t, np.int64) for _, t in items]).view(np.uint64))
    index = common.write_shared(index_documents(docs, vocab, id_col, text_col))
    total = index.agg(F.sum("with_terms"), F.sum("n_terms")).first()
    n_docs, n_words = total[0] or 0, total[1] or 0
    df = np.zeros(len(vocab), np.int64)
    zipped = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).select("x.*")
    for t, n in zipped.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[t] = n  # as many rows as the block has terms
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    terms = [np.searchsorted(vocab, np.array(t, np.int64).view(np.uint64)) for _, t in items]
    terms = [np.sort(t).astype(np.int32) for t in terms]
    shared = spark.sparkContext.broadcast((terms, weight, rank))
    id_type = index.schema["ids"].dataType.elementType
    out = T.StructType().add("q", "long").add("doc_id", id_type).add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w, by_df = shared.value
        kept, kind = [[] for _ in queries], None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for b in range(batch.num_rows):
                cells = {c: batch.column(c)[b].values for c in ("ids", "n", "term", "df", "row", "tf")}
                block = {c: v if c == "ids" else v.to_numpy(zero_copy_only=False) for c, v in cells.items()}
                best_documents(block, queries, w, by_df, n_docs, n_words, k, kept)
        found = [(q, e) for q, best in enumerate(kept) for e in best]
        if found:
            yield pa.record_batch([pa.array([first + q for q, _ in found], pa.int64()),
                                   pa.array([e[2] for _, e in found], kind),
                                   pa.array([-e[0] for _, e in found], pa.int64())], names=["q", "doc_id", "score"])

    names = spark.createDataFrame([(first + q, i) for q, (i, _) in enumerate(items)],
                                  T.StructType().add("q", "long").add("item_id", item_type))
    return index.mapInArrow(run, out).join(F.broadcast(names), "q")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank int, doc_id, score long): each item's first ``k`` documents with a score above 0."""
    queries = common.write_shared(item_terms(items, item_col, item_text))
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-size // block_terms)
    item_type = queries.schema["item_id"].dataType
    found = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.terms) for r in part.collect()]  # one block of the query set: about block_terms terms
        if rows:
            one = search_block(docs, rows, b << 32, item_type, id_col, text_col, k)
            found = one if found is None else found.union(one)
    if found is None:
        id_type = docs.schema[id_col].dataType
        found = docs.sparkSession.createDataFrame([], T.StructType().add("q", "long").add("doc_id", id_type)
                                                  .add("score", "long").add("item_id", item_type))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search(common.table(spark, sf_dir, "documents", "doc_id", "text"),
                  common.table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE = r"""
with w as (
  select doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
p as (select doc_id, term, count(*) as tf from w group by all),
d as (select doc_id, sum(tf)::bigint as n from p group by all),
s as (select count(*) as nn, sum(n)::bigint as ll from d),
f as (select term, count(*) as df from p group by all),
q as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
g as (
  select q.item_id, p.doc_id, sum(
    floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint
    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from q join p using (term) join f using (term) join d on d.doc_id = p.doc_id cross join s
  group by all)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from g where score > 0)
where rank <= 50
"""
