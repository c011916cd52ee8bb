"""Operator 4: removal of repeated byte strings by suffix arrays.

Every byte covered by a ``span``-byte (200) string that also starts anywhere
else is removed; texts are judged as they came, matches stay within a text.

1. Anchors.  In every window of ``span`` bytes the smallest of its ``gram``-byte
   hashes (leftmost on ties) is the window's anchor.  Equal windows have equal
   anchors, so windows are compared only below the same anchor; neighbouring
   windows mostly share one.  A run of windows with one anchor is a context:
   one row of a few numbers for about 85 bytes of text.
2. Anchors that occur once are done (shuffle and join on the hash).  Contexts
   that are equal as a whole are one class: with two or more members all their
   bytes repeat.  Only one member of each class goes on, and only where an
   anchor has several classes: the places where copies begin to differ.
3. Shards.  Those contexts' bytes are fetched and laid out by anchor in shards
   of a bounded size.  Each shard's suffix array is built by induced sorting and
   its permuted common prefixes are computed (``sais``); a window start whose
   common prefix with a neighbour in the array is ``span`` or more repeats.
4. An anchor with very many different contexts (a common line between different
   neighbours) would not fit a shard: its windows are counted instead, as rows
   of two independent 64-bit hashes, with partial sums.

Classes are told apart by two 64-bit hashes (of the anchor and of the whole
context); shards compare bytes.

Defined cases: null text is empty; texts shorter than ``span`` keep everything;
a row that occurs twice repeats itself and loses every byte a window covers;
rows are told apart by id and text, so shared ids do no harm; an empty table
gives no rows; other columns are ignored by the operator and kept by the
pipeline stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.llm import common, sais

SPAN, GRAM = 200, 32
#: Bytes of contexts in one suffix array, and contexts of one anchor that go to one shard.
SHARD_BYTES, SHARD_CONTEXTS = 1 << 20, 2048
POS_BITS = 20


class Anchors:
    """Contexts (runs of window starts with one anchor) of a text column."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram, self.rolling = span, gram, common.Rolling()

    def tiles(self, col: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, anchor hash, first start, last start, context hash); starts count from the row's first byte."""
        data, offs = common.text_buffers(col)
        for i, j, lo, hi in common.segments(data, offs, common.TILE, lambda data, stop, end: stop):
            stop = min(hi + self.span - 1, int(offs[j])) if hi < offs[j] else hi
            if stop - lo < self.span:
                continue
            bounds = np.append(offs[i:j], stop) if j > i + 1 else np.array([lo, stop])
            yield self.tile(data[lo:stop], bounds - lo, i, lo - offs[i:j])

    def tile(self, data: np.ndarray, bounds: np.ndarray, first_row: int, shift: np.ndarray) -> tuple[np.ndarray, ...]:
        span, gram, n = self.span, self.gram, len(data)
        self.rolling.load(data)
        h = self.rolling.fixed(gram)
        mask = np.uint64((1 << POS_BITS) - 1)
        low = common.sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), span - gram + 1)
        last = bounds[1:] - span  # last window start of each row
        valid = np.zeros(n + 1, np.int32)
        rows = np.flatnonzero(last >= bounds[:-1])
        np.add.at(valid, bounds[rows], 1)
        np.add.at(valid, last[rows] + 1, -1)
        start = np.flatnonzero(np.cumsum(valid[:n]) > 0)
        if not len(start):
            return (np.zeros(0, np.int64),) * 5
        anchor = (low[start] & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
        a, lo = anchor[first], start[first]
        hi = start[np.append(first[1:], len(start)) - 1]
        row = np.searchsorted(bounds, lo, side="right") - 1
        base = np.where(len(shift) == 1, bounds[row] - shift[0], bounds[row])
        context = self.rolling.spans(lo, hi + span)
        return row + first_row, h[a].view(np.int64), lo - base, hi - base, context.view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): rows are told apart by id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def contexts(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc_id, th, h, lo, hi, ctx) of every context of every row."""
    schema = rows.select("doc_id", "th").schema
    for name in ("h", "lo", "hi", "ctx"):
        schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Anchors(span, gram)
        for batch in batches:
            for row, *found in scan.tiles(batch.column(2)):
                if len(row):
                    at = pa.array(row)
                    yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, found)],
                                          names=["doc_id", "th", "h", "lo", "hi", "ctx"])

    return rows.mapInArrow(run, schema)


def packed(rows: DataFrame) -> DataFrame:
    """(doc_id, th, z): texts compressed, so that a shuffle of them is small."""
    schema = rows.select("doc_id", "th").schema.add("z", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [squeeze.compress(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["doc_id", "th", "z"])

    return rows.mapInArrow(run, schema)


def same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, th), null ids being equal."""
    right = right.withColumnRenamed("doc_id", "own_id").withColumnRenamed("th", "own_th")
    on = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th"))
    return left.join(right, on, how).drop("own_id", "own_th")


def repeated_starts(rows: DataFrame, span: int = SPAN, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, th, lo, hi): intervals of window starts whose window repeats."""
    every = common.write_shared(contexts(rows, span, gram))
    # written first: the join then has a shuffle of its own on both sides, and a hot anchor's rows can be split
    shared = common.write_shared(every.groupBy("h").count().where("count > 1").select("h"))
    open_ = common.write_shared(every.join(shared, "h"))
    classes = common.write_shared(
        open_.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi")).alias("of")))
    whole = (open_.join(classes.where("n > 1").select("h", "ctx"), ["h", "ctx"]).select("doc_id", "th", "lo", "hi"))
    several = (classes.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
               .where("kinds > 1 and least = 1").select("h", (F.col("kinds") > shard_contexts).alias("crowded")))
    several = common.write_shared(several)
    compare = classes.join(several, "h").select("h", "crowded", "n", "of.*")
    wanted = compare.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "crowded", "n", "lo", "hi")).alias("parts"))
    texts = common.write_shared(cut_out(same_row(packed(rows), wanted, "inner"), span))
    size = texts.where("not crowded").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = texts.where("not crowded").repartition(max(1, -(-size // shard_bytes)), "h").sortWithinPartitions("h")
    return whole.union(compare_shards(shards, span, shard_bytes)).union(
        compare_windows(texts.where("crowded"), span))


def cut_out(found: DataFrame, span: int) -> DataFrame:
    """(h, crowded, n, doc_id, th, lo, bytes): the bytes of each wanted context."""
    schema = found.select(F.explode("parts").alias("p"), "doc_id", "th").select(
        "p.h", "p.crowded", "p.n", "doc_id", "th", "p.lo").schema.add("bytes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            lists = batch.column("parts")
            part, of = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            lo, hi = part.field("lo").to_numpy(), part.field("hi").to_numpy()
            out, raw, last = [], b"", -1
            for i, a, b in zip(of.tolist(), lo.tolist(), hi.tolist()):
                if i != last:
                    raw, last = expand.decompress(batch.column("z")[i].as_py()), i
                out.append(raw[a:b + span])
            at = pa.array(of)
            yield pa.record_batch([part.field("h"), part.field("crowded"), part.field("n"), batch.column("doc_id").take(at),
                                   batch.column("th").take(at), part.field("lo"), pa.array(out, pa.binary())],
                                  names=["h", "crowded", "n", "doc_id", "th", "lo", "bytes"])

    return found.mapInArrow(run, schema)


def shard_repeats(parts: list[bytes], span: int) -> list[np.ndarray]:
    """For each part, the starts in it whose ``span`` bytes also start elsewhere in the parts."""
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 2
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    text[ends] = 1
    text[-1] = 0
    sa = sais.suffix_array(text)
    prefix = sais.permuted_prefixes(text, sa, span)
    follows = np.zeros(len(text), np.int64)
    follows[sa[:-1]] = prefix[sa[1:]]
    hit = (prefix >= span) | (follows >= span)
    begins = np.concatenate([[0], ends[:-1] + 1])
    hit[ends] = False
    return [np.flatnonzero(hit[a:max(a, b - span + 1)]) for a, b in zip(begins, ends)]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of consecutive numbers."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], new])], starts[np.concatenate([new, [len(starts)]]) - 1]


def compare_shards(texts: DataFrame, span: int, shard_bytes: int) -> DataFrame:
    """Repeated starts of the contexts that stand alone, by one suffix array a shard; ``texts`` is ordered by anchor."""
    schema = texts.select("doc_id", "th").schema.add("lo", "long").add("hi", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            h = table.column("h").to_numpy()
            size = np.cumsum([len(x) for x in table.column("bytes").to_pylist()]) if len(table) else np.zeros(0)
            change = np.concatenate([np.flatnonzero(np.diff(h)) + 1, [len(h)]])
            begin = 0
            while begin < len(h):
                limit = (size[begin - 1] if begin else 0) + shard_bytes
                fit = change[(change > begin) & (size[change - 1] <= limit)]
                end = int(fit[-1]) if len(fit) else int(change[change > begin][0])
                part = table.slice(begin, end - begin)
                n, lo = part.column("n").to_numpy(), part.column("lo").to_numpy()
                at, first, last = [], [], []
                for i, starts in enumerate(shard_repeats(part.column("bytes").to_pylist(), span)):
                    if n[i] == 1 and len(starts):
                        a, b = runs(starts)
                        at.append(np.full(len(a), i))
                        first.append(lo[i] + a)
                        last.append(lo[i] + b)
                if at:
                    rows = part.select(["doc_id", "th"]).take(pa.array(np.concatenate(at))).combine_chunks()
                    yield pa.record_batch([*(c.chunk(0) for c in rows.columns), pa.array(np.concatenate(first)),
                                           pa.array(np.concatenate(last))], names=["doc_id", "th", "lo", "hi"])
                begin = end

        gathered = 0
        for batch in batches:
            held.append(batch)
            gathered += batch.nbytes
            if gathered > 2 * shard_bytes:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1], side="left"))  # the last anchor may go on
                if whole:
                    yield from solve(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    gathered = sum(b.nbytes for b in held) if held else 0
        if held:
            yield from solve(pa.Table.from_batches(held))

    return texts.mapInArrow(run, schema)


def compare_windows(texts: DataFrame, span: int) -> DataFrame:
    """Repeated starts of contexts whose anchor is crowded: each window is a row, counted by two hashes."""
    schema = texts.select("doc_id", "th").schema.add("lo", "long").add("w1", "long").add("w2", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = common.Rolling(), common.Rolling(common.byte_values()[::-1].copy())
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                data, offs = common.text_buffers(part.column("bytes"))
                data, offs = data[offs[0]:offs[-1]], offs - offs[0]
                at, start = [], []
                for i in range(part.num_rows):
                    at.append(np.full(offs[i + 1] - offs[i] - span + 1, i))
                    start.append(np.arange(offs[i], offs[i + 1] - span + 1))
                at, start = np.concatenate(at), np.concatenate(start)
                hashes = []
                for rolling in (one, two):
                    rolling.load(data)
                    hashes.append(pa.array(rolling.fixed(span)[start].view(np.int64)))
                rows = pa.array(at)
                yield pa.record_batch([part.column("doc_id").take(rows), part.column("th").take(rows),
                                       pa.array(part.column("lo").to_numpy()[at] + start - offs[at]), *hashes],
                                      names=["doc_id", "th", "lo", "w1", "w2"])

    windows = texts.mapInArrow(run, schema)
    again = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return windows.join(again, ["w1", "w2"]).select("doc_id", "th", "lo", F.col("lo").alias("hi"))


def kept_bytes(found: DataFrame, span: int, as_text: bool) -> DataFrame:
    """(doc_id, th, kept, n_removed, n_spans) from (doc_id, th, z, starts); as text, cut characters are dropped."""
    schema = (found.select("doc_id", "th").schema.add("kept", "string" if as_text else "binary")
              .add("n_removed", "long").add("n_spans", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, removed, spans = [], [], []
            for z, parts in zip(batch.column("z"), batch.column("starts")):
                raw = expand.decompress(z.as_py())
                lo, hi = (parts.values.field(x).to_numpy() for x in ("lo", "hi"))
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi + span, -1)
                gone = np.cumsum(edge[:-1]) > 0
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(kept, pa.string() if as_text else pa.binary()),
                                   pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                                  names=["doc_id", "th", "kept", "n_removed", "n_spans"])

    return found.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text", as_text: bool = False) -> DataFrame:
    """(doc_id, th, kept, n_removed, n_spans) of the rows that lose bytes; equal rows (id and text) appear each."""
    rows = keyed(docs, id_col, text_col)
    starts = repeated_starts(rows, span, gram)
    per_row = starts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    return kept_bytes(same_row(packed(rows), per_row, "inner"), span, as_text)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    lost = (remove_repeats(docs).select("doc_id", "th", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
            .dropDuplicates(["doc_id", "th"]))
    every = keyed(docs, "doc_id", "text").select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"),
                                                 F.sha2("text", 256).alias("whole"))
    return same_row(every, lost, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
