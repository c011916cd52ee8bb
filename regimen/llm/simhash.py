"""Operator 9: SimHash near-duplicates joined by Golay-code fuzzy keys.

A text's fingerprint has bit b set when more than half of its shingles'
XXH64 values have it set.  Two fingerprints link at ``max_bits`` (3) or fewer
differing bits.  Links are found with a reversed error-correcting code:

* the 64 bits form four 16-bit segments.  With at most three errors some
  segment is free of errors and the next one (cyclically) has at most one:
  were every clean segment followed by one with two or more errors, only one
  segment could be clean and the errors would add up to four;
* the perfect Golay code [23, 12, 7] puts each (zero-padded) segment into the
  sphere of exactly one codeword.  A segment's keys are the codewords nearest
  to it and to its one-bit neighbours; of two segments that differ in one bit
  each has the other's codeword among its keys;
* rows that share (segment number, clean segment, codeword) are compared
  exactly.

Equal fingerprints are one row from the start.  Groups of fingerprints that
share a key are never expanded into pairs: see ``link_keys``.

Defined cases: null or wordless text has fingerprint zero and links like any
other; fewer words than the shingle length make one shingle; repeated rows and
ids are kept as rows, with the component of their fingerprint; an empty table
gives an empty result.  Null doc_ids are carried but never name a component,
unless all of it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.llm import common
from regimen.llm.components import connect

#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
SEED = 42


def shingle_bits(hashes: list[int], counts: np.ndarray) -> None:
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts += bits.sum(axis=0, dtype=np.int64)


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of one text (UTF-8), most significant bit first."""
    counts, total, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in common.pieces(raw, PIECE):
        words = carry + part.lower().split()
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            stop = ends[width - 1:].tolist()
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:len(stop)].tolist(), stop)]
            shingle_bits(hashes, counts)
            total += len(hashes)
        carry = words[-(width - 1):] if width > 1 else []
    if not total:
        if not carry:
            return 0
        shingle_bits([digest(b" ".join(carry), SEED)], counts)
        total = 1
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of every row."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("fp", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code.
GOLAY_POLY = 0b101011100011


def golay_remainder(words: np.ndarray) -> np.ndarray:
    """Remainder (11 bits) of 23-bit polynomials by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY_POLY << (bit - 11), 0)
    return rest


@lru_cache(1)
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment: the index (first 12 bits) of its nearest codeword,
    and its keys, padded by repeating the first: indices nearest to it and to its one-bit neighbours."""
    errors = [0] + [1 << i for i in range(23)]
    errors += [a | b for k, a in enumerate(errors[1:]) for b in errors[k + 2:]]
    errors = sorted({a | b for a in errors for b in errors if bin(a | b).count("1") <= 3})
    leader = np.zeros(2048, np.int64)  # the code is perfect: each remainder has one error of weight <= 3
    leader[golay_remainder(np.array(errors))] = errors
    segment = np.arange(1 << 16)
    nearest = (segment ^ leader[golay_remainder(segment)]) >> 11
    flips = np.stack([nearest] + [nearest[segment ^ (1 << i)] for i in range(16)], axis=1)
    rest = np.sort(flips[:, 1:], axis=1)
    repeated = np.concatenate([np.zeros((1 << 16, 1), bool), rest[:, 1:] == rest[:, :-1]], axis=1)
    rest = np.where(repeated | (rest == nearest[:, None]), -1, rest)
    rest = -np.sort(-rest, axis=1)
    most = int((rest >= 0).sum(axis=1).max())
    return nearest, np.where(rest[:, :most] < 0, nearest[:, None], rest[:, :most])


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, primary) for fingerprints: key names segment number, clean segment and codeword."""
    nearest, others = golay_keys()
    row, key, primary = [], [], []
    for a in range(4):
        clean = (fps >> np.uint64(48 - 16 * a) & np.uint64(0xFFFF)).astype(np.int64)
        near = (fps >> np.uint64(48 - 16 * ((a + 1) % 4)) & np.uint64(0xFFFF)).astype(np.int64)
        head = (a << 28) | (clean << 12)
        row.append(np.arange(len(fps)))
        key.append(head | nearest[near])
        primary.append(np.ones(len(fps), bool))
        more = others[near]
        r, c = np.nonzero(more != nearest[near][:, None])
        row.append(r)
        key.append(head[r] | more[r, c])
        primary.append(np.zeros(len(r), bool))
    return np.concatenate(row), np.concatenate(key), np.concatenate(primary)


#: Rows that may share a key before it is split by further exact bits.
BUCKET = 1024


def refine(key: np.ndarray, free: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split keys by pigeonhole over their free bits: of four blocks, one has no error.

    Returns (row, key, free); a block's bits are free no longer."""
    rows, keys, frees = [], [], []
    for value in np.unique(free):
        at = np.flatnonzero(free == value)
        bits = [b for b in range(64) if int(value) >> b & 1]
        for block in range(4):
            chosen = np.uint64(sum(1 << b for b in bits[block::4]))
            rows.append(at)
            k = key[at].view(np.uint64) * np.uint64(4) + np.uint64(block)
            keys.append(common.mix64(common.mix64(k) ^ (fps[at] & chosen)).view(np.int64))
            frees.append(np.full(len(at), value & ~chosen, np.uint64))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(frees)


KEY_SCHEMA = "key long, free long, fp long, primary boolean"


def spanning_links(key: np.ndarray, fps: np.ndarray, primary: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each run of equal keys, whatever its pairs connect.

    Compares rows that are 1, 2, ... places apart, so memory stays linear, and
    keeps the smallest label seen; pairs that are connected already add nothing."""
    label = np.arange(len(key))
    out = []
    lag, at = 1, np.flatnonzero(key[:-1] == key[1:])
    while len(at):
        close = np.bitwise_count(fps[at] ^ fps[at + lag]) <= max_bits
        close &= primary[at] | primary[at + lag]
        a, b = at[close], at[close] + lag
        while True:  # merge this lag's links into the forest
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                break
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            first, where = np.unique(high, return_index=True)
            out.append((high[where], low[where]))
            label[first] = low[where]
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def refine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        row, key, free = refine(batch.column("key").to_numpy(), batch.column("free").to_numpy().view(np.uint64), fps)
        yield pa.record_batch([pa.array(key), pa.array(free.view(np.int64)), pa.array(fps[row].view(np.int64)),
                               pa.array(np.ones(len(row), bool))], names=["key", "free", "fp", "primary"])


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 4096):
            fps = batch.column("fp").slice(part, 4096).to_numpy().view(np.uint64)
            row, key, primary = fuzzy_keys(fps)
            clean = np.uint64(0xFFFF) << (np.uint64(48) - np.uint64(16) * (key >> 28).astype(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array((~clean).view(np.int64)), pa.array(fps[row].view(np.int64)),
                                   pa.array(primary)], names=["key", "free", "fp", "primary"])


def link_keys(keys: DataFrame, max_bits: int, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between the fingerprints of ``keys`` (KEY_SCHEMA) that connect all that their pairs connect.

    A key with more than ``bucket`` rows is split by further exact bits until it
    has fewer, or so few free bits that distinct fingerprints cannot be more;
    so no task compares a large group, and no pair is skipped."""
    pending, ready = keys, None
    for _ in range(8):
        pending = common.write_shared(pending)
        sizes = pending.groupBy("key").agg(F.count("*").alias("n"), F.max("primary").alias("any"))
        large = sizes.where(F.col("n") > bucket).select("key")
        none_large = large.isEmpty()
        fit = sizes.where((F.col("n") > 1) & (F.col("n") <= bucket) & F.col("any")).select("key")
        part = pending.join(fit, "key")
        ready = part if ready is None else ready.union(part)
        if none_large:
            break
        pending = pending.join(large, "key").mapInArrow(refine_batches, KEY_SCHEMA)
    ordered = ready.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            key, fps, primary = rest if rest is not None else (np.zeros(0, np.int64),) * 3
            if batch is not None:
                new = (batch.column("key").to_numpy(), batch.column("fp").to_numpy(),
                       batch.column("primary").to_numpy(zero_copy_only=False))
                key, fps, primary = (np.concatenate([x, y.astype(x.dtype) if len(x) else y])
                                     for x, y in zip((key, fps, primary), new))
                if not len(key):
                    continue
                whole = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on
            else:
                whole = len(key)
            rest = key[whole:], fps[whole:], primary[whole:]
            if whole:
                f = fps[:whole].astype(np.int64).view(np.uint64)
                u, v = spanning_links(key[:whole], f, primary[:whole].astype(bool), max_bits)
                yield pa.record_batch([pa.array(f[u].view(np.int64)), pa.array(f[v].view(np.int64))], names=["u", "v"])

    return ordered.mapInArrow(run, "u long, v long").where("u != v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): the component of each row's fingerprint, named by its smallest id."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the key scheme finds links of at most 3 bits")
    rows = common.write_shared(fingerprints(docs, id_col, text_col, width))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    keys = classes.select("fp").mapInArrow(key_batches, KEY_SCHEMA)
    roots = connect(link_keys(keys, max_bits)).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = common.write_shared(named)
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = named.join(names, "root").select("fp", "component_id")
    return rows.join(members, "fp").select("doc_id", "fp", "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
