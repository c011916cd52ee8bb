"""Helpers shared by the corpus operators: Arrow text access, row hashing, shared tables."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.session import checkpoint_dir

#: Bytes of text handled by one vectorised step; bounds task memory for any text length.
TILE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named input table, reduced to ``cols`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def write_shared(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts lineage and survives lost executors; later passes read the table."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/regimen-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(docs: DataFrame, text_col: str, find: Callable[[DataFrame], DataFrame], outputs: dict[str, str],
           keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) and the columns that ``find`` adds.

    ``find`` gets the columns ``row`` (all other columns, packed) and ``text`` only, so no name in ``docs`` can clash
    with its own; ``outputs`` says what its columns are called in the result.  A column of ``docs`` that has
    the name of an output gives way to it, as with ``withColumn``."""
    taken = {o.lower() for o in outputs.values()}
    kept = [c for c in docs.columns if c.lower() not in taken and (keep_text or c != text_col)]
    packed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept) if c != text_col]
    found = find(docs.select(F.struct(F.lit(0).alias("c"), *packed).alias("row"), F.col(f"`{text_col}`").alias("text")))
    back = [(F.col("text") if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(kept)]
    return found.select(*back, *[F.col(c).alias(name) for c, name in outputs.items()])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null row has length 0."""
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:  # null slots may keep bytes: give them length 0 without moving data
        length = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(o))
        if (length != np.diff(o)).any():
            keep = np.repeat(length > 0, np.diff(o))
            d, o = d[o[0]:o[-1]][keep], np.concatenate([[0], np.cumsum(length)])
    return d, o


def segments(data: np.ndarray, offs: np.ndarray, limit: int,
             cut: Callable[[np.ndarray, int, int], int]) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte): runs of whole rows of at most
    ``limit`` bytes, or parts of one longer row that end where ``cut(data, stop, end)`` says."""
    i, n = 0, len(offs) - 1
    while i < n:
        if offs[i + 1] - offs[i] > limit:
            pos, end = int(offs[i]), int(offs[i + 1])
            while pos < end:
                stop = min(pos + limit, end)
                stop = cut(data, stop, end) if stop < end else end
                yield i, i + 1, pos, stop
                pos = stop
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            yield i, j, int(offs[i]), int(offs[j])
            i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BASE = 0x2545F4914F6CDD1D  # odd: has an inverse modulo 2^64


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    step, have = np.array([base], np.uint64), 1
    while have < n:
        take = min(have, n - have)
        out[have:have + take] = out[:take] * step
        step, have = step * step, have + take
    return out


class Rolling:
    """Polynomial hashes modulo 2^64 of any substrings of one byte array."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = byte_values() if table is None else table
        self.up, self.down = powers(BASE, TILE + 1), powers(pow(BASE, -1, 1 << 64), TILE + 1)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = powers(BASE, 2 * n), powers(pow(BASE, -1, 1 << 64), 2 * n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=self.sums[1:])

    def fixed(self, k: int) -> np.ndarray:
        """Hash of every substring of length ``k``, by its start."""
        n = len(self.sums) - 1
        return mix64((self.sums[k:] - self.sums[:n + 1 - k]) * self.down[:n + 1 - k])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes [start, end), length included."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_values() -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every full window, by doubling."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while 2 * have <= w:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    if have < w:
        out = np.minimum(out[:len(x) - w + 1], out[w - have:])
    return out


SPACE = re.compile(rb"[\x20\x09-\x0d]")


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` bytes, cut after ASCII white space."""
    pos = 0
    while len(raw) - pos > size:
        hit = SPACE.search(raw, pos + size)
        if hit is None:
            break
        yield raw[pos:hit.end()]
        pos = hit.end()
    yield raw[pos:]


def worker_object(key: tuple, make: Callable):
    """An object that a Python worker makes once and keeps over its tasks (a cache, never state that results need)."""
    kept = sys.modules.setdefault("regimen_worker_objects", types.ModuleType("regimen_worker_objects")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
