"""Variable-order byte statistics, counted on Spark and frozen into tables (used by operators 1 and 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import common

#: What stands before the first byte of a text.
PAD = 0x20
#: Orders up to this one are held as trees.
HELD = 1
#: Grams, and values of them, that tasks hold at most; the others are joined.
CACHED, CACHED_VALUES = 1 << 18, 1 << 24
#: Parts of a value that sums over joined grams count.
UNIT = 1 << 24
#: No gram.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def lower_table() -> np.ndarray:
    b = np.arange(256, dtype=np.uint8)
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)


def grams(data: np.ndarray, offs: np.ndarray, i: int, j: int, lo: int, hi: int, order: int, low: np.ndarray) -> np.ndarray:
    """For each byte in [lo, hi) of rows i to j, itself and the ``order`` bytes before it as one number,
    the byte itself lowest; rows begin after PAD bytes."""
    n = hi - lo
    out = low[data[lo:hi]].astype(np.uint64)
    starts = offs[i:j] - lo
    starts = starts[(starts > -order) & (starts < n)]
    for k in range(1, order + 1):
        before = np.full(n, PAD, np.uint64)
        have = min(k, lo)
        before[k - have:] = low[data[lo - have:hi - k]] if hi > k else PAD
        for d in range(k):
            at = starts + d
            before[at[(at >= 0) & (at < n)]] = PAD
        out |= before << np.uint64(8 * k)
    return out


def cut_anywhere(data: np.ndarray, stop: int, end: int) -> int:
    return stop


def count_grams(rows: DataFrame, order: int, classes: list) -> DataFrame:
    """(cls, gram, n) over every byte of ``rows`` (cls, text): all grams of each class.

    Tasks count their own grams first, so the shuffle holds distinct grams."""
    code = {c: k for k, c in enumerate(classes)}
    shift = np.uint64(8 * (order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, held, size = lower_table(), [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip(*held))
            at = np.argsort(key, kind="stable")
            key, n = key[at], n[at]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[first], np.add.reduceat(n, first)

        for batch in batches:
            cls = np.array([code.get(c, -1) for c in batch.column(0).to_pylist()])
            data, offs = common.text_buffers(batch.column(1))
            for i, j, lo, hi in common.segments(data, offs, common.TILE, cut_anywhere):
                g = grams(data, offs, i, j, lo, hi, order, low)
                own = np.repeat(cls[i:j], np.diff(np.clip(offs[i:j + 1], lo, hi)))
                g = np.sort((g | own.astype(np.uint64) << shift)[own >= 0])
                if len(g):
                    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                    held.append((g[first], np.diff(np.append(first, len(g)))))
                    size += len(first)
                if size > 2_000_000:
                    held = [merge()]
                    size = len(held[0][0])
                    if size > 1_000_000:  # mostly distinct: hand on what there is
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*merge())

    def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array((key >> shift).astype(np.int32)),
                                pa.array((key & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)),
                                pa.array(n.astype(np.int64))], names=["cls", "gram", "n"])

    return rows.mapInArrow(run, "cls int, gram long, n long").groupBy("cls", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """One class's contexts of 0 to ``order`` bytes with the symbols seen after them.

    All orders derive from the counts of the longest grams.  For a context of
    order d: ``total`` and ``kinds`` are its symbols and distinct symbols;
    ``rest`` and ``rest_kinds`` are those of its shorter context without the
    symbols that it has itself (exclusion after an escape)."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        self.symbols, self.contexts = [], []
        for d in range(order + 1):
            key = gram & np.uint64((1 << 8 * (d + 1)) - 1)
            key, at = np.unique(key, return_inverse=True)
            count = np.bincount(at, n, len(key)).astype(np.float64)
            context = key >> np.uint64(8)
            own, where = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(where, count, len(own)), np.bincount(where, minlength=len(own)).astype(float)
            rest, rest_kinds = total, kinds
            if d:
                shorter_key, shorter_n = self.symbols[-1]
                in_shorter = shorter_n[np.searchsorted(shorter_key, key & np.uint64((1 << 8 * d) - 1))]
                parents, _, p_total, p_kinds, _, _ = self.contexts[-1]
                p = np.searchsorted(parents, own & np.uint64((1 << 8 * (d - 1)) - 1))
                rest = p_total[p] - np.bincount(where, in_shorter, len(own))
                rest_kinds = p_kinds[p] - kinds
            self.symbols.append((key, count))
            self.contexts.append((own, where, total, kinds, rest, rest_kinds))

    def longer(self, symbols: list, contexts: list) -> Tree:
        """This tree with the given longer orders."""
        out = object.__new__(Tree)
        out.order, out.symbols, out.contexts = self.order + len(symbols), self.symbols + symbols, self.contexts + contexts
        return out

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """Exact bits of each gram's last byte after its context: prediction by partial matching with escape
        probability kinds / (total + kinds) and exclusion."""
        bits = np.zeros(len(gram))
        live = np.arange(len(gram))
        came = np.full(len(gram), -1)  # index of the longer context escaped from
        for d in range(self.order, -1, -1):
            g = gram[live]
            own, _, total, kinds, _, _ = self.contexts[d]
            context = (g >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
            c, known = find(own, context)
            t, q = np.where(known, total[c], 0), np.where(known, kinds[c], 0)
            if d < self.order:
                escaped = came[live] >= 0
                longer = self.contexts[d + 1]
                at = np.maximum(came[live], 0)
                t, q = np.where(escaped, longer[4][at], t), np.where(escaped, longer[5][at], q)
            key, n = self.symbols[d]
            s, seen = find(key, g & np.uint64((1 << 8 * (d + 1)) - 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                bits[live] += np.where(seen, np.log2((t + q) / n[s]), np.where(q > 0, np.log2((t + q) / q), 0))
            came[live] = np.where(known, c, -1)
            live = live[~seen]
            if not len(live):
                return bits
        bits[live] += np.log2(max(1.0, 256 - self.contexts[0][3][0]))
        return bits

    def log_likelihoods(self, gram: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's last byte: orders interpolated with weight total / (total + kinds)."""
        p = np.full(len(gram), 1 / 256)
        for d in range(self.order + 1):
            own, _, total, kinds, _, _ = self.contexts[d]
            c, known = find(own, (gram >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1))
            key, n = self.symbols[d]
            s, seen = find(key, gram & np.uint64((1 << 8 * (d + 1)) - 1))
            p = np.where(known, (np.where(seen, n[s], 0) + kinds[c] * p) / np.maximum(total[c] + kinds[c], 1), p)
        return np.log2(p)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Cache:
    """Values (grams, classes) of some grams, found by open addressing; others count as 0."""

    def __init__(self, gram: np.ndarray, known: np.ndarray):
        self.known = np.vstack([known, np.zeros((1, known.shape[1]))]).astype(np.float32)  # the last row: not found
        self.bits = max(4, int(2 * len(gram)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        live, at = np.arange(len(gram)), self.slot(gram)
        while len(live):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = live[free][::-1]
            left = self.slots[at] != live
            live, at = live[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.keys = np.append(gram, NONE)[self.slots]

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Row of each gram, or -1."""
        at = self.slot(gram)
        key = self.keys[at]
        index = self.slots[at]
        odd = np.flatnonzero(key != gram)
        where = at[odd]
        while len(odd):
            on = self.slots[where] >= 0  # an empty slot ends the search
            index[odd[~on]] = -1
            odd, where = odd[on], (where[on] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[where] == gram[odd]
            index[odd[hit]] = self.slots[where[hit]]
            odd, where = odd[~hit], where[~hit]
        return index

    def values(self, gram: np.ndarray, index: np.ndarray) -> np.ndarray:
        return self.known[index]


class GramTable(Cache):
    """Values of every gram that some class has seen; others are worked out by the trees."""

    def __init__(self, trees: list[Tree], value: str):
        self.trees, self.value = trees, value
        gram = np.unique(np.concatenate([t.symbols[t.order][0] for t in trees]))
        super().__init__(gram, self.compute(gram))

    def compute(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([getattr(t, self.value)(gram) for t in self.trees], axis=1)

    def values(self, gram: np.ndarray, index: np.ndarray) -> np.ndarray:
        out = self.known[index]
        new = np.flatnonzero(index < 0)
        if len(new):
            distinct, back = np.unique(gram[new], return_inverse=True)
            out[new] = self.compute(distinct)[back]
        return out


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (bytes, classes) by rows with the given boundaries."""
    sums = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, dtype=np.float64, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def tile_sums(table: Cache, col: pa.Array, order: int, low: np.ndarray) -> Iterator[tuple]:
    """(first row, end row, their sums of each class's value over some bytes, and the rows and grams of the
    bytes that the table does not know)."""
    data, offs = common.text_buffers(col)
    limit = max(1 << 10, common.TILE // 4 * 64 // max(64, table.known.shape[1]))  # bounds (bytes, classes)
    for i, j, lo, hi in common.segments(data, offs, min(limit, common.TILE // 4), cut_anywhere):
        g = grams(data, offs, i, j, lo, hi, order, low)
        index = table.find(g)
        bounds = np.clip(offs[i:j + 1], lo, hi) - lo
        new = np.flatnonzero(index < 0)
        yield i, j, row_sums(table.values(g, index), bounds), i + np.searchsorted(bounds, new, side="right") - 1, g[new]


def text_sums(table: Cache, col: pa.Array, order: int, low: np.ndarray) -> np.ndarray:
    """Per row, the sum over all its bytes of each class's value."""
    out = np.zeros((len(col), table.known.shape[1]))
    for i, j, part, _, _ in tile_sums(table, col, order, low):
        out[i:j] += part
    return out


def mask(d: int) -> int:
    """The bytes of a gram of order ``d``."""
    return (1 << 8 * (d + 1)) - 1


def of_class(lists: pa.Array, key: np.ndarray, classes: int) -> list[list[np.ndarray]]:
    """For each class its distinct keys in order, with the fields that stand beside the class in each row's list of
    structs; the last is NONE, with 1 in every field."""
    cls, *fields = (x.to_numpy(zero_copy_only=False) for x in pc.list_flatten(lists).flatten())
    key = key[pc.list_parent_indices(lists).to_numpy().astype(np.int64)]
    at = np.lexsort((key, cls))
    cls, key = cls[at], key[at]
    new = np.ones(len(at), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (key[1:] != key[:-1])
    cls, key, fields = cls[new], key[new], [f[at][new].astype(np.float64) for f in fields]
    cut = np.searchsorted(cls, np.arange(classes + 1))
    return [[np.append(key[a:b], NONE), *(np.append(f[a:b], 1.0) for f in fields)] for a, b in zip(cut, cut[1:])]


class Model:
    """The context trees of some classes over all their grams.

    A model of no more rows (class, gram) than a task holds is held whole: the tasks get its trees, and no table is joined.
    Of a larger one, orders 0 and 1 (at most 256 + 65,536 grams a class) are held as trees; the symbols and contexts of longer orders
    are tables in the shared folder, however many there are.  Values of the most frequent grams, ``CACHED`` at most,
    go to the tasks; bytes with any other gram are joined with the tables, so sums cover every gram exactly."""

    def __init__(self, counts: DataFrame, classes: int, order: int, value: str):
        self.classes, self.order, self.value = classes, order, value
        counts = common.write_shared(counts)
        self.whole = counts.count() <= min(CACHED, CACHED_VALUES // classes)
        if self.whole:
            self.trees = self.held_trees(counts, order)
            gram = np.unique(np.concatenate([t.symbols[order][0] for t in self.trees]))
            self.cache = Cache(gram, GramTable(self.trees, value).compute(gram))
            return
        symbols = {order: counts.withColumnRenamed("gram", "key")}
        for d in range(order - 1, 0, -1):
            shorter = symbols[d + 1].groupBy("cls", F.expr(f"key & {mask(d)}").alias("key")).agg(F.sum("n").alias("n"))
            symbols[d] = common.write_shared(shorter)
        held = min(HELD, order)
        self.trees = self.held_trees(symbols[held].withColumnRenamed("key", "gram"), held)  # at most 256^2 rows a class
        self.tables = [self.nodes(symbols[d], symbols[d - 1], d) for d in range(held + 1, order + 1)]
        self.cache = self.most_frequent(counts)

    def held_trees(self, counts: DataFrame, order: int) -> list[Tree]:
        found = counts.toArrow()
        cls, gram, n = (found[c].to_numpy() for c in ("cls", "gram", "n"))
        return [Tree(gram[cls == c].astype(np.uint64), n[cls == c], order) for c in range(self.classes)]

    @staticmethod
    def nodes(own: DataFrame, shorter: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
        """Tables of order ``d``: (key, s: cls and n of each class) and (ctx, x: cls and its Tree values of each)."""
        s = own.groupBy("key").agg(F.collect_list(F.struct("cls", "n")).alias("s"))
        within = shorter.select("cls", F.col("key").alias("short"), F.col("n").alias("in_shorter"))
        contexts = (own.withColumn("short", F.expr(f"key & {mask(d - 1)}")).join(within, ["cls", "short"])
                    .groupBy("cls", F.expr("shiftright(key, 8)").alias("ctx"))
                    .agg(F.sum("n").alias("total"), F.count("n").alias("kinds"), F.sum("in_shorter").alias("out")))
        parents = (shorter.groupBy("cls", F.expr("shiftright(key, 8)").alias("parent"))
                   .agg(F.sum("n").alias("p_total"), F.count("n").alias("p_kinds")))
        x = (contexts.withColumn("parent", F.expr(f"ctx & {mask(d - 2)}")).join(parents, ["cls", "parent"])
             .groupBy("ctx").agg(F.collect_list(F.struct("cls", "total", "kinds", F.expr("p_total - out as rest"),
                                                         F.expr("p_kinds - kinds as rest_kinds"))).alias("x")))
        return common.write_shared(s), common.write_shared(x)

    def most_frequent(self, counts: DataFrame) -> Cache:
        """Grams seen at least 2^k times, for the least k by which they fit."""
        most = min(CACHED, CACHED_VALUES // self.classes)
        every = counts.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("k", F.floor(F.log2("n")))
        least, room = 64, most
        for k, n in sorted(((r["k"], r["count"]) for r in every.groupBy("k").count().collect()), reverse=True):
            if n > room:
                break
            least, room = k, room - n
        found = self.values_of(every.where(F.col("k") >= least).select("gram")).toArrow().combine_chunks()
        gram = found["gram"].to_numpy().astype(np.uint64)
        known = pc.list_flatten(found["v"]).to_numpy().reshape(len(gram), self.classes)
        at = np.argsort(gram)
        return Cache(gram[at], known[at])

    def values_of(self, rows: DataFrame) -> DataFrame:
        """(gram, v: the classes' values) of distinct grams, whether some class has seen them or not."""
        held, trees, value, classes = self.trees[0].order, self.trees, self.value, self.classes
        for d, (symbols, contexts) in enumerate(self.tables, held + 1):
            rows = rows.withColumn("key", F.expr(f"gram & {mask(d)}")).withColumn("ctx", F.expr("shiftright(key, 8)"))
            rows = (rows.join(symbols.withColumnRenamed("s", f"s{d}"), "key", "left")
                    .join(contexts.withColumnRenamed("x", f"x{d}"), "ctx", "left").drop("key", "ctx"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gram = batch.column(0).to_numpy().astype(np.uint64)
                symbols, contexts = [], []
                for k, d in enumerate(range(held + 1, held + 1 + (batch.num_columns - 1) // 2)):
                    key = gram & np.uint64(mask(d))
                    symbols.append(of_class(batch.column(1 + 2 * k), key, classes))
                    contexts.append(of_class(batch.column(2 + 2 * k), key >> np.uint64(8), classes))
                out = np.empty((len(gram), classes), np.float32)
                for c, tree in enumerate(trees):
                    whole = tree.longer([tuple(s[c]) for s in symbols], [(x[c][0], None, *x[c][1:]) for x in contexts])
                    out[:, c] = getattr(whole, value)(gram)
                yield pa.record_batch([batch.column(0), lists_of(out)], names=["gram", "v"])

        return rows.mapInArrow(run, "gram long, v array<float>")

    def sums(self, rows: DataFrame, text_col: str) -> DataFrame:
        """All columns but the text, ``sums_`` (each class's value summed over all bytes) and ``bytes_``."""
        keep = [c for c in rows.columns if c != text_col]
        if self.whole:
            return self.held_sums(rows.select(*keep, text_col))
        source = rows.select(*keep, F.monotonically_increasing_id().alias("row_"), text_col)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in source.drop(text_col).schema.fields])
        schema.add("sums_", T.ArrayType(T.DoubleType())).add("bytes_", "long").add("gram_", "long").add("times_", "long")
        names, cache, order, width = schema.names, self.cache, self.order, len(keep) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = lower_table()
            for batch in batches:
                own, texts, n = batch.columns[:width], batch.column(width), batch.num_rows
                sums = np.zeros((n, cache.known.shape[1]))
                for i, j, part, row, gram in tile_sums(cache, texts, order, low):
                    sums[i:j] += part
                    if len(row):
                        at = np.lexsort((gram, row))
                        row, gram = row[at], gram[at]
                        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])))
                        m = len(first)
                        yield pa.record_batch(
                            [*(pa.nulls(m, c.type) for c in own[:-1]), own[-1].take(pa.array(row[first])),
                             pa.nulls(m, pa.list_(pa.float64())), pa.nulls(m, pa.int64()),
                             pa.array(gram[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(row))))],
                            names=names)
                yield pa.record_batch([*own, lists_of(sums), pa.array(np.diff(common.text_buffers(texts)[1])),
                                       pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)

        found = common.write_shared(source.mapInArrow(run, schema))
        other = found.where("gram_ is not null").select("row_", F.col("gram_").alias("gram"), "times_")
        # whole numbers add up the same in any order
        each = (other.join(self.values_of(other.select("gram").distinct()), "gram")
                .select("row_", "times_", F.posexplode("v").alias("c", "v"))
                .groupBy("row_", "c").agg(F.sum(F.expr(f"cast(round(v * {UNIT}) as bigint) * times_")).alias("s")))
        more = each.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("more_"))
        added = F.expr(f"if(more_ is null, sums_, zip_with(sums_, more_, (a, b) -> a + b.s / {UNIT}))")
        return (found.where("gram_ is null").join(more, "row_", "left")
                .select(*keep, added.alias("sums_"), "bytes_"))

    def held_sums(self, source: DataFrame) -> DataFrame:
        """``sums`` of a model that is held whole, equal to those over joined tables; the text is the last column."""
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in source.schema.fields[:-1]])
        schema.add("sums_", T.ArrayType(T.DoubleType())).add("bytes_", "long")
        names, cache, order, trees, value = schema.names, self.cache, self.order, self.trees, self.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = lower_table()
            for batch in batches:
                *own, texts = batch.columns
                sums = np.zeros((batch.num_rows, len(trees)))
                more = np.zeros(sums.shape, np.int64)
                for i, j, part, row, gram in tile_sums(cache, texts, order, low):
                    sums[i:j] += part
                    if len(row):
                        gram, back = np.unique(gram, return_inverse=True)
                        v = np.stack([getattr(t, value)(gram) for t in trees], axis=1).astype(np.float32).astype(float) * UNIT
                        np.add.at(more, row, (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)[back])
                sums += more / UNIT
                yield pa.record_batch([*own, lists_of(sums), pa.array(np.diff(common.text_buffers(texts)[1]))], names=names)

        return source.mapInArrow(run, schema)


def lists_of(values: np.ndarray) -> pa.Array:
    """One list for each row."""
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
