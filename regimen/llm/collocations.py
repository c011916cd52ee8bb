"""Operator 12: phrase collocations by top-order marginalisation.

Texts (A-Z lower-cased) are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at spaces and tabs.
Every word position starts one window: the word and up to three that follow it in its piece, in lead
columns w1..w4 padded with null.  Only these longest windows are counted; a Spark ROLLUP over
(lang, w1, w2, w3, w4) then sums them over successively shorter prefixes, which gives the counts of all
phrases of 1 to 4 words and each language's number of words at once.

1. A phrase of ``least`` occurrences holds only phrases that occur as often (within its language), so windows end
   early, without a loss, before a word that would make a rarer phrase.  Grams of 1 to 4 words, each length
   among those whose parts are frequent, are counted by 40-bit hash, and the frequent ones set bits in a bitmap of fixed size.  Grams that share a hash or a bit
   only let a longer window through.  Tasks send their sorted hashes as compressed differences, one blob for
   each range of hashes, about three bytes a gram; a range's blobs are added up together.
2. Tasks count equal windows of whole runs of text before Spark does, and each task takes ``SPLITS`` input splits, so
   that more of the equal windows meet before the shuffle.
3. Phrases' counts of at least ``least`` form a table; cuts, scores and containment are joins with it.

Defined cases: null or empty text has no words; null lang is ``und``, together with rows that say ``und``; repeated
rows count again; ties of score and occurrences are broken by the phrase's UTF-8 bytes; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regimen.llm import common
from regimen.llm.decontaminate import Words, has

LEAST, TOP, SHARE = 30, 2000, 80
ORDER = 4
#: log2 of the bits of the bitmap of frequent grams (4 MB).
BITMAP_LOG2 = 25
#: Grams that a task sorts at a time, and bytes of text whose windows it counts together.
GRAMS = 1 << 21
RUN_BYTES = 3 << 20
HASH_BITS = 40
#: Input splits of a task that counts windows.
SPLITS = 4
WORDS = [f"w{i + 1}" for i in range(ORDER)]


class Pieces(Words):
    """Words of pieces; ``linked`` tells whether the next word follows in the same piece."""

    def __init__(self):
        super().__init__()
        self.gap = np.isin(np.arange(256), [0x20, 0x09])
        self.end = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
        self.word = ~self.gap & ~self.end

    def runs(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, word starts, word ends, hashes, row of each word, does the next word follow it), a tile at a time.

        Parts of a row longer than a tile end between pieces where they can, else between words; then
        the last words of a part are told again with the next (row -1), so that no window is lost."""
        data, offs = common.text_buffers(col)
        carry = 0  # bytes before the tile that a long row's last part left open
        for i, j, lo, hi in common.segments(data, offs, common.TILE, self.cut):
            again = carry if lo > offs[i] else 0
            part = data[lo - again:hi]
            hashes, bounds = self.tile(part, np.maximum(offs[i:j + 1] - (lo - again), 0))
            start, end = self.last
            row = np.searchsorted(offs[i:j + 1] - (lo - again), start, side="right") - 1 + i
            ends = np.cumsum(self.end[part])
            piece = ends[start] if len(start) else start
            linked = np.zeros(len(start), bool)
            linked[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
            carry = 0
            if j == i + 1 and hi < offs[j] and len(start):  # the row goes on: leave its last piece's last words open
                open_words = int(np.searchsorted(piece, piece[-1]))
                keep = max(open_words, len(start) - (ORDER - 1))
                if ends[-1] == piece[-1]:
                    carry = int(len(part) - start[keep])
                    own = np.arange(len(start)) < keep
                else:
                    own = np.ones(len(start), bool)
            else:
                own = np.ones(len(start), bool)
            yield part, start, end, hashes, np.where(own, row, -1), linked


def language_keys(col: pa.Array) -> np.ndarray:
    """A 64-bit value of each row's language."""
    found = col.dictionary_encode()
    values = np.array([xxhash.xxh64_intdigest(str(v)) for v in found.dictionary.to_pylist()], np.uint64)
    at = found.indices.to_numpy(zero_copy_only=False)
    return values[at] if len(values) else np.zeros(len(col), np.uint64)


def chain(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """A hash of (what ``first`` is a hash of, then ``then``)."""
    return common.mix64(first * np.uint64(common.BASE) + then)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by] at i; 0 (or False) beyond the end."""
    out = np.zeros_like(x)
    out[:max(0, len(x) - by)] = x[by:]
    return out


def grams_of(tile: tuple, lang: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of (language, 1 to ``size`` words from here on), and whether the piece has so many, for each word."""
    _, _, _, words, _, linked = tile
    code, real = [chain(lang, words)], [np.ones(len(words), bool)]
    for k in range(1, size):
        code.append(chain(code[-1], shifted(words, k)))
        real.append(real[-1] & shifted(linked, k - 1))
    return code, real


def source_rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as compressed byte planes of their differences."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def short(gram: np.ndarray) -> np.ndarray:
    return gram >> np.uint64(64 - HASH_BITS)


def frequent_grams(rows: DataFrame, least: int, sizes: list[int], bits: np.ndarray | None = None) -> DataFrame:
    """(gram): 40-bit hashes of the (language, words) of the given ``sizes`` that occur ``least`` times or more.

    Of ``bits`` (when given) both parts of a gram that are one word shorter must have theirs set.  A count above ``least``
    is sent as ``least``: that changes no sum's being that much."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    log2 = max(6, (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    borders = np.arange((1 << log2) + 1, dtype=np.uint64) << np.uint64(HASH_BITS - log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, many = Pieces(), [], 0

        def counted():
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(gram, borders)
            own = np.flatnonzero(np.diff(cut))
            n = np.minimum(n, least).astype("<u4")
            return pa.record_batch([
                pa.array(own, pa.int32()), pa.array([pack_sorted(gram[cut[r]:cut[r + 1]]) for r in own], pa.binary()),
                pa.array([zstandard.compress(n[cut[r]:cut[r + 1]].tobytes(), 1) for r in own], pa.binary())],
                names=["part", "grams", "n"])

        for batch in batches:
            keys = language_keys(batch.column(0))
            for tile in scan.runs(batch.column(1)):
                code, real = grams_of(tile, keys[np.maximum(tile[4], 0)], max(sizes))
                for k in sizes:
                    want = real[k - 1] & (tile[4] >= 0)
                    if bits is not None:
                        part = has(shared.value, short(code[k - 2]))
                        want &= part & shifted(part, 1)
                    held.append(short(code[k - 1][want]))
                    many += len(held[-1])
                if many >= GRAMS:
                    yield counted()
                    held, many = [], 0
        if many:
            yield counted()

    def add(part: pa.Table) -> pa.Table:
        gram = np.concatenate([unpack_sorted(x.as_py()) for x in part.column("grams")])
        n = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), "<u4") for x in part.column("n")])
        found, place = np.unique(gram, return_inverse=True)
        return pa.table({"gram": found[np.bincount(place, n) >= least].view(np.int64)})

    blobs = rows.mapInArrow(run, "part int, grams binary, n binary")
    return blobs.groupBy("part").applyInArrow(add, "gram long")


def bitmap(hashes: DataFrame, log2: int) -> np.ndarray:
    """A bitmap of 2^log2 bits with those of the one column's hashes set; at most 2^log2 / 32768 rows come to the driver."""
    bit = hashes.toDF("h").select(F.expr(f"pmod(h, {1 << log2})").alias("bit"))
    parts = bit.groupBy(F.expr("bit div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))
    bits = np.zeros((1 << log2) // 8, np.uint8)
    for r in parts.collect():
        bits[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def word_strings(part: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, real: np.ndarray) -> pa.Array:
    """Words number ``at`` as strings, null where not ``real``."""
    at = np.where(real, at, 0)
    size = np.where(real, end[at] - start[at], 0)
    offs = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(offs[-1]) + np.repeat(start[at] - offs[:-1], size)
    mask = pa.py_buffer(np.packbits(real, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offs.astype(np.int32).tobytes()),
                                       pa.py_buffer(part[take].tobytes()), mask)


class WindowCounts:
    """Equal windows of a run of text, counted."""

    def __init__(self):
        self.code, self.n, self.columns, self.head, self.bytes = [], [], [], [], 0

    def add(self, tile: tuple, lang: pa.Array, keys: np.ndarray, bits: np.ndarray, low: np.ndarray) -> None:
        part, start, end, words, row, _ = tile
        if not len(start):
            return
        grams, real = grams_of(tile, keys[np.maximum(row, 0)], ORDER)
        real = [has(bits, short(g)) & r for g, r in zip(grams, real)]
        for k in range(1, ORDER):
            real[k] &= real[k - 1]
        code = np.where(real[0], grams[0], keys[np.maximum(row, 0)])
        for k in range(1, ORDER):
            code = np.where(real[k], grams[k], code)
        own = np.flatnonzero(row >= 0)
        code, first, n = np.unique(code[own], return_index=True, return_counts=True)
        first = own[first]
        self.head.append(np.stack([g[first] for g in grams[:3]]))
        text = low[part]
        self.code.append(code)
        self.n.append(n)
        self.columns.append([lang.take(pa.array(row[first]))] + [
            word_strings(text, start, end, np.minimum(first + s, len(start) - 1), real[s][first]) for s in range(ORDER)])
        self.bytes += len(part)

    def batch(self) -> pa.RecordBatch:
        code, first, inverse = np.unique(np.concatenate(self.code), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate(self.n)).astype(np.int64)
        head = np.concatenate(self.head, axis=1)[:, first]
        order = np.lexsort(head[::-1])  # windows that begin alike stand together and compress well
        first, n = first[order], n[order]
        take = pa.array(first)
        columns = [pa.concat_arrays(list(c)).take(take) for c in zip(*self.columns)]
        return pa.record_batch([*columns, pa.array(n)], names=["lang", *WORDS, "n"])


def windows(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(lang, w1..w4, n): padded windows, counted per run of text."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, counts = Pieces(), WindowCounts()
        for batch in batches:
            lang, keys = batch.column(0), language_keys(batch.column(0))
            for tile in scan.runs(batch.column(1)):
                counts.add(tile, lang, keys, shared.value, scan.low)
                if counts.bytes >= RUN_BYTES:
                    yield counts.batch()
                    counts = WindowCounts()
        if counts.code:
            yield counts.batch()

    return rows.mapInArrow(run, f"lang string, {', '.join(w + ' string' for w in WORDS)}, n long")


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang",
                  bitmap_log2: int = BITMAP_LOG2) -> DataFrame:
    """(lang, words array, f): phrases of 1 to 4 words that occur ``least`` times or more, and each
    language's number of words (``words`` empty)."""
    rows = source_rows(docs, text_col, lang_col)
    bits = bitmap(frequent_grams(rows, least, [1, 2]), bitmap_log2)
    for size in range(3, ORDER + 1):
        bits |= bitmap(frequent_grams(rows, least, [size], bits), bitmap_log2)
    few = rows.coalesce(max(1, rows.rdd.getNumPartitions() // SPLITS))
    distinct = windows(few, bits).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    rolled = distinct.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    # a prefix of i words leaves the last 4 - i columns out; padding as the last column kept repeats a shorter prefix
    kept = F.lit(False)
    for i, w in enumerate(WORDS, 1):
        kept = kept | ((F.col("gid") == (1 << (ORDER - i)) - 1) & F.col(w).isNotNull() & (F.col("f") >= least))
    total = F.col("gid") == (1 << ORDER) - 1
    return rolled.where(total | kept).select("lang", F.array_compact(F.array(*WORDS)).alias("words"), "f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 4 words."""
    counts = common.write_shared(phrase_counts(docs, least, text_col, lang_col))
    phrases = counts.where(F.size("words") > 0).select("lang", "words", F.concat_ws(" ", "words").alias("phrase"), "f")
    totals = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    found = phrases.where(F.size("words") > 1)
    part = phrases.select("lang", "phrase", "f")

    def joined(first: str, size: str):
        return F.expr(f"concat_ws(' ', slice(words, {first}, {size}))")

    cuts = (found.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
            .select("lang", "phrase", F.col("f").alias("a"), "k", joined("1", "k").alias("head"),
                    joined("k + 1", "size(words) - k").alias("tail")))
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    score = F.expr("cast((2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r) as bigint)")
    scored = (cuts.groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")))
    inside = (found.where(F.size("words") > 2)
              .withColumn("size", F.explode(F.expr("sequence(2, size(words) - 1)")))
              .withColumn("at", F.explode(F.expr("sequence(1, size(words) - size + 1)")))
              .select("lang", joined("at", "size").alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = (scored.join(inside, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = (kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                              "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of ``documents``."""
    return collocations(common.table(spark, sf_dir, "documents", "text", "lang"))


ORACLE = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents where text is not null),
w as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as ws from p),
g as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from w, (select unnest([1, 2, 3, 4]) as k)),
f as (select lang, k, phrase, string_split(phrase, ' ') as ws, count(*) as f from g group by all having count(*) >= 30),
t as (select lang, sum(len(ws))::bigint as n from w group by all),
c as (select *, unnest(range(1, k)) as cut from f where k > 1),
s as (
  select c.lang, c.phrase, c.f as a, cut, l.f as l, r.f as r,
    ((2000000 * c.f::hugeint) // (l.f + r.f))::bigint as score
  from c join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:cut], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[cut + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
d as (
  select b.*, n, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank
  from b join t using (lang)
  where not exists (select 1 from f where f.lang = b.lang and f.k > len(string_split(b.phrase, ' '))
    and 100 * f.f >= 80 * b.a and (' ' || f.phrase || ' ') like '%' || replace(replace(replace(' ' || b.phrase || ' ', '\', '\\'), '%', '\%'), '_', '\_') || '%' escape '\'))
select lang, rank::bigint as rank, phrase, a, l, r, n, score from d where rank <= 2000
"""
