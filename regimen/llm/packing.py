"""Operator 10: best-fit packing of documents into token sequences by linear grouping.

A document's ids (a public tokenizer's, then an end id) are cut into pieces of
at most ``capacity`` tokens; only documents longer than that are cut.  Pieces
are packed whole:

1. count the pieces of every length: a table of at most ``capacity`` rows, whatever the corpus;
2. linear grouping: the large lengths (over capacity / 8), in descending order, form groups of equal
   numbers of pieces; every length is rounded up to its group's largest;
3. configurations of the few rounded sizes are optimised by a linear program with column generation
   (simplex; knapsack pricing), and its solution is rounded down;
4. actual pieces take the rounded slots and stay there; what they leave free is used by longer pieces in the
   last slots (see ``substitute``).  The few that rounding the solution down has left over, and then the small
   lengths, go best fit (descending) into the fullest sequence with room, or a new one.

Steps 2-4 work on counts of equal sequences, so their size does not grow with the number of documents.
The plan is a bounded table of (length, rank interval) -> (sequence, offset).  Pieces get their rank
among the pieces of their length by a window over (hash bucket, length) and bucket offsets, on Spark.

Tokenizing: see ``WordIds``; a Python worker keeps its memory of words from task to task.

Defined cases: null or empty text is one piece of the end id alone; equal rows are packed each on their
own; lengths that tie take ranks by hash and id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import common

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
GROUPS = 96
#: Tokens that a sequence of large pieces may leave free before a small piece is used to fill it exactly:
#: the plan is made with each of these, and the shortest is kept.
SPARES = (2, 5, 10, 30, CAPACITY)
#: Fragments that a worker remembers, else those that so many last tiles used; bytes of text in a tile;
#: the length from which the tokenizer library merges a fragment by itself.
KEEP, RECENT, BATCH, LONG = 400_000, 8, 1 << 20, 100
#: Hash buckets of the ranking.
BUCKETS = 512


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes are
    themselves, the others take the letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class PairMerges:
    """Byte-pair merges of many words at once.

    A word is a row of symbol ids; every round merges, in every row, its
    first pair of lowest rank, as the tokenizer does word by word."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        left, right, new = [], [], []
        for pair in model["merges"]:
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            left.append(self.vocab[x])
            right.append(self.vocab[y])
            new.append(self.vocab[x + y])
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = int(4 * len(key)).bit_length()
        self.keys = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.ranks = np.full(1 << self.bits, len(key), np.int32)
        self.new, self.none = np.array([*new, 0], np.int32), len(key)
        live, at = np.arange(len(key)), self.slot(key)
        while len(live):  # open addressing
            free = self.ranks[at] == self.none
            self.ranks[at[free][::-1]] = live[free][::-1]
            left_over = self.ranks[at] != live
            live, at = live[left_over], (at[left_over] + 1) & ((1 << self.bits) - 1)
        used = self.ranks < self.none
        self.keys[used] = key[self.ranks[used]]
        letters = byte_letters()
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([self.vocab[letters[b] + self.suffix] for b in range(256)], np.int32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self.slot(key)
        out = self.ranks[at].copy()
        odd = np.flatnonzero((self.keys[at] != key) & (out != self.none))
        where = at[odd]
        out[odd] = self.none
        while len(odd):
            where = (where + 1) & ((1 << self.bits) - 1)
            hit = self.keys[where] == key[odd]
            out[odd[hit]] = self.ranks[where[hit]]
            go_on = ~hit & (self.ranks[where] != self.none)
            odd, where = odd[go_on], where[go_on]
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids a word) of the words, in order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        begin, parts, count = 0, [np.zeros(0, np.int64)], np.zeros(len(words), np.int64)
        while begin < len(order):  # rows of like lengths, a bounded number of symbols at a time
            width = int(size[order[begin]])
            wide = width + max(2, width // 2)
            end = min(int(np.searchsorted(size[order], wide, side="right")), begin + max(1, 60_000 // wide))
            rows = order[begin:end]
            flat, count[rows] = self.merge([words[i] for i in rows], size[rows])
            parts.append(flat)
            begin = end
        flat = np.concatenate(parts)  # by order; back to the order given
        first = np.cumsum(count[order]) - count[order]
        at = np.empty(len(words), np.int64)
        at[order] = first
        return flat[expand(at, count)].astype(np.int64), count

    def merge(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(size.max())
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = np.zeros((n, width), np.int32)
        col = np.arange(width)
        ids[col < size[:, None]] = self.inner[data]
        ids[np.arange(n), size - 1] = self.final[np.array([w[-1] for w in words])]
        size, live = size.copy(), np.arange(n)
        rank = np.full((n, max(1, width - 1)), self.none, np.int32)
        if width > 1:
            pairs = col[:-1] < size[:, None] - 1
            rank[pairs] = self.rank(ids[:, :-1][pairs], ids[:, 1:][pairs])
        while width > 1 and len(live):
            best = rank[live].argmin(axis=1)
            low = rank[live, best]
            on = low < self.none
            live, best, low = live[on], best[on], low[on]
            if not len(live):
                break
            row = np.arange(len(live))
            part, own = ids[live], rank[live]
            after = col[None, :] > best[:, None]
            part = np.where(after, np.concatenate([part[:, 1:], part[:, -1:]], axis=1), part)
            part[row, best] = self.new[low]
            own = np.where(after[:, :-1], np.concatenate([own[:, 1:], np.full((len(live), 1), self.none, np.int32)], axis=1), own)
            size[live] -= 1
            for d in (-1, 0):  # the pairs that the new symbol is in
                at = best + d
                inside = (at >= 0) & (at + 1 < size[live])
                own[row[inside], at[inside]] = self.rank(part[row[inside], at[inside]], part[row[inside], at[inside] + 1])
                over = (at >= 0) & ~inside & (at < width - 1)
                own[row[over], at[over]] = self.none
            ids[live], rank[live] = part, own
        return ids[col < size[:, None]], size


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


BLANK, LETTER, DIGIT, OTHER = range(4)


class WordIds:
    """Token ids of texts.

    The tokenizer's pattern cuts a text into runs of letters, single digits,
    runs of other characters, and contractions.  For text of Latin-1
    characters that is done on whole tiles of bytes; a fragment goes through
    the merges once and is remembered by a 64-bit hash.  Any other text, or
    one that may hold a special token, is cut at ASCII white space, over which
    the tokenizer never joins, and its words go through the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = PairMerges(self.tokenizer)
        self.rolling = common.Rolling()
        self.hash = np.zeros(0, np.uint64)  # sorted; of the fragments known
        self.first, self.count, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.pool, self.tiles = np.zeros(0, np.int64), 0
        self.words: dict[bytes, np.ndarray] = {}
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        self.kind = np.full(256, OTHER, np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = BLANK
        self.kind[48:58] = DIGIT
        self.kind[97:123] = LETTER
        self.second = {0xC2: np.full(256, OTHER, np.uint8), 0xC3: np.full(256, LETTER, np.uint8)}
        self.second[0xC2][[0x85, 0xA0]] = BLANK
        self.second[0xC2][[0xAA, 0xB5, 0xBA]] = LETTER
        self.second[0xC2][[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
        self.second[0xC3][[0x97, 0xB7]] = OTHER

    def classes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower-case bytes, class of each byte's character) of Latin-1 text."""
        data = self.low[raw]
        kind = self.kind[data]
        for lead, table in self.second.items():
            at = np.flatnonzero(raw[:-1] == lead)
            if lead == 0xC3:
                upper = at[(raw[at + 1] < 0x9F) & (raw[at + 1] != 0x97)]
                data[upper + 1] += 0x20
            kind[at] = kind[at + 1] = table[raw[at + 1]]
        return data, kind

    def starts(self, data: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where fragments, and blank runs between them, begin; rows begin at ``bounds``."""
        n = len(data)
        begin = np.ones(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin |= (kind == DIGIT) & ((data & 0xC0) != 0x80)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        begin |= first[:n]
        mark = np.flatnonzero((data == 39) & begin)  # an apostrophe that is not within a run of others
        if len(mark):
            wide = np.concatenate([data, np.zeros(3, np.uint8)])
            stop = np.concatenate([first, np.ones(3, bool)])
            a, b = wide[mark + 1], wide[mark + 2]
            size = np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 1, 0)
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            size = np.where(two & ~stop[mark + 2], 2, size)
            size = np.where(stop[mark + 1], 0, size)
            mark, size = mark[size > 0], size[size > 0]
            begin[mark + 1] = False
            after = mark + 1 + size
            begin[after[after < n]] = True
        return np.flatnonzero(begin)

    def lookup(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the hashes in what is known; fragments that are not go through the merges first."""
        self.tiles += 1
        at = np.searchsorted(self.hash, hashes)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hash) + len(new) > KEEP:  # keep what recent tiles used
                keep = self.used > self.tiles - RECENT
                keep[at[known]] = True
                self.pool = self.pool[expand(self.first[keep], self.count[keep])]
                self.hash, self.count, self.used = self.hash[keep], self.count[keep], self.used[keep]
                self.first = np.cumsum(self.count) - self.count
            words = [data[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist())]
            long = [k for k, w in enumerate(words) if len(w) >= LONG]
            ids, count = self.merges([w if len(w) < LONG else b"a" for w in words])
            if long:  # the library's merges are better than quadratic
                parts = np.split(ids, np.cumsum(count)[:-1])
                for k in long:
                    parts[k] = self.whole(words[k].decode())
                    count[k] = len(parts[k])
                ids = np.concatenate(parts)
            first = np.cumsum(count) - count + len(self.pool)
            self.pool = np.concatenate([self.pool, ids])
            every = np.concatenate([self.hash, hashes[new]])
            order = np.argsort(every, kind="stable")
            self.hash = every[order]
            self.first, self.count = (np.concatenate(x)[order] for x in ((self.first, first), (self.count, count)))
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])[order]
            at = np.searchsorted(self.hash, hashes)
        self.used[at] = self.tiles
        return at

    def tile(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids up to each bound) of Latin-1 rows."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        data, kind = self.classes(raw)
        start = self.starts(data, kind, bounds)
        end = np.append(start[1:], len(data))
        text = kind[start] != BLANK
        start, end = start[text], end[text]
        self.rolling.load(data)
        distinct, sample, back = np.unique(self.rolling.spans(start, end), return_index=True, return_inverse=True)
        at = self.lookup(distinct, data, start[sample], end[sample])[back]
        count = self.count[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.pool[expand(self.first[at], count)], ends[np.searchsorted(start, bounds)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def other(self, raw: bytes) -> np.ndarray:
        """Ids of any text, word by word."""
        words = raw.split()
        if len(self.words) > KEEP // 4:
            self.words = {}
        new = [w for w in set(words) if w not in self.words]
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        self.words.update((w, np.array(e.ids, np.int64)) for w, e in zip(new, found))
        return np.concatenate([np.zeros(0, np.int64), *map(self.words.__getitem__, words)])

    def cut(self, data: np.ndarray, stop: int, end: int) -> int:
        """The first ASCII blank from ``stop`` on."""
        while stop < end:
            blank = np.flatnonzero(self.kind[data[stop:min(stop + 4096, end)]] == BLANK)
            if len(blank):
                return stop + int(blank[0])
            stop += 4096
        return end

    def __call__(self, col: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row, in order."""
        data, offs = common.text_buffers(col)
        held: list[np.ndarray] = []
        for i, j, lo, hi in common.segments(data, offs, BATCH, self.cut):
            raw, bounds = data[lo:hi], np.clip(offs[i:j + 1], lo, hi) - lo
            odd = raw >= 0xC4
            odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)  # a special token may begin
            odd = np.concatenate([[0], np.cumsum(odd)])
            odd = odd[bounds[1:]] > odd[bounds[:-1]]
            if odd.any():
                size = np.where(odd, 0, np.diff(bounds))
                plain = raw[np.repeat(~odd, np.diff(bounds))]
                ids, ends = self.tile(plain, np.concatenate([[0], np.cumsum(size)]))
            else:
                ids, ends = self.tile(raw, bounds)
            for k in range(j - i):
                own = self.other(raw[bounds[k]:bounds[k + 1]].tobytes()) if odd[k] else ids[ends[k]:ends[k + 1]]
                if j == i + 1 and (lo > offs[i] or hi < offs[j]):  # part of a long row
                    held.append(own)
                    if hi < offs[j]:
                        continue
                    own, held = np.concatenate(held), []
                yield own


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (source.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long")
              .add("ids_crc32", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = common.worker_object(("word ids", path), lambda: WordIds(path))
        for batch in batches:
            at, piece, length, crc = [], [], [], []
            for i, ids in enumerate(ids_of(batch.column(1))):
                ids = np.append(ids, end_id).astype("<u4")
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo:lo + capacity]
                    at.append(i)
                    piece.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            piece = np.array(piece, np.int32)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece),
                                   pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()),
                                   pa.array(crc, pa.int64())],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, schema)


# ---- the plan, on counts -------------------------------------------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in descending order, cut into groups of equal cardinality: [(length, pieces), ...] each."""
    total = sum(counts.values())
    size, out, room = max(1, -(-total // groups)), [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: a most valuable multiset of sizes within the capacity."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.flatnonzero(values > 0):
        size, value = int(sizes[k]), values[k]
        for _ in range(capacity // size):
            better = best[:-size] + value > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = (best[:-size] + value)[better]
            chosen[size:][better] = k
    counts, c = np.zeros(len(sizes), np.int64), int(best.argmax())
    while c > 0 and chosen[c] >= 0:
        counts[chosen[c]] += 1
        c -= int(sizes[chosen[c]])
    return float(counts @ values), counts


def optimise(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of configurations: the rounded-down optimum of the fractional cutting-stock program."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)  # one column per basic variable
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ demand
    for step in range(rounds):
        worth, new = best_configuration(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if worth <= 1 + 1e-7:
            break
        way = inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, amount / way, np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / way[out]
        columns[:, out] = new
        amount = amount - way * ratio[out]
        amount[out] = ratio[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        if step % 200 == 199:
            inverse = np.linalg.inv(columns)
            amount = inverse @ demand
    return [(int(x + 1e-6), columns[:, j].astype(np.int64)) for j, x in enumerate(amount) if x + 1e-6 >= 1 and k]


class Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.count = dict(counts)
        self.lengths = sorted(n for n, c in counts.items() if c)

    def longest(self, most: int) -> int:
        """The longest length left of at most ``most`` tokens, or 0."""
        at = bisect.bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else 0

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            self.lengths.remove(length)


def substitute(stock: Stock, small: Stock, slots: list[int], times: int, capacity: int, spare: int) -> list[tuple[int, list[int]]]:
    """Actual pieces for ``times`` sequences with the rounded sizes ``slots`` (descending).

    Each slot takes the longest piece left that is no longer than its size; but the last one takes the longest
    that fits what the others, being shorter than planned, have left free.  While room is left, longer pieces
    replace those that are held; where that does not fill the sequence, a large and a small piece that do take the place
    of one.  A sequence for which no piece is left is not made."""
    def left(most: int, taken: list[int]) -> int:
        n = stock.longest(most)
        while n and stock.count[n] <= taken.count(n):  # this sequence has taken the last one
            n = stock.longest(n - 1)
        return n

    out = []
    while times and stock.lengths:
        held = []
        for size in slots[:-1]:
            held += [n] if (n := left(size, held)) else []
        room = capacity - sum(held)
        held += [n] if (n := left(room if held else slots[-1], held)) else []
        if not held:
            break
        while room := capacity - sum(held):  # a longer piece in the place of one that is held
            longer = [(left(h + room, held) - h, i) for i, h in enumerate(held)]
            gain, i = max(longer)
            if gain <= 0:
                break
            held[i] += gain
        if (room := capacity - sum(held)) > spare:
            pairs = ((i, n) for i, h in enumerate(held) for n in reversed(small.lengths)
                     if stock.count.get(h + room - n, 0) > held.count(h + room - n))
            if found := next(pairs, None):
                i, n = found
                held[i] += room - n
                held.append(n)
        kinds = [(stock if n in stock.count else small, n) for n in held]
        step = min([times, *(kind.count[n] // held.count(n) for kind, n in kinds)])
        for kind, n in kinds:
            kind.take(n, step)
        out.append((step, held))
        times -= step
    return out


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
              placed: list[int] | None = None) -> list[tuple[int, list]]:
    """[(sequences, [length, ...])]: classes of equal sequences that hold every piece once.

    ``placed``, when given, gets the number of large pieces that the configurations hold, and of all."""
    left = {n: c for n, c in counts.items() if c}
    full = [(left.pop(capacity), [capacity])] if capacity in left else []
    large = {n: c for n, c in left.items() if n > capacity // 8}
    if not large:
        return best_fit(full, left, capacity)
    parts = linear_groups(large, groups)
    sizes = np.array([p[0][0] for p in parts])
    demand = np.array([sum(c for _, c in p) for p in parts], float)
    configurations = [(times, sorted((int(sizes[g]) for g in np.flatnonzero(config) for _ in range(config[g])), reverse=True))
                      for times, config in optimise(sizes, demand, capacity)]
    configurations.sort(key=lambda x: -len(x[1]))
    best = None
    for spare in SPARES:
        stock, small, classes = Stock(large), Stock({n: c for n, c in left.items() if n not in large}), list(full)
        for times, slots in configurations:
            classes += substitute(stock, small, slots, times, capacity, spare)
        held = sum(large.values()) - sum(stock.count.values())
        plan = best_fit(classes, stock.count | small.count, capacity)
        if best is None or sum(t for t, _ in plan) < sum(t for t, _ in best[0]):
            best = plan, held
    if placed is not None:
        placed += [best[1], sum(large.values())]
    return best[0]


def best_fit(classes: list[tuple[int, list[int]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Place the remaining lengths, longest first, into the fullest sequences with room, else new ones."""
    by_room: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for times, held in classes:
        by_room[capacity - sum(held)].append((times, held))
    for length in sorted(left, reverse=True):
        n, room = left[length], length
        while n:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                fit = capacity // length
                times, held, room = -(-n // fit), [], capacity
            else:
                times, held = by_room[room].pop()
            fit = room // length
            full = min(times, n // fit)
            if full:
                by_room[room - fit * length].append((full, held + [length] * fit))
                n, times = n - full * fit, times - full
            if times and n and n < fit:
                by_room[room - n * length].append((1, held + [length] * n))
                n, times = 0, times - 1
            if times and held:
                by_room[room].append((times, held))
            room = length
    return [x for classes in by_room for x in classes]


def intervals(plan: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the next rank of that length is the next sequence."""
    rank, rows, base = {}, [], 0
    for times, held in plan:
        offset = 0
        for length in held:
            rows.append((length, rank.get(length, 0), base, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` (with length) and their sequence_id and offset.  ``pieces`` should be a written table."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    rows = intervals(make_plan(counts, capacity, groups), capacity)
    tagged = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    each = tagged.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = (tagged.withColumn("inside", F.row_number().over(inside)).join(each, ["length", "bucket"])
              .withColumn("rank", F.col("before") + F.col("inside") - 1).drop("before", "inside", "bucket"))
    schema = T.StructType([*ranked.schema.fields]).add("sequence_id", "long").add("offset", "long")
    key = (rows[:, 0] << 48) | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            yield pa.record_batch([*batch.columns, pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])],
                                  names=[*batch.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema).drop("rank")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = common.write_shared(token_pieces(docs, path, capacity, end_id, id_col, text_col))
    return pack(pieces, capacity, groups).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER))
