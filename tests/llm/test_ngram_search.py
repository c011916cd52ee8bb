"""Operators 11 to 13 against brute force: n-gram join, collocations, lexical search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, prose, with_repeats

from regimen.llm import collocations, common, lexical_search, ngram_join

UPPER = {c: c + 32 for c in range(65, 91)}


def family(seed, n, copies, edits):
    """Near copies: ``n`` words, up to ``edits`` of them replaced."""
    r = random.Random(seed)
    base = prose(seed, n).split()
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(n)] = f"new{r.randint(0, 9)}"
        out.append(" ".join(words))
    return out


# ---- operator 11

def word_sets(texts, width=3):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        out.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)})
    return out


def jaccard_components(ids, texts, percent=90):
    sets = word_sets(texts)
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(low.get(find(i), x), x)
    return sorted(((x, len(s), (low.get(find(i)) if s else x)) for i, (x, s) in enumerate(zip(ids, sets))), key=repr)


def joined(df, **kw):
    return sorted((tuple(r) for r in ngram_join.jaccard_join(df, **kw).collect()), key=repr)


def test_jaccard_join_of_awkward_rows(spark):
    df = with_repeats(spark)
    rows = df.collect()
    assert joined(df) == jaccard_components([r.doc_id for r in rows], [r.text for r in rows])
    assert joined(empty(spark)) == []


@pytest.mark.parametrize("block_rows,percent", [(1024, 90), (5, 90), (7, 70)])
def test_jaccard_join_of_near_copies(spark, block_rows, percent):
    texts = family(1, 60, 60, 4) + family(2, 11, 20, 1) + family(3, 200, 25, 12) + [prose(i, 80) for i in range(50, 60)]
    texts += [prose(4, 30) + " " + prose(60 + i, 30) for i in range(20)] + ["One Two  three", "one\ttwo THREE", "É x", "é x"]
    random.Random(5).shuffle(texts)
    ids = list(range(100, 100 + len(texts)))
    df = documents(spark, texts, 100).repartition(5)
    assert joined(df, block_rows=block_rows, percent=percent) == jaccard_components(ids, texts, percent)


def test_units_cover_loose_groups_by_column(spark):
    """Rows that meet in a chain of columns: multiplied by column, with the same links."""
    r = random.Random(3)
    entries = [(h, cid, 10) for cid in range(200) for h in {cid, cid + 1}]
    df = spark.createDataFrame(entries, "h long, cid long, n long")
    units = ngram_join.work_units(df, 4, 1 << 20).collect()
    members = {}
    for u in units:
        members.setdefault(u.unit, set()).add(u.cid)
    assert max(map(len, members.values())) <= 8
    for h in range(1, 200):
        assert any({h - 1, h} <= m for m in members.values()), h
    assert len(units) < 1000 and r


def test_unit_links_connect_what_all_pairs_connect():
    r = np.random.default_rng(4)
    for _ in range(30):
        base = r.integers(1, 1 << 62, 40).astype(np.uint64)
        cells = []
        for _ in range(25):
            keep = base[r.random(40) > 0.06]
            cells.append(np.unique(np.concatenate([keep, r.integers(1, 1 << 62, r.integers(0, 3)).astype(np.uint64)])))
        side = np.full(25, 2) if r.random() < 0.5 else r.integers(0, 2, 25)
        found = ngram_join.unit_links(np.arange(25), side, cells, 90)
        label = list(range(25))

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in found:
            both = len(np.intersect1d(cells[a], cells[b]))
            assert 190 * both >= 90 * (len(cells[a]) + len(cells[b]))
            label[find(a)] = find(b)
        for a in range(25):
            for b in range(a):
                if side[a] == 2 or side[a] != side[b]:
                    both = len(np.intersect1d(cells[a], cells[b]))
                    if 190 * both >= 90 * (len(cells[a]) + len(cells[b])):
                        assert find(a) == find(b)
        assert len(found) < 25


# ---- operator 12

def brute_collocations(rows, least, top, share):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            longer = any(len(p) > len(phrase) and b >= least and 100 * b >= share * a
                         and any(p[i:i + len(phrase)] == phrase for i in range(len(p) - len(phrase) + 1))
                         for p, b in counts.items() if len(p) > len(phrase))
            if not longer:
                found.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y") for i, (t, lang) in enumerate(rows)],
                                 "doc_id long, text string, lang string, w1 string, n string")


def random_rows(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "the", "of", "größe", "x1", "Ñ", "in", "new", "york", "new", "york", "city"]
    sep = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]
    out = [(None, "en"), ("", None), (" .,\n", "en"), ("alone", "xx")]
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice(sep) for _ in range(r.randint(1, 60)))
        out.append((text, r.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("least,top,share", [(3, 2000, 80), (8, 15, 60)])
def test_collocations_equal_brute_force(spark, least, top, share):
    rows = random_rows(least, 60)
    got = collocations.collocations(phrase_rows(spark, rows).repartition(3), least, top, share)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least, top, share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(phrase_rows(spark, rows).where("false")).collect() == []
    assert collocations.collocations(phrase_rows(spark, [("two words", "en")]), least=1).first()["a"] == 1


def test_collocations_of_a_text_of_many_tiles(spark, monkeypatch):
    """Windows that cross the borders of a long row's parts are counted once."""
    monkeypatch.setattr(common, "TILE", 64)
    rows = random_rows(11, 12) + [(" ".join(t or "" for t, _ in random_rows(12, 40)), "en"), ("w" * 500 + " a b a b", "en")]
    scan = collocations.Pieces()
    got = Counter()
    for start in range(0, len(rows), 5):
        col = pa.array([t for t, _ in rows[start:start + 5]], pa.string())
        for part, begin, end, _, row, linked in scan.runs(col):
            low = scan.low[part]
            words = [low[a:b].tobytes().decode() for a, b in zip(begin, end)]
            for i in np.flatnonzero(row >= 0):
                window = [words[i]]
                while len(window) < 4 and i + len(window) < len(words) and linked[i + len(window) - 1]:
                    window.append(words[i + len(window)])
                got[tuple(window)] += 1
    want = Counter()
    for text, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            want.update(tuple(w[i:i + 4]) for i in range(len(w)))
    assert got == want


def test_collocation_scores_pass_64_bits(spark):
    big = 7_000_000_000_000
    counts = spark.createDataFrame([("en", [], 9 * big), ("en", ["a"], 2 * big + 1), ("en", ["b"], big + 5), ("en", ["a", "b"], big)],
                                   "lang string, words array<string>, f long")
    keep = collocations.phrase_counts
    try:
        collocations.phrase_counts = lambda *a: counts
        row = collocations.collocations(counts).collect()
    finally:
        collocations.phrase_counts = keep
    assert [tuple(r) for r in row] == [("en", 1, "a b", big, 2 * big + 1, big + 5, 9 * big, 2_000_000 * big // (3 * big + 6))]


# ---- operator 13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    bags = [Counter(TERM.findall((t or "").translate(UPPER))) for _, t in docs]
    n_docs, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(x for b in bags for x in b)
    out = []
    for item, text in items:
        found = []
        for (doc, _), bag in zip(docs, bags):
            m = 50 + 50 * sum(bag.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                        for t in set(TERM.findall((text or "").translate(UPPER))) if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda e: (e[0], e[1], e[2] or 0))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "alpha1 the2 beta3 gamma4 of5"), (2, None), (None, "Two WORDS one"), (3, "größe7 niño8 x1"), (3, "delta9 delta9 ... und10"),
         (4, "?!"), (5, prose(2, 300)), (6, "日本語 nothing here")]


@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lexical_search, "INDEX_DOCS", 4)
    df = with_repeats(spark).repartition(3)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_search(docs, ITEMS, k)
    for block_terms in (1 << 20, 60):
        got = lexical_search.search(df, items, k, block_terms=block_terms)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert lexical_search.search(empty(spark), items, k).collect() == []
    assert lexical_search.search(df, items.where("false"), k).collect() == []


def test_accumulators_stop_and_scores_stay_exact():
    """With many documents, common terms make no accumulators, and the best documents are the same."""
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["the", "of", "in"]) for _ in range(20)) + (f" rare{i % 7}" if i % 10 == 0 else "")) for i in range(2000)]
    item = "the of in rare3 rare4"
    block, vocab = lexical_search.IndexBlock(), np.unique(np.concatenate(
        [w for _, _, w, _ in lexical_search.Words().groups(pa.array([item]))]))
    for i, j, words, bounds in lexical_search.Words().groups(pa.array([t for _, t in docs])):
        block.add(pa.array([d for d, _ in docs])[i:j], words, bounds, vocab)
    row = block.batch(pa.int64())
    cells = {c: row.column(c)[0].values for c in ("ids", "n", "term", "df", "row", "tf")}
    one = {c: v if c == "ids" else v.to_numpy() for c, v in cells.items()}
    df = np.zeros(len(vocab), np.int64)
    df[one["term"]] = one["df"]
    weight = np.array([math.floor(1000 * math.log(4002 / (2 * int(x) + 1))) for x in df], np.int64)
    rank = np.argsort(np.argsort(df, kind="stable"))
    made, kept = [0], [[]]
    lexical_search.best_documents(one, [np.arange(len(vocab))], weight, rank, block.with_terms, block.n_terms, 10, kept, made)
    assert [(1, i, e[2], -e[0]) for i, e in enumerate(kept[0], 1)] == sorted(brute_search(docs, [(1, item)], 10), key=lambda x: x[1])
    assert 10 <= made[0] < 100


def test_norms_beyond_64_bits():
    n = np.array([10**7, 3], np.int64)
    docs, words = 10**12, 10**14
    assert lexical_search.document_norms(n, docs, words).tolist() == [50 + 50 * int(x) * docs // words for x in n]
