"""Operators 4 and 9 against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import SHARED, documents, empty, prose, with_repeats

from regimen.llm import simhash, suffix_dedup
from regimen.llm.components import connect


def brute_repeats(rows, span):
    """{row index: (kept bytes, removed, runs)}: every byte of a string that starts anywhere else."""
    raw = [(t or "").encode() for t in rows]
    seen = Counter(b[a:a + span] for b in raw for a in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - span + 1):
            if seen[b[a:a + span]] > 1:
                gone[a:a + span] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((np.frombuffer(b, np.uint8)[~gone].tobytes(), int(gone.sum()), runs))
    return out


def lost(docs, **kwargs):
    found = suffix_dedup.remove_repeats(docs, **kwargs).collect()
    return {(r.doc_id, r.th): (bytes(r.kept), r.n_removed, r.n_spans) for r in found}


def check_repeats(docs, span, **kwargs):
    rows = suffix_dedup.keyed(docs, "doc_id", "text").collect()
    want = brute_repeats([r.text for r in rows], span)
    got = lost(docs, span=span, **kwargs)
    for r, w in zip(rows, want):
        kept = ((r.text or "").encode(), 0, 0)
        assert got.get((r.doc_id, r.th), kept) == w, r.doc_id
    return want


def test_repeats_equal_brute_force(spark):
    want = check_repeats(with_repeats(spark), 200)
    assert any(0 < w[1] < 2000 for w in want) and any(w[1] == 0 for w in want)


def test_small_spans_and_partial_overlaps(spark):
    texts = [prose(i, 12)[:40] + SHARED[10 + i:90 + i] + prose(50 + i, 12)[:30] for i in range(6)]
    texts += [SHARED[:60], SHARED[20:95], "z" * 90]
    check_repeats(documents(spark, texts), 40, gram=8)


def test_crowded_anchors_are_counted_by_windows(spark, monkeypatch):
    texts = [prose(i, 20) + " " + SHARED[:150] + " " + prose(500 + i, 20) for i in range(30)]
    texts += [prose(3, 20) + " " + SHARED[:150] + " " + prose(777, 20)]
    docs = documents(spark, texts)
    rows = suffix_dedup.keyed(docs, "doc_id", "text")
    few = suffix_dedup.repeated_starts(rows, 100, 16, shard_contexts=2).collect()
    many = suffix_dedup.repeated_starts(rows, 100, 16).collect()

    def starts(found):
        return {(r.doc_id, x) for r in found for x in range(r.lo, r.hi + 1)}

    assert starts(few) == starts(many) and starts(few)


def test_small_shards_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.common, "TILE", 4096)
    texts = [prose(1, 4000), prose(2, 3000) + SHARED + prose(1, 500), SHARED]
    check_repeats(documents(spark, texts), 200)


def test_empty_table_and_digest_query(spark, tmp_path):
    assert lost(empty(spark)) == {}
    with_repeats(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op4(spark, str(tmp_path)).collect()
    assert len(got) == with_repeats(spark).count()
    by = {r.doc_id: r for r in got if r.doc_id == 1}
    assert by[1].n_bytes == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest()


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, max_bits=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= max_bits:
                    label[i], changed = label[j], True
    low = {}
    for i, x in zip(ids, label):
        if i is not None:
            low[x] = min(i, low.get(x, i))
    return [low.get(x) for x in label]


def test_simhash_equals_brute_force(spark):
    near = [prose(100, 400).replace("alpha", "alphb", k) for k in range(4)]
    docs = with_repeats(spark).unionByName(documents(spark, near, 100))
    rows = docs.collect()
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault((r.doc_id, r.fp & (2 ** 64 - 1)), []).append(r.component_id)
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {}
    for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps)):
        want.setdefault((r.doc_id, f), []).append(c)
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = prose(5, 900)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_fuzzy_keys_meet_for_every_pattern_of_three_errors():
    rng = np.random.default_rng(5)
    nearest, others = simhash.golay_keys()
    for _ in range(3000):
        x = int(rng.integers(0, 2 ** 63))
        y = x
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= 1 << int(b)
        row, key, primary = simhash.fuzzy_keys(np.array([x, y], np.uint64))
        own = set(key[(row == 0) & primary])
        assert own & set(key[row == 1])


@pytest.mark.parametrize("bucket", [2, 1000])
def test_links_of_a_dense_group_connect_it(spark, bucket):
    """Many fingerprints around one centre: split keys give the same components as one bucket."""
    rng = np.random.default_rng(3)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 60:
        x = rng.choice(list(fps))
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            x = int(x) ^ (1 << int(b))
        fps.add(int(x))
    fps |= {int(x) for x in rng.integers(0, 2 ** 63, 40)}
    fps = sorted(fps)
    signed = [(x - 2 ** 64 if x >= 2 ** 63 else x,) for x in fps]
    keys = spark.createDataFrame(signed, "fp long").mapInArrow(simhash.key_batches, simhash.KEY_SCHEMA)
    links = simhash.link_keys(keys, 3, bucket)
    pairs = [(r.u & (2 ** 64 - 1), r.v & (2 ** 64 - 1)) for r in links.collect()]
    at = {x: i for i, x in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in fps:
        for a, b in pairs:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
    assert [fps[i] for i in label] == [x for x in brute_components(fps, fps)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (100, 100), (205, 203), (205, 207), (7, 39)]
    got = {r.node: r.root for r in connect(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 203: 203, 205: 203, 207: 203}
    assert connect(spark.createDataFrame([], "u long, v long")).count() == 0
