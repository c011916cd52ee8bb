"""Operators 1, 6 and 7: exact code lengths, held-out accuracy, and the awkward cases."""

import random
import zlib
from collections import Counter
from math import log2

import numpy as np
import pytest
from fixtures import documents, empty, prose, with_repeats

from pyspark.sql import functions as F

from regimen.llm import bytelm, language_id, quality, toxicity, url_filter

SYLLABLES = {"aa": ["tha", "ing", "er", "on"], "bb": ["sch", "ung", "ei", "pf"], "cc": ["ção", "ñe", "lla", "os"]}


def invented(lang: str, seed: int, n: int = 40) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


def brute_bits(train: str, text: str, order: int) -> float:
    """Prediction by partial matching with exclusion, from counts of the padded training text."""
    def lower(t):
        return bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())

    padded, counts = b" " * order + lower(train), {}
    for i in range(order, len(padded)):
        for d in range(order + 1):
            counts.setdefault(padded[i - d:i], Counter())[padded[i]] += 1
    bits, padded = 0.0, b" " * order + lower(text)
    for i in range(order, len(padded)):
        symbol, out = padded[i], set()
        for d in range(order, -1, -1):
            seen = counts.get(padded[i - d:i])
            if seen is None:
                continue
            left = {s: n for s, n in seen.items() if s not in out}
            total = sum(left.values()) + len(left)
            if symbol in left:
                bits += log2(total / left[symbol])
                break
            if left:
                bits += log2(total / len(left))
            out |= set(seen)
        else:
            bits += log2(max(1, 256 - len(out)))
    return bits


def tree(text: str, order: int) -> bytelm.Tree:
    raw = np.frombuffer(text.encode(), np.uint8)
    g = bytelm.grams(raw, np.array([0, len(raw)]), 0, 1, 0, len(raw), order, bytelm.lower_table())
    gram, n = np.unique(g, return_counts=True)
    return bytelm.Tree(gram, n, order)


def test_code_lengths_equal_brute_force():
    import pyarrow as pa

    train, low = "The cat sat on the mat. THE END, the cat", bytelm.lower_table()
    for order in (1, 2, 3):
        table = bytelm.GramTable([tree(train, order), tree("zzz", order)], "code_lengths")
        for text in ("the cat", "Then a dog é", "q", "", "the mat sat on"):
            got = bytelm.text_sums(table, pa.array([text]), order, low)[0, 0]
            assert abs(got - brute_bits(train, text, order)) < 1e-3, (order, text)


def test_interpolated_probabilities_add_up():
    model = tree("abracadabra abrakadabra", 2)
    context = np.uint64(ord("a") << 16 | ord("b") << 8)
    p = np.exp2(model.log_likelihoods(context | np.arange(256, dtype=np.uint64)))
    assert abs(p.sum() - 1) < 1e-9


def test_language_of_held_out_texts(spark):
    rows = [(3 * i + k, invented(lang, i), lang) for i in range(60) for k, lang in enumerate(SYLLABLES)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 ?!", "cc"), (903, invented("aa", 5, 30_000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.where((docs.doc_id % 5 != 0) & (docs.doc_id < 900))
    model = language_id.fit(train)
    got = {r.doc_id: r for r in model.predict(docs.withColumnRenamed("lang", "score_")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i < 900)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.fit(docs.where("false")).predict(docs).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert model.predict(docs.where("false")).count() == 0


def test_grams_of_parts_equal_grams_of_the_whole(monkeypatch):
    import pyarrow as pa

    low, texts = bytelm.lower_table(), [invented("aa", 1, 300), None, "", "x", invented("cc", 2, 200)]
    table = bytelm.GramTable([tree(invented("aa", 9), 3), tree(invented("cc", 9), 3)], "code_lengths")
    whole = bytelm.text_sums(table, pa.array(texts), 3, low)
    monkeypatch.setattr(bytelm.common, "TILE", 256)
    assert np.allclose(whole, bytelm.text_sums(table, pa.array(texts), 3, low))


def test_joined_values_equal_trees_held_whole(spark, monkeypatch):
    import pyarrow as pa

    train = {"aa": invented("aa", 9) + " The END", "bb": invented("bb", 9)}
    texts = [invented("aa", 1, 50), None, "", "x", invented("cc", 2, 60), invented("aa", 9)[5:90] + " 0é" * 9]
    rows = spark.createDataFrame(list(train.items()), "cls string, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    for value, orders in (("code_lengths", (1, 2, 3)), ("log_likelihoods", (4,))):
        for order in orders:
            table = bytelm.GramTable([tree(t, order) for t in train.values()], value)
            want = bytelm.text_sums(table, pa.array(texts), order, bytelm.lower_table())
            for most in (0, 100, 1 << 18):
                monkeypatch.setattr(bytelm, "CACHED", most)
                model = bytelm.Model(bytelm.count_grams(rows, order, list(train)), 2, order, value)
                got = {r.i: r for r in model.sums(docs, "text").collect()}
                assert len(got) == len(texts) and [got[i].bytes_ for i in range(3)] == [len(texts[0]), 0, 0]
                assert np.allclose([got[i].sums_ for i in range(len(texts))], want, rtol=1e-5), (value, order, most)


def test_a_small_model_is_held_whole_and_joins_nothing(spark):
    rows = spark.createDataFrame([("a", "example.com/en/x1"), ("b", "example.net/fr/y2")], "cls string, text string")
    model = bytelm.Model(bytelm.count_grams(rows, 4, ["a", "b"]), 2, 4, "log_likelihoods")
    sums = model.sums(rows, "text")
    assert "Exchange" not in sums._jdf.queryExecution().toString()
    assert all((r.sums_[0] > r.sums_[1]) == (r.cls == "a") for r in sums.collect())


def test_rare_grams_beside_many_frequent_ones_are_kept(spark):
    r = random.Random(4)
    many = ["".join(r.choices("abcdefghijklmnop", k=40_000)) for _ in range(6)]
    assert len({t[i:i + 4] for t in many for i in range(len(t) - 3)}) > 60_000
    wide = ["".join(r.choices("abcdefghijklmnopqrst", k=40_000)) for _ in range(6)]  # with the others: over 65,536
    rare = "zyx wvu zyx wvu 987 zyx"
    rows = [(t, "aa") for t in (many + wide) * 2] + [(rare, "aa"), ("zyx wvu 987 xyz uvw 789 zzyyxx", "bb")]
    train = spark.createDataFrame(rows, "text string, lang string")
    got = language_id.fit(train).predict(spark.createDataFrame([(1, rare)], "i int, text string")).collect()
    assert [x.lang_pred for x in got] == ["aa"]


def test_every_language_is_learned(spark):
    names = [f"l{k:02}" for k in range(70)]
    letters = {lang: "".join(chr(0x4E00 + 3 * k + i) for i in range(3)) for k, lang in enumerate(names)}
    rows = [(letters[lang] * (2 + i), lang) for k, lang in enumerate(names) for i in range(1 + (k < 64))]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = language_id.fit(docs).predict(docs).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)


def labelled(spark, tmp_path, column, good, bad, n=160):
    """Documents and labels: label 1 is ``good``; the awkward rows are not labelled."""
    rows = [(i, good(i) if i % 3 else bad(i)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    odd = with_repeats(spark).selectExpr("doc_id + 1000 as doc_id", "text", "lang")
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 > 0)) for i, _ in rows] + [(5000, 1, 0), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return {i: int(i % 3 > 0) for i, _ in rows}, docs.count() + odd.count()


def held(doc_id, by, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % by == rest


def test_quality_of_held_out_texts(spark, tmp_path):
    want, n = labelled(spark, tmp_path, "quality", lambda i: invented("aa", i, 60),
                       lambda i: " ".join(f"{random.Random(i + k).random():.9f}" for k in range(40)))
    got = quality.op6(spark, str(tmp_path)).collect()
    assert len(got) == n and all(r.held_out == held(r.doc_id, 4, 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in want]
    assert len(out) > 15 and np.mean([r.predicted == want[r.doc_id] for r in out]) > 0.9


def test_quality_without_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.p for r in quality.fit(docs, none).score(docs, score_col="p").collect()} == {0.5}
    ones = spark.createDataFrame([(8, 1), (9, 1)], "doc_id long, quality int")
    assert {r.p for r in quality.fit(docs, ones).score(docs, score_col="p").collect()} == {1.0}
    assert quality.fit(docs, none).score(empty(spark), score_col="p").count() == 0


def test_long_texts_are_measured_whole():
    good, bad = (quality.dictionary([invented(x, i, 400).encode() for i in range(60)], 4096) for x in ("aa", "bb"))
    measure = quality.Difference(good.as_bytes(), bad.as_bytes(), (good.dict_id() == 0, bad.dict_id() == 0))
    begin = invented("aa", 99, 2000).encode()
    assert measure(begin) > 0.005 > -0.005 > measure(begin + invented("bb", 99, 20_000).encode())
    assert measure(b"") == 0


def test_toxicity_of_held_out_texts(spark, tmp_path):
    def rude(i):
        r = random.Random(i)
        w = invented("aa", i, 60).split()
        for _ in range(4):
            w.insert(r.randrange(len(w)), r.choice(["you", "YOU"]) + " " + r.choice(["zork", "zorkish", "blarg!", "Blargs"]))
        return " ".join(w)

    want, n = labelled(spark, tmp_path, "toxic", rude, lambda i: invented("aa", i, 60), 240)
    got = toxicity.op7(spark, str(tmp_path)).collect()
    assert len(got) == n and all(r.held_out == held(r.doc_id, 3, 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in want]
    assert len(out) > 30 and np.mean([r.predicted == want[r.doc_id] for r in out]) > 0.9


def test_marks_deep_in_long_texts_are_learned(spark, monkeypatch):
    head = invented("cc", 1, 4000)  # over DICT_TEXT and, twice, over 32,768 bytes
    assert len(head.encode()) > quality.DICT_TEXT
    rows = [(i, head + " " + invented("aa" if i % 2 else "bb", i, 6000), i % 2) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(docs.drop("quality"), docs.select("doc_id", "quality"))
    got = model.differences(spark.createDataFrame([(invented("aa", 90, 900),), (invented("bb", 90, 900),)], "text string"))
    a, b = (r.difference for r in got.collect())
    assert a > 0.005 > -0.005 > b
    rude = spark.createDataFrame([(i % 2, head * 2 + (" zork" if i % 2 else " ") * 3) for i in range(24)], "y int, text string")
    for tile in (1 << 18, 1 << 14):
        monkeypatch.setattr(toxicity.common, "TILE", tile)
        assert toxicity.word_hash(["zork"])[0] in toxicity.learn_lexicon(rude)[0]
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    named = spark.createDataFrame([(i, head * 2 + (" zork" if i % 2 else " ") * 3) for i in range(24)], "doc_id long, text string")
    monkeypatch.setattr(toxicity.common, "TILE", 1 << 18)
    found = []
    monkeypatch.setattr(toxicity, "ToxicityModel", lambda lexicon, *a, **k: found.append(lexicon) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        toxicity.fit(named, labels)
    assert toxicity.word_hash(["zork"])[0] in found[0]


def test_toxicity_without_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.fit(docs, none).score(docs.select("doc_id", "text")).collect()} == {0.5}


def test_features_count_what_they_say(monkeypatch):
    import pyarrow as pa

    lexicon = toxicity.word_hash(["idiot"])
    measure = toxicity.Features(lexicon, np.array([3.0]))
    names = toxicity.FEATURES
    texts = [None, "", "You are an idiot!!", "IDIOT idiots", "1d10t and id!ot", "fine words", "x " * 400 + "you idiot"]
    rates = measure.rates(pa.array(texts))
    at = {f: i for i, f in enumerate(names)}
    assert not rates[0].any() and not rates[1].any()
    assert rates[2][at["word_hits"]] == 0.25 and rates[2][at["near_you"]] == 0.25 and rates[2][at["mark_run"]] == 2
    assert rates[3][at["capital_words"]] == 0.5 and rates[3][at["word_hits"]] == 0.5 and rates[3][at["begin_hits"]] == 1.0
    assert rates[4][at["unmasked"]] > 0 and rates[4][at["mixed"]] > 0
    assert rates[5][at["word_hits"]] == 0 and rates[6][at["near_you"]] > 0
    monkeypatch.setattr(toxicity.common, "TILE", 64)
    assert np.allclose(toxicity.Features(lexicon, np.array([3.0])).rates(pa.array(texts)), rates)


def plain_rates(text, lexicon, odds):
    """The features of one text, word by word."""
    import re

    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [(m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low)]
    def entry(w):
        tries = [w] + [w[:p] for p in toxicity.BEGINNINGS]
        found = [t for t in tries if t in lexicon]
        return (found[0], max(odds[lexicon.index(t)] for t in found)) if found else None
    hits = [entry(low[a:b]) for a, b in words]
    you = [low[a:b].decode(errors="replace") in toxicity.SECOND_PERSON.split() for a, b in words]
    upper = lambda x: sum(65 <= b <= 90 for b in x)
    letters = lambda x: sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in x)
    digits = lambda x: sum(48 <= b <= 57 for b in x)
    meant = {ord(a): ord(b) for a, b in zip(toxicity.MASKED, toxicity.MEANT)}
    unmasked = 0
    for m in re.finditer(rb"[0-9a-z\x80-\xff@$!|*]+", low):
        w = bytes(meant.get(b, b) for b in m.group())
        starts = [a for (a, _), h in zip(words, hits) if h]
        signs = sum(not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) or 48 <= b <= 57 for b in m.group())
        unmasked += w in lexicon and len(w) > 2 and m.start() not in starts and signs > 0
    n, size = max(1, len(words)), max(1, len(raw))
    marks = rb"[!-/:-@\[-`{-~]"
    return [sum(low[a:b] in lexicon for a, b in words) / n, sum(h is not None for h in hits) / n, sum(h[1] for h in hits if h) / n,
            len({h[0] for h in hits if h}),
            sum(h is not None and any(you[max(0, i - 3):i] + you[i + 1:i + 4]) for i, h in enumerate(hits)) / n,
            upper(raw) / max(1, letters(raw)), sum(upper(raw[a:b]) > 1 and upper(raw[a:b]) == letters(raw[a:b]) for a, b in words) / n,
            sum(b in b"!?" for b in raw) / size, len(re.findall(marks, raw)) / size,
            max((len(x) for x in re.findall(marks + b"+", raw)), default=0),
            sum(letters(raw[a:b]) > 0 and digits(raw[a:b]) > 0 for a, b in words) / n, unmasked / n]


@pytest.mark.parametrize("tile", [1 << 18, 64, 17])
def test_features_of_a_text_do_not_depend_on_its_neighbours(monkeypatch, tile):
    import pyarrow as pa

    monkeypatch.setattr(toxicity.common, "TILE", tile)
    entries = ["idiot", "zork", "moro", "blarg", "ärger"]
    hashes = np.array([toxicity.word_hash([w])[0] for w in entries])
    order = np.argsort(hashes)
    measure = toxicity.Features(hashes[order], np.array([3.0, 2.7, 4.0, 5.0, 2.6])[order])
    odds = [3.0, 2.7, 4.0, 5.0, 2.6]
    r = random.Random(tile)
    parts = ["you", "YOU", "idiot", "id!ot", "zorking", "MORON", "bl4rg", "Ärger", "ärger", "fine", "x1", "...", "!!!", "?", "tú", "$$", "*a*", "word"]
    texts = [None, "", "hey!!!", "???what", "!!!", "!?"]
    texts += ["".join(r.choice(parts) + r.choice([" ", " ", "", "\n", "! "]) for _ in range(r.randint(1, 90)))
              for _ in range(60)]
    want = np.array([plain_rates(t, [e.encode() for e in entries], odds) for t in texts])
    for _ in range(3):
        at = list(range(len(texts)))
        r.shuffle(at)
        assert np.allclose(measure.rates(pa.array([texts[i] for i in at], pa.string())), want[at])


def test_column_names_never_clash(spark, tmp_path):
    """Every internal and output name as a column of the input: kept, or replaced by the output of that name."""
    from fixtures import TEXTS

    names = ["row", "rates", "rate_vector", "raw_score", "margin", "rate_marks", "score", "lang_pred", "row_", "bytes_", "sums_",
             "host", "path", "rule", "verdict", "ratio", "u_", "r_", "by_rule", "judged", "c0", "c", "has_letter", "difference"]
    docs = documents(spark).drop("score").selectExpr("doc_id", "text", "lang", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, y int")
    made = {
        ("score",): quality.fit(docs, labels, "y").score(docs),
        ("score", ""): toxicity.fit(docs, labels, "y").score(docs),
        ("lang_pred", "score"): language_id.fit(docs).predict(docs),
        ("host", "path", "rule", "verdict", "ratio", "score"): url_filter.filter_urls(docs.drop("text").withColumn(
            "url", F.concat(F.lit("http://a.net/fr/"), "doc_id"))),
    }
    for outs, df in made.items():
        rows = df.collect()
        assert len(rows) == len(TEXTS) and len(set(df.columns)) == len(df.columns)
        for r in rows:
            for n in names:
                assert n in outs or r[n] == f"{n}{r.doc_id}"
        assert all(not str(r[o]).startswith(o) for r in rows for o in outs if o)


def test_lexicon_of_prose_is_empty(spark):
    rows = spark.createDataFrame([(i % 2, prose(i, 30)) for i in range(20)], "y int, text string")
    assert len(toxicity.learn_lexicon(rows)[0]) < 10
