"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter

import __spark_entry__
import corpus_pipeline
import pytest
from fixtures import documents, empty, prose, with_repeats
from test_dedup import brute_components, brute_fingerprint, brute_repeats
from test_text_ops import PATH, brute_contamination
from tokenizers import Tokenizer

from regimen.llm import quality

#: A benchmark passage that one document holds.
ITEM = prose(777, 40)

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def tables(spark, tmp_path):
    junk = ["9.81 7 3.3 %% ## " * 30 + str(i) for i in range(60)]
    good = [prose(1000 + i, 120) for i in range(120)]
    near = [prose(5000, 500) + f" tail{i}" for i in range(3)]
    passages = [prose(300 + i, 60) + " " + prose(42, 60) + " " + prose(400 + i, 30) for i in range(3)]
    benchmark = [prose(600, 60) + " " + ITEM]
    docs = documents(spark, junk + good + near + passages + benchmark, 100).unionByName(with_repeats(spark))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i >= 60), 0) for i in range(180)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def rows_of(df, *without):
    return Counter(tuple((c, r[c]) for c in df.columns if c not in without) for r in df.collect())


def test_every_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    outs = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = outs[name] = spark.read.parquet(f"{tmp_path}/out{k}")
        if name != names[-1]:
            assert docs.columns == before.columns
        given, got = before.collect(), docs.collect()
        assert got
        if name == "quality_classifier":
            kept = quality.trained(spark, before, tables).score(before, score_col="q").where("q >= 0.7")
            assert rows_of(kept.drop("q")) == rows_of(docs)
            ids = [r.doc_id for r in got if r.doc_id is not None]
            assert sum(160 <= i < 280 for i in ids) >= 110 and sum(100 <= i < 160 for i in ids) <= 6
        elif name == "simhash_near_dedup":
            order = sorted(range(len(given)), key=lambda i: (given[i].doc_id is None, given[i].doc_id or 0))
            rows = [given[i] for i in order]
            parts = brute_components(range(len(rows)), [brute_fingerprint(r.text) for r in rows])
            assert len(got) == len(set(parts))
            first = {}
            for r, p in zip(rows, parts):
                first.setdefault(p, r.doc_id)
            assert Counter(r.doc_id for r in got) == Counter(first.values())
            assert sum(r.doc_id in (280, 281, 282) for r in got) == 1
        elif name == "suffix_array_dedup":
            want = brute_repeats([r.text for r in given], 200)
            kept = Counter((r.doc_id, w[0].decode("utf-8", "ignore") if w[1] else r.text, r.lang) for r, w in zip(given, want))
            assert kept == Counter((r.doc_id, r.text, r.lang) for r in got)
            assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
            assert sum(w[1] > 0 for w in want) >= 3
        elif name == "benchmark_decontamination":
            bad = {i for i, x in brute_contamination(list(enumerate(r.text for r in given)), [("b", ITEM)]).items() if x[3]}
            assert bad and Counter(r.doc_id for i, r in enumerate(given) if i not in bad) == Counter(r.doc_id for r in got)
        else:
            tokenizer = Tokenizer.from_file(PATH)
            sizes = Counter()
            for r in given:
                n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
                sizes.update((r.doc_id, k // 2048, min(2048, n - k)) for k in range(0, n, 2048))
            assert sizes == Counter((r.doc_id, r.piece, r.length) for r in got)
    whole = corpus_pipeline.run(spark, tables)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(cols).collect())) == Counter(map(tuple, docs.select(cols).collect()))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_empty_and_odd_tables(spark, tables, name):
    out = STAGES[name](spark, empty(spark), tables)
    assert out.count() == 0
    odd = STAGES[name](spark, with_repeats(spark), tables)
    assert odd.count() <= max(with_repeats(spark).count(), 40)


def test_registration():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in found) == 1
    assert found["pipeline"] and corpus_pipeline.ORACLE_SQL is None and "pipeline" not in __spark_entry__.oracle_sql()
