import pytest

from regimen.sources import tables, text

COLS = ["a", "b", "c"]
PRE = "### note\r\n### ---Under is the data--- ###\r\n\r\n"


def docs(spark, body):
    return spark.createDataFrame([(body,)], "text string")


def test_sentinel_and_strip(spark):
    out = text.parse_annotated_text(docs(spark, PRE + "1\t2\t3\t\r\n\r\n 4\t5\t6 \r\n"), COLS).collect()
    assert [(r.a, r.b, r.c) for r in out] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_no_sentinel_starts_at_first_line(spark):
    out = text.parse_annotated_text(docs(spark, "1\t2\t3\n4\t5\t6\n"), COLS).collect()
    assert len(out) == 2


def test_strict_bad_token_raises(spark):
    with pytest.raises(Exception):
        text.parse_annotated_text(docs(spark, PRE + "1\tabc\t3\r\n"), COLS, mode="strict").collect()


def test_strict_wrong_width_raises(spark):
    with pytest.raises(Exception):
        text.parse_annotated_text(docs(spark, PRE + "1\t2\r\n"), COLS, mode="strict").collect()


def test_lenient_markers_pad_and_corrupt(spark):
    body = PRE + "1\t/\tabc\r\n7\t8\r\n1\t2\t3\t4\r\n"
    out = text.parse_annotated_text(docs(spark, body), COLS, mode="lenient").orderBy("line_no").collect()
    assert (out[0].a, out[0].b, out[0].c, out[0]._corrupt_record) == (1.0, None, None, None)
    assert (out[1].a, out[1].b, out[1].c, out[1]._corrupt_record) == (7.0, 8.0, None, None)
    assert out[2]._corrupt_record == "1\t2\t3\t4"


def test_read_files(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_bytes((PRE + "1\t2\t3\r\n").encode())
    out = text.read_annotated_text(spark, str(tmp_path), columns=COLS).collect()
    assert [(r.a, r.b, r.c) for r in out] == [(1.0, 2.0, 3.0)]


def test_reader_is_the_same_for_split_files(spark, tmp_path):
    rows = [f"{i}\t{i / 2}\t/" for i in range(3000)]
    p = tmp_path / "big.txt"
    p.write_bytes(("### header\r\n### ---Under is the data--- ###\r\n\r\n" + "\r\n".join(rows) + "\r\n").encode())
    whole = text.read_annotated_text(spark, str(p), columns=COLS, mode="lenient").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        split = text.read_annotated_text(spark, str(p), columns=COLS, mode="lenient")
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 4
        split = split.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, whole)) == sorted(map(tuple, split))
    assert sorted(r.line_no for r in split) == list(range(3, 3003))
    assert all(r.a == r.line_no - 3 and r.c is None for r in split)


def test_comment_among_the_data_is_a_bad_row(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_bytes((PRE + "1\t2\t3\r\n### note\r\n4\t5\t6\r\n").encode())
    out = text.read_annotated_text(spark, str(p), columns=COLS, mode="lenient").orderBy("line_no").collect()
    assert [r._corrupt_record for r in out] == [None, "### note", None]
    with pytest.raises(Exception):
        text.read_annotated_text(spark, str(p), columns=COLS).collect()


def test_line_numbers_of_two_files_never_meet(spark):
    rows = spark.createDataFrame([("f", 0, 2 ** 40), ("f", 0, 2 ** 40 + 1), ("f", 1 << 30, 7), ("g", 0, 8)],
                                 "source_file string, _block long, _id long")
    out = tables.with_line_numbers(rows).collect()
    assert sorted((r.source_file, r.line_no) for r in out) == [("f", 0), ("f", 1), ("f", 2), ("g", 0)]


@pytest.mark.parametrize("token, value", [("1.0d", None), ("2.0f", None), ("1e3", 1000.0), ("+.5", 0.5), ("5.", 5.0),
                                          ("nan", None), ("0x10", None)])
def test_number_tokens(spark, token, value):
    out = text.parse_annotated_text(docs(spark, f"1\t2\t{token}"), COLS, mode="lenient").first()
    assert out.c == value
    strict = text.parse_annotated_text(docs(spark, f"1\t2\t{token}"), COLS)
    if value is None and token != "nan":
        with pytest.raises(Exception):
            strict.collect()
    else:
        assert strict.first().c == value
