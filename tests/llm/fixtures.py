"""Small documents with the awkward cases, and helpers."""

import random

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "und", "être", "niño", "größe", "x1", "a"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


SHARED = prose(900, 80)

TEXTS = [
    None, "", " \n\t ", "one", "Two words", "?!...", "日本語 テキスト", "emoji 😀 text é",
    prose(1, 50), prose(1, 50), prose(1, 50), prose(2, 300), prose(3, 40) + " " + SHARED + " " + prose(4, 40),
    prose(5, 10) + " " + SHARED + " " + prose(6, 90), "a" * 700, "ab" * 600, prose(7, 60) * 3, "x " * 500,
    "word" * 3000, prose(8, 5000),
]


def documents(spark, texts=TEXTS, first=0):
    """doc_id, text, and columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en", "src", None if t is None else len(t), i, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "th long, score string")


def with_repeats(spark):
    """Rows repeated as a whole, shared ids with other texts, and null ids."""
    docs = documents(spark)
    odd = spark.createDataFrame([(3, prose(70, 60)), (None, prose(71, 60)), (None, prose(71, 60)), (None, None)],
                                "doc_id long, text string")
    extra = odd.selectExpr("doc_id", "text", "'de' as lang", "'src' as source", "cast(length(text) as bigint) as n_chars",
                           "cast(0 as bigint) as th", "'s' as score")
    return docs.unionByName(docs.where("doc_id in (8, 11)")).unionByName(extra)


def empty(spark):
    return documents(spark).where("false")
