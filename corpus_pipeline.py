"""The training-data pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``docs``, whatever they are besides doc_id and text.
Rows are told apart by id and text, so repeated rows and shared or null ids
are handled row by row.  Model labels and benchmark items are read from
``sf_dir``; everything a stage decides is decided on the rows that it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regimen.llm import common, decontaminate, packing, quality, simhash, suffix_dedup


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key() -> Column:
    """What tells rows apart, ordered by id with null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                    F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("key"), "text")


def by_key(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join rows with a table of keys (column ``key``), one row a key; ``docs`` keeps its columns."""
    parts = found.withColumns({fresh(docs, f"key_{c}"): F.col(f"key.{c}") for c in ("none", "id", "th")}).drop("key")
    own = row_key()
    on = [own[c].eqNullSafe(parts[fresh(docs, f"key_{c}")]) for c in ("none", "id", "th")]
    return docs.join(parts, on, how)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    score = fresh(docs, "score")
    model = quality.trained(spark, docs, sf_dir)
    return model.score(docs, score_col=score).where(F.col(score) >= quality.ACCEPT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every SimHash component (3-word shingles, 3 bits)."""
    found = simhash.near_duplicates(keyed(docs), id_col="key", width=3, max_bits=3)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    order = fresh(docs, "order")
    kept = by_key(docs, keep, "left_semi")
    own = Window.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.lit(0))
    return kept.withColumn(order, F.row_number().over(own)).where(F.col(order) == 1).drop(order)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 200-byte strings that also start elsewhere."""
    text, changed = fresh(docs, "kept"), fresh(docs, "changed")
    lost = suffix_dedup.remove_repeats(docs, as_text=True).dropDuplicates(["doc_id", "th"]).select(
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th").alias("key"),
        F.col("kept").alias(text), F.lit(True).alias(changed))
    out = by_key(docs, lost, "left")
    new = {"text": F.when(F.col(changed), F.col(text)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(changed), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no contaminating benchmark passage."""
    found = decontaminate.decontaminate(keyed(docs), common.table(spark, sf_dir, "benchmark", "item_id", "text"),
                                        id_col="key")
    return by_key(docs, found.where("contaminated").select(F.col("doc_id").alias("key")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: A trained classifier, fingerprints and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.write_shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
