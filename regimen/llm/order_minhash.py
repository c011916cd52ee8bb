"""Operator 5: Order MinHash fingerprints, with DataFrame and SQL functions only.

A text's tokens are its runs of at most ``RUN`` non-space characters; longer runs (scripts without spaces, codes) give
each character as a token, so that one character put in changes its neighbourhood only.  A k-mer is ``K``
consecutive tokens (fewer at the end), and its j-th occurrence is an element of its own, (k-mer, j), with its own
hash h.  Each of 2^``BIN_BITS`` functions h_i(x) = (h(x) - i / 2^``BIN_BITS``) mod 1 selects the two
minimal elements of the whole text; these are put back into text order, and the tuple is hashed.  Two texts share a
function's tuple when they share the same minimal k-mers in the same order, so the share of equal tuples falls with
the edit distance and with moved passages, which a set of k-mers would not notice.

The functions are turns of one circle of hashes: the two minimal elements of h_i are the first two met from i on.  So
one sort serves all functions, and a text with few k-mers has full tuples too; a text with one has it twice.

Every step is linear in the text, apart from two sorts of primitive arrays: k-mer hashes carry their position in the
low bits; sorting brings occurrences of a k-mer together in text order, which numbers them; a second sort
puts the elements around the circle, of which the first two of every arc are kept.

Each document's "next" is found in an order by id without a single-task window: ids are cut into ranges at approximate
percentiles, a range is one window partition, and each range also holds, as a last extra row, the first
document of the range that follows.

Defined cases: null text is empty; a text without tokens has an empty signature, and two such texts have likeness 1,
one such text 0; tokens from number 2^``POS_BITS`` on share a position; equal ids are ordered by text; null ids
come last; a single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import common

RUN, K, BIN_BITS = 16, 2, 6
POS_BITS = 26
#: Rows of one range of ids, and the most ranges (from 100 million documents on, ranges hold more rows).
RANGE_ROWS, RANGES = 800, 1 << 17


def add_signature(df: DataFrame, text: str, out: str, run: int = RUN, k: int = K, bin_bits: int = BIN_BITS) -> DataFrame:
    """``df`` and ``out``: for every function (function << 32 | tuple hash), in order; empty without tokens."""
    low, half = (1 << POS_BITS) - 1, 1 << (bin_bits - 1)
    arc = f"cast(shiftright({{}}, {64 - bin_bits}) as int)"  # -half .. half - 1, in the order of the sort
    element = f"((xxhash64(shiftright({{x}}, {POS_BITS}), {{j}}) & {~low}L) | ({{x}} & {low}L))"
    t, s, f, p, q, b, g = (f"{out}_{c}" for c in "tsfpqbg")
    ahead = ", ".join(f"get({t}, i + {d})" for d in range(1, k))
    space = r"[^ \\t\\n\\x0B\\f\\r]"
    of = f"shiftright({{}}, {POS_BITS})"
    pair = (f"if(({{a}} & {low}L) <= ({{b}} & {low}L), xxhash64({of.format('{a}')}, {of.format('{b}')}), "
            f"xxhash64({of.format('{b}')}, {of.format('{a}')})) & {(1 << 32) - 1}L").format
    entry = f"shiftleft(cast(c + {half} as bigint), 32) | {{}}"
    last = f"try_element_at({g}, -1).c"
    steps = [
        (t, f"regexp_extract_all({text}, '(?<!{space}){space}{{1,{run}}}(?!{space})|{space}', 0)"),
        (s, f"sort_array(transform({t}, (x, i) -> (xxhash64({', '.join(['x', ahead] if ahead else ['x'])}) & {~low}L)"
            f" | cast(least(i, {low}) as bigint)))"),
        # first place of each k-mer in the sorted array
        (f, f"if(size({s}) = 0, cast(array() as array<int>), filter(sequence(0, size({s}) - 1), i -> i = 0 or "
            f"{of.format(f'get({s}, i)')} != {of.format(f'get({s}, i - 1)')}))"),
        # elements: first occurrences, then later ones with their number
        (p, f"concat(transform({f}, i -> {element.format(x=f'coalesce(get({s}, i), 0L)', j='0')}), "
            f"flatten(transform(filter(transform({f}, (i, r) -> struct(i as i, coalesce(get({f}, r + 1), size({s})) - i as n)), "
            f"v -> v.n > 1), v -> transform(sequence(1, v.n - 1), j -> "
            f"{element.format(x=f'coalesce(get({s}, v.i + j), 0L)', j='j')}))))"),
        (q, f"sort_array({p})"),
        # the first two of every arc, around the circle
        (b, f"filter({q}, (x, i) -> i < 2 or {arc.format('x')} != {arc.format(f'get({q}, i - 2)')})"),
        # an arc's first element with the one after it: the tuple of the functions that meet it first
        (g, f"transform(filter(transform({b}, (x, i) -> struct(x as x, i as i)), v -> v.i = 0 or {arc.format('v.x')} != "
            f"{arc.format(f'get({b}, v.i - 1)')}), v -> struct({arc.format('v.x')} as c, "
            f"{pair(a='v.x', b=f'get({b}, (v.i + 1) % size({b}))')} as h))"),
        (out, f"if(size({g}) = 0, cast(array() as array<bigint>), concat(flatten(transform({g}, (v, r) -> transform(sequence("
              f"if(r = 0, {-half}, get({g}, r - 1).c + 1), v.c), c -> {entry.format('v.h')}))), "
              f"if({last} = {half - 1}, cast(array() as array<bigint>), transform(sequence({last} + 1, {half - 1}), "
              f"c -> {entry.format(f'get({g}, 0).h')}))))"),
    ]
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df.drop(t, s, f, p, q, b, g)


def as_string(signature: str) -> str:
    """SQL: a signature as hexadecimal text, eight digits a function."""
    return f"array_join(transform({signature}, x -> lpad(lower(hex(x & {(1 << 32) - 1}L)), 8, '0')), '')"


def likeness(a: str, b: str) -> str:
    """SQL: share of the functions whose tuples are equal."""
    return f"if(size({a}) + size({b}) = 0, 1.0D, size(array_intersect({a}, {b})) / cast(greatest(size({a}), size({b})) as double))"


def range_of(bounds: list, kind: T.DataType) -> Column:
    """How many of ``bounds`` (descending) lie above the id; all of them for a null id.

    Found in two steps of about the square root of their number: whole blocks first, then within the next block."""
    width = max(1, math.isqrt(len(bounds)))
    values = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs]) if xs else F.array().cast(T.ArrayType(kind))
    above = lambda xs: F.size(F.filter(xs, lambda x: x > F.col("doc_id")))
    blocks = above(values(bounds[width - 1::width]))
    inside = above(F.slice(values(bounds), blocks * width + 1, F.lit(width)))
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(blocks * width + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``range``, ``ghost`` and the next document's text (null for the ghost rows).

    Ghost rows stand, last in their range, for the next range's first document."""
    n = docs.count()
    ranges = max(1, min(RANGES, -(-n // RANGE_ROWS)))
    shares = ", ".join(f"{i / ranges:.8f}" for i in range(1, ranges)) or "0.5"
    bounds = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {20 * ranges})").alias("b")).first()["b"] or []
    ranged = docs.withColumn("range", range_of(sorted(set(bounds), reverse=True), docs.schema["doc_id"].dataType))
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head"))  # one row a range
    order = Window.orderBy("range")
    heads = heads.select("head", F.coalesce(F.lag("range").over(order), F.max("range").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    firsts = (docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))  # at most RANGES ids
              .groupBy("before").agg(F.max(F.struct("doc_id", "text")).alias("d"))
              .select("d.doc_id", "d.text", F.col("before").alias("range"), F.lit(1).alias("ghost")))
    rows = ranged.withColumn("ghost", F.lit(0)).unionByName(firsts)
    return rows.withColumn("next_text", F.lead("text").over(in_order()))


def in_order():
    return Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("text"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr(
        "concat(left(text, cast(n_chars - n_chars div 2 as int)), left(coalesce(next_text, ''), cast(n_chars div 2 as int)))"))
    rows = add_signature(add_signature(rows, "text", "own"), "edited", "other")
    rows = rows.withColumn("next", F.lead("own").over(in_order())).where("ghost = 0")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.expr(as_string("own")).alias("fingerprint"), F.expr(as_string("other")).alias("edited_fingerprint"),
                       F.expr(likeness("own", "other")).alias("near_edited"),
                       F.expr(likeness("own", "next")).alias("near_next"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprint of every document and of its edited text."""
    return fingerprint_documents(common.table(spark, sf_dir, "documents", "doc_id", "text"))
