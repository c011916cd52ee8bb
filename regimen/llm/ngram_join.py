"""Operator 11: n-gram Jaccard self-join as a blocked sparse matrix product.

Rows of the incidence matrix are documents' sets of distinct word shingles, columns are shingles
(64-bit hashes).  Two documents link when 100 * |x & y| >= percent * |x | y|.

Documents with equal sets are one row (a class) from the start.  Size-derived bounds then thin the matrix, without
losing a link.  With n shingles, a document can lack at most n - ceil(percent * n / 100) of them in any
partner, so:

1. a row with more columns of its own (held by no other class) than that has no link.  Such columns know their only
   row, so one count by column and one by row find them, over a quarter of the columns (by hash): first of all
   rows, then of those that are left;
2. linked rows share one of their first n - ceil(percent * n / 100) + 1 columns, rarest first.  Rows that
   meet in such a column, directly or through others, form a group; rows of different groups have no link;
3. each group's product is computed in blocks of about ``BLOCK_ROWS`` rows (and ``BLOCK_CELLS`` cells): every pair of
   blocks is one unit of work.  A large, loose group is multiplied by single columns instead where that repeats
   fewer rows;
4. within a unit, a row's overlaps with all smaller ones accumulate over its columns; those whose sizes
   cannot reach the bound are left out, and the exact count decides.  A unit hands on links that connect what
   all its links connect, at most one a row, so a large group of near copies never becomes a table of pairs.

Defined cases: texts without words (null, empty) have an empty set and link with nothing; fewer words than the shingle
length are one shingle of all of them; repeated rows and shared ids are kept as rows; null ids are carried
but name a component only if all of it has none; other columns are ignored; an empty table gives an empty
result.  A-Z are lower-cased; words end at ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.llm import common
from regimen.llm.collocations import bitmap
from regimen.llm.components import connect
from regimen.llm.decontaminate import Words, has

WIDTH, PERCENT = 3, 90
#: One column in so many takes part in the thinning.
SAMPLED = 4
#: log2 of the bits of the bitmap of rows that are left (4 MB); further rows only pass on to an exact join.
BITMAP_LOG2 = 25
BLOCK_ROWS, BLOCK_CELLS = 1 << 10, 1 << 20


class SpacedWords(Words):
    """Words between ASCII white space."""

    def __init__(self):
        super().__init__()
        self.word = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text's word hashes."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.full(n, np.uint64(min(len(words), width)))
    for i in range(min(len(words), width)):
        out = common.mix64(out * np.uint64(common.BASE) + words[i:i + n])
    return np.unique(out)


def set_id(cells: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    total = np.add.reduce(common.mix64(cells ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0), dtype=np.uint64)
    return int(common.mix64(np.array([total + np.uint64(len(cells))], np.uint64)).view(np.int64)[0])


def document_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, cid, n, some): each row's set's name and size; the first row of a set in a task holds
    the sampled columns."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = source.select("doc_id").schema.add("cid", "long").add("n", "long").add("some", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, seen = SpacedWords(), set()
        for batch in batches:
            for i, j, words, bounds in scan.groups(batch.column(1)):
                cid, n, some = [], [], []
                for r in range(j - i):
                    cells = shingles(words[bounds[r]:bounds[r + 1]], width)
                    name = set_id(cells)
                    cid.append(name)
                    n.append(len(cells))
                    some.append(None if name in seen else cells[cells % np.uint64(SAMPLED) == 0].view(np.int64))
                    seen.add(name)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(cid, pa.int64()), pa.array(n, pa.int64()),
                                       pa.array(some, pa.list_(pa.int64()))], names=["doc_id", "cid", "n", "some"])

    return source.mapInArrow(run, schema)


def wanted_sets(docs: DataFrame, bits: np.ndarray, width: int, text_col: str) -> DataFrame:
    """(cid, n, cells): the sets that ``bits`` does not rule out, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, seen = SpacedWords(), set()
        for batch in batches:
            for i, j, words, bounds in scan.groups(batch.column(0)):
                found = []
                for r in range(j - i):
                    cells = shingles(words[bounds[r]:bounds[r + 1]], width)
                    name = set_id(cells)
                    if name not in seen and has(shared.value, np.array([name]).view(np.uint64))[0]:
                        found.append((name, cells))
                        seen.add(name)
                if found:
                    yield pa.record_batch([pa.array([c for c, _ in found], pa.int64()),
                                           pa.array([len(x) for _, x in found], pa.int64()),
                                           pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64()))],
                                          names=["cid", "n", "cells"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cid long, n long, cells array<bigint>")


def needed(percent: int, n: str = "n") -> Column:
    """The least overlap of a set of n with any partner."""
    return F.expr(f"({percent} * {n} + 99) div 100")


def own_columns(incidence: DataFrame) -> DataFrame:
    """(cid, own): how many columns of each row of ``incidence`` (h, cid) no other row has."""
    columns = incidence.groupBy("h").agg(F.min("cid").alias("cid"), F.max("cid").alias("other"))
    return columns.where("cid = other").groupBy("cid").agg(F.count("*").alias("own"))


def linkable(rows: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The rows of ``rows`` (cid, n) with few enough columns of their own."""
    allowed = F.col("n") - needed(percent)
    return rows.join(own, "cid", "left").where(F.coalesce("own", F.lit(0)) <= allowed).drop("own")


def first_columns(sets: DataFrame, percent: int) -> DataFrame:
    """(h, cid, n): of each row's rarest columns, as many as linked rows must meet in, those that several rows hold."""
    cells = sets.select("cid", F.explode("cells").alias("h"))
    df = cells.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    row = Window.partitionBy("cid")
    place = F.row_number().over(row.orderBy("df", "h"))
    ranked = cells.join(df, "h").withColumns({"place": place, "several": F.count("*").over(row)})
    # place - several <= 1 - needed, so that rows' own columns come first
    return ranked.join(sets.select("cid", "n"), "cid").where(
        F.col("place") - F.col("several") <= 1 - needed(percent)).select("h", "cid", "n")


def work_units(entries: DataFrame, block_rows: int, block_cells: int) -> DataFrame:
    """(unit, cid, side): rows of every pair of blocks; a pair of different blocks has sides 0 and 1, a block
    with itself side 2."""
    low = entries.groupBy("h").agg(F.min("cid").alias("low"))
    edges = entries.join(low, "h").select(F.col("cid").alias("u"), F.col("low").alias("v")).distinct()
    roots = connect(edges).withColumnRenamed("node", "cid")
    member = common.write_shared(entries.join(roots, "cid"))
    rows = member.select("root", "cid", "n").distinct()

    def blocks(count: str, cells: str) -> Column:
        return F.greatest(F.ceil(F.col(count) / block_rows), F.ceil(F.col(cells) / block_cells))

    groups = (rows.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("cells"))
              .withColumn("blocks", blocks("rows", "cells")))
    columns = (member.groupBy("h").agg(F.first("root").alias("root"), F.count("*").alias("rows"), F.sum("n").alias("cells"))
               .withColumn("blocks", blocks("rows", "cells")))  # all rows of a column are in one group
    by_column = columns.groupBy("root").agg(F.sum(F.col("rows") * F.col("blocks")).alias("repeated"))
    groups = groups.join(by_column, "root").withColumn("whole", F.col("rows") * F.col("blocks") <= F.col("repeated"))
    whole = rows.join(groups.where("whole").select("root", "blocks"), "root").select(
        F.xxhash64("root", F.lit(0)).alias("of"), "cid", "blocks")
    alone = columns.join(groups.where("not whole").select("root"), "root").select("h", "blocks")
    single = member.join(alone, "h").select(F.xxhash64("h", F.lit(1)).alias("of"), "cid", "blocks")
    each = whole.union(single).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")))
    each = each.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
    unit = F.xxhash64("of", F.least("own", "with"), F.greatest("own", "with"))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    return each.select(unit.alias("unit"), "cid", side.alias("side"))


def unit_links(cid: np.ndarray, side: np.ndarray, cells: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links of one unit connect: the rows' product, row by row."""
    size = np.array([len(c) for c in cells])
    order = np.argsort(size, kind="stable")
    cid, side, size, cells = cid[order], side[order], size[order], [cells[i] for i in order]
    flat = np.concatenate(cells)
    column, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(cells)), size)
    shared = count[column] > 1
    column, row = column[shared], row[shared]
    by_column = np.argsort(column, kind="stable")
    posting = row[by_column]
    start = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(count)))])
    own = np.searchsorted(row, np.arange(len(cells) + 1))
    label, out = np.arange(len(cells)), []
    for x in range(1, len(cells)):
        least = int(np.searchsorted(100 * size, percent * size[x]))  # smaller ones cannot reach the bound
        mine = column[own[x]:own[x + 1]]
        if least >= x or not len(mine):
            continue
        first, many = start[mine], start[mine + 1] - start[mine]
        at = np.arange(many.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        others = posting[at]
        overlap = np.bincount(others[(others >= least) & (others < x)] - least, minlength=x - least)
        found = (100 + percent) * overlap >= percent * (size[x] + size[least:x])
        found &= (side[x] == 2) | (side[least:x] != side[x])
        for y in np.unique(label[least + np.flatnonzero(found)]).tolist():  # one link for each component met
            if y != label[x]:
                z = least + int(np.flatnonzero(found & (label[least:x] == y))[0])
                out.append((int(cid[x]), int(cid[z])))
        joined = np.unique(label[least + np.flatnonzero(found)])
        if len(joined):
            label[np.isin(label, np.append(joined, label[x]))] = min(int(joined[0]), int(label[x]))
    return out


def links(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between rows, from the product of every unit."""
    rows = units.join(sets.select("cid", "cells"), "cid").select("unit", "cid", "side", "cells")
    ordered = rows.repartition("unit").sortWithinPartitions("unit", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def product():
            if len(held) < 2:
                return None
            found = unit_links(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], percent)
            return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                                   names=["u", "v"]) if found else None

        for batch in chain(batches, [None]):
            names = batch.column(0).to_numpy() if batch is not None else np.array([0])
            for r, name in enumerate(names.tolist()):
                if batch is None or name != unit:
                    out = product()
                    if out is not None:
                        yield out
                    unit, held = name, []
                if batch is not None:
                    held.append((batch.column(1)[r].as_py(), batch.column(2)[r].as_py(),
                                 batch.column(3)[r].values.to_numpy().copy()))

    return ordered.mapInArrow(run, "u long, v long").distinct()


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                 block_rows: int = BLOCK_ROWS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: set size and the smallest id that links reach."""
    if not 50 <= percent <= 100:
        raise ValueError("percent lies between 50 and 100")
    rows = common.write_shared(document_sets(docs, width, id_col, text_col))
    classes = rows.groupBy("cid").agg(F.first("n").alias("n"), F.min("doc_id").alias("low_id"))
    # a set links with another one only if one shingle more or less keeps the share
    able = classes.where(f"n > 0 and 100 * n >= {percent} * (n + 1)").select("cid", "n")
    left = linkable(able, own_columns(rows.select("cid", F.explode("some").alias("h"))), percent)
    bits = bitmap(left.select("cid"), BITMAP_LOG2)
    sets = wanted_sets(docs, bits, width, text_col).dropDuplicates(["cid"]).join(left.select("cid"), "cid", "left_semi")
    sets = common.write_shared(sets)
    again = own_columns(sets.select("cid", F.explode("cells").alias("h")).where(f"pmod(h, {SAMPLED}) = 0"))
    sets = common.write_shared(linkable(sets, again, percent))
    entries = common.write_shared(first_columns(sets, percent))
    found = links(work_units(entries, block_rows, block_cells), sets, percent)
    roots = connect(found).withColumnRenamed("node", "cid")
    named = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = common.write_shared(named)
    names = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    members = named.join(names, "root").select("cid", "component_id")
    alone = F.col("n") == 0
    return rows.drop("some").join(members, "cid").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join(common.table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') as ws
  from documents),
s as materialized (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as g
  from w),
n as materialized (select doc_id, count(*) as n from s group by all),
o as (
  select a.doc_id as u, b.doc_id as v, count(*) as shared
  from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as materialized (
  select u, v from o join n x on x.doc_id = u join n y on y.doc_id = v where 100 * shared >= 90 * (x.n + y.n - shared)),
r(u, v) as (select u, v from e union select r.u, e.v from r join e on e.u = r.v),
c as (select u, min(v) as low from r group by u)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) as component_id
from w left join n using (doc_id) left join c on c.u = w.doc_id
"""
