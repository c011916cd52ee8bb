"""Annotated measurement text files.

Layout: free-text preamble, a sentinel line, then tab-separated rows.
Parsing is column expressions over lines: from files of any size (split over
tasks, :func:`read_annotated_text`) or from a DataFrame whose rows hold whole
texts (:func:`parse_annotated_text`): keep what follows the sentinel line,
strip, drop blanks, split on tab, parse numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.functions.exprs import number
from regimen.sources.tables import scan_position, with_line_numbers

# The data sentinel, the missing-value markers and the column
# layout of the measurement table (10 composition, 5 environment, 1 label).
SENTINEL = "---Under is the data---"
MISSING_MARKERS = ("", "/")
MEASUREMENT_COLUMNS = ["Al", "Zn", "Mg", "Cu", "Si", "Fe", "Mn", "Cr", "Ti", "Other",
                       "Time", "Temperature", "Rainfall", "pH", "Cl", "Corrosion_Rate"]
# Characters a whitespace strip removes at both ends of a line.
STRIP_CHARS = " \t\r\n\x0b\x0c"
LINE_BREAK = r"\r\n|\r|\n"
NOT_A_NUMBER = r"^[+-]?[nN][aA][nN]$"

def data_body(text: Column, sentinel: str = SENTINEL) -> Column:
    """Text after the first line containing ``sentinel``; no sentinel -> all."""
    at = F.instr(text, sentinel)
    rest = F.substring(text, at + F.lit(len(sentinel)), F.lit(2 ** 31 - 1))
    after_line = F.regexp_replace(rest, r"^[^\r\n]*(\r\n|\r|\n)?", "")
    return F.when(at > 0, after_line).otherwise(text)


def strip_line(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIP_CHARS))


def drop_blank_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Keep lines that are not blank after stripping."""
    return lines.where(F.length(strip_line(F.col(line_col))) > 0)


def marker_to_null(c: Column, markers: Sequence[str] = MISSING_MARKERS) -> Column:
    """A stripped token that is empty or a marker -> NULL."""
    t = strip_line(c)
    return F.when(t.isin(*markers), F.lit(None).cast("string")).otherwise(t)


def parse_annotated_text(docs: DataFrame, columns: Sequence[str] = MEASUREMENT_COLUMNS,
                         text_col: str = "text", key_cols: Sequence[str] = (), mode: str = "strict",
                         pad_missing_label: bool = True, sentinel: str = SENTINEL,
                         column_map: dict[str, str] | None = None) -> DataFrame:
    """One output row per non-blank data line.

    ``mode='strict'``: a token that is not a number, or a row whose width is
    not ``len(columns)``, fails the job (``raise_error``).
    ``mode='lenient'``: bad numbers -> NULL; a row one field short is padded
    with a missing label when ``pad_missing_label``; any other width keeps
    its parsed prefix and the raw line in ``_corrupt_record`` (S2b).
    ``column_map`` (column -> the column of the layout whose field holds it) puts right a file whose fields are not
    in the layout's order, such as a rotated one; columns that it does not name stay.
    Output: ``key_cols..., line_no, columns...[, _corrupt_record]``.
    """
    lines = docs.select(*key_cols, F.posexplode(F.split(data_body(F.col(text_col), sentinel), LINE_BREAK))
                        .alias("line_no", "line"))
    return mapped(parse_lines(lines, columns, key_cols, mode, pad_missing_label), columns, column_map)


def mapped(rows: DataFrame, columns: Sequence[str], column_map: dict[str, str] | None) -> DataFrame:
    """``rows`` with each column of ``column_map`` taken from the field that it names."""
    unknown = {*(column_map or {}), *(column_map or {}).values()} - {*columns}
    if unknown:
        raise ValueError(f"no column {', '.join(sorted(unknown))} in the layout")
    return rows.select(*[F.col((column_map or {}).get(c, c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def parse_lines(lines: DataFrame, columns: Sequence[str], key_cols: Sequence[str], mode: str,
                pad_missing_label: bool) -> DataFrame:
    """The rows of :func:`parse_annotated_text` from data lines (``key_cols..., line_no, line``)."""
    width = len(columns)
    lines = drop_blank_lines(lines).withColumn("_fields", F.split(strip_line(F.col("line")), "\t"))
    n = F.size(F.col("_fields"))
    allowed = (n == width) | ((n == width - 1) & F.lit(pad_missing_label and mode == "lenient"))
    values = []
    for i, c in enumerate(columns):
        tok = marker_to_null(F.get(F.col("_fields"), i))
        num = number(tok)
        if mode == "strict":
            bad = tok.isNotNull() & num.isNull() & ~tok.rlike(NOT_A_NUMBER)
            num = F.when(bad, F.raise_error(F.concat(F.lit(f"not a number in column {c}: "), tok))) \
                .otherwise(num).cast("double")
        values.append(num.alias(c))
    if mode == "strict":
        check = F.when(~allowed, F.raise_error(F.concat(F.lit(f"expected {width} fields, got "),
                                                        n.cast("string"))))
        return lines.where(check.isNull()).select(*key_cols, "line_no", *values)
    corrupt = F.when(~allowed, F.col("line")).alias("_corrupt_record")
    return lines.select(*key_cols, "line_no", *values, corrupt)


def read_annotated_text(spark: SparkSession, path: str, columns: Sequence[str] = MEASUREMENT_COLUMNS,
                        mode: str = "strict", pad_missing_label: bool = True, sentinel: str = SENTINEL,
                        column_map: dict[str, str] | None = None) -> DataFrame:
    """A file or directory of annotated text files of any size, read line by line.

    Large files split over tasks; ``line_no`` is the exact 0-based line of the
    file.  Each file's data begin after its first line with the sentinel, or
    at its first line if it has none.  No other line is skipped: a comment
    among the data is a bad row."""
    raw = spark.read.text(path).select(*scan_position(), F.col("value").alias("line"))
    lines = with_line_numbers(raw)
    first = lines.where(F.contains(F.col("line"), F.lit(sentinel))).groupBy("source_file").agg(
        F.min("line_no").alias("_mark"))
    # a line of the preamble becomes missing rather than filtered: no check of a data line may run before the join
    data = lines.join(first, "source_file", "left").withColumn(
        "line", F.when(F.col("_mark").isNull() | (F.col("line_no") > F.col("_mark")), F.col("line")))
    rows = parse_lines(data.drop("_mark"), columns, ["source_file"], mode, pad_missing_label)
    return mapped(rows, columns, column_map)
