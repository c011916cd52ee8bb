"""Scalar building blocks shared by the operators.

All helpers return ``Column`` expressions so that they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A 13-hex-digit md5 prefix is an integer in [0, 16**13); adding
# one and dividing by 16**13 + 1 maps it into the open interval (0, 1).
MD5_PREFIX_DIGITS = 13
MD5_UNIFORM_DENOMINATOR = 4503599627370497.0  # 16**13 + 1


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(*parts: str | Column) -> Column:
    """``md5(concat_ws('-', parts...))`` -- a 32-hex-digit order/sampling key."""
    return F.md5(F.concat_ws("-", *[as_col(p).cast("string") for p in parts]))


def _uniform_from(digest: Column, start: int) -> Column:
    """13 hex digits of ``digest`` from ``start`` (1-based) -> (0, 1)."""
    as_int = F.conv(F.substring(digest, start, MD5_PREFIX_DIGITS), 16, 10).cast("bigint")
    return (as_int + F.lit(1)).cast("double") / F.lit(MD5_UNIFORM_DENOMINATOR)


def md5_uniform(*parts: str | Column) -> Column:
    """Deterministic uniform draw in (0, 1) keyed by ``parts``.

    Same formula as SQL ``(cast(conv(substr(md5(k),1,13),16,10) as bigint)+1)
    / 4503599627370497`` so any SQL engine with md5 reproduces it.
    """
    return _uniform_from(hash_key(*parts), 1)


def std_normal(*parts: str | Column) -> Column:
    """Standard normal draw by Box-Muller on the two uniforms held by ONE md5
    of ``parts`` (hex digits 1-13 and 14-26), so a draw costs one hash."""
    digest = hash_key(*parts)
    u1, u2 = _uniform_from(digest, 1), _uniform_from(digest, 1 + MD5_PREFIX_DIGITS)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL (SQL aggregates treat NaN as a value, NULL is skipped)."""
    col = as_col(c).cast("double")
    return F.nanvl(col, F.lit(None).cast("double"))


def blank_to_null(c: str | Column, markers: Sequence[str] = ("", "/")) -> Column:
    """Trimmed text that is empty or a missing-value marker -> NULL."""
    t = F.trim(as_col(c))
    return F.when(t.isin(*markers), F.lit(None).cast("string")).otherwise(t)


def clip_non_negative(c: str | Column) -> Column:
    """``max(y, 0)`` that keeps NULL as NULL (``greatest`` would skip it)."""
    col = as_col(c)
    return F.when(col.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(col, F.lit(0.0)))


def bround_col(c: str | Column, scale: int = 5) -> Column:
    """Half-even rounding (Python's ``round``)."""
    return F.bround(as_col(c), scale)


def lex_le(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Lexicographic ``left <= right`` over equally long key tuples."""
    assert len(left) == len(right) and left
    expr = left[-1] <= right[-1]
    for lc, rc in zip(reversed(left[:-1]), reversed(right[:-1])):
        expr = (lc < rc) | ((lc == rc) & expr)
    return expr


#: What a number looks like: a decimal, or infinity.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def number(token: Column) -> Column:
    """A decimal number or infinity as double; NaN and anything else (also the
    suffixes and hexadecimals that a SQL cast allows, as in ``1.0d``) -> NULL.

    Only tokens with other characters than a decimal's meet the regular expression."""
    value = token.try_cast("double")
    plain = F.translate(token, "0123456789+-.eE", "") == F.lit("")
    return F.when(plain, value).otherwise(F.when(token.rlike(NUMBER), value))
