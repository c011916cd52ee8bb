"""Column-expression helpers (JVM-side, whole-stage-codegen friendly)."""

from regimen.functions.exprs import (
    as_col,
    blank_to_null,
    bround_col,
    clip_non_negative,
    hash_key,
    lex_le,
    md5_uniform,
    nan_to_null,
    std_normal,
)

__all__ = [
    "as_col", "blank_to_null", "bround_col", "clip_non_negative", "hash_key",
    "lex_le", "md5_uniform", "nan_to_null", "std_normal",
]
