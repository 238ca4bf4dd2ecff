"""Scalar column functions.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.  Spark 4 runs in ANSI mode: division by
zero, out-of-range array access and casts of bad strings raise, so the
helpers use ``try_divide`` / ``get`` where the data can hit those cases.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_frame(t, first=0.0, tr: float = 1.5) -> Column:
    """Seconds to frame index: ``floor((first + t) / tr)`` as INT.

    Floor, not truncation: -0.4 s maps to frame -1, as numpy floor division
    does.
    """
    first_c = first if isinstance(first, Column) else F.lit(float(first))
    return F.floor((first_c + _c(t)) / F.lit(float(tr))).cast("int")


def nan_to_null(c) -> Column:
    """NaN becomes NULL so that ``avg``/``stddev`` skip it (numpy ``nan*``)."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def nan_to_zero(c) -> Column:
    """NaN and NULL become 0.0."""
    return F.coalesce(nan_to_null(c), F.lit(0.0))


def subject_code(c, sep: str = "-") -> Column:
    """Second part of an id such as ``sub-001``; NULL if the separator is absent."""
    return F.get(F.split(_c(c), re.escape(sep)), F.lit(1))


def replace_token(c, old: str, new: str) -> Column:
    c = _c(c)
    return F.when(c == F.lit(old), F.lit(new)).otherwise(c)


def masked_value(d, base, threshold: float) -> Column:
    """``d`` where ``|base| > threshold``, else 0.0."""
    return F.when(F.abs(_c(base)) > F.lit(threshold), _c(d)).otherwise(F.lit(0.0))


def signed_root(r2) -> Column:
    """``sqrt(|r2|) * sign(r2)``: a signed correlation-like score from R^2."""
    r2 = _c(r2)
    return F.sqrt(F.abs(r2)) * F.signum(r2)


def tokens(text) -> Column:
    """Whitespace tokens of a text (runs of whitespace are one separator)."""
    return F.split(F.trim(_c(text)), r"\s+")


def hash_unit(word, j) -> Column:
    """Deterministic pseudo-random value in [-1, 1] for (word, dimension j).

    First 8 hex digits of ``md5(word || '#' || j)`` read as an unsigned
    integer ``h``; value ``(h % 2001 - 1000) / 1000``.  DuckDB computes the
    same number, so it serves as an engine-independent stand-in model.
    """
    j = j if isinstance(j, Column) else F.lit(j)
    h = F.conv(F.substring(F.md5(F.concat(_c(word), F.lit("#"), j.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(2001) - F.lit(1000)).cast("double") / F.lit(1000.0)

