"""Complex numbers as (re, im) column pairs; no user-defined type, so codegen stays on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cmul(ar, ai, br, bi) -> tuple[Column, Column]:
    """(ar + i ai)(br + i bi)."""
    ar, ai, br, bi = (F.col(c) if isinstance(c, str) else c for c in (ar, ai, br, bi))
    return ar * br - ai * bi, ar * bi + ai * br


def cmul_conj(ar, ai, br, bi) -> tuple[Column, Column]:
    """(ar + i ai) times the conjugate of (br + i bi)."""
    ar, ai, br, bi = (F.col(c) if isinstance(c, str) else c for c in (ar, ai, br, bi))
    return ar * br + ai * bi, ai * br - ar * bi


def cdiv(ar, ai, br, bi) -> tuple[Column, Column]:
    """Quotient; null where the divisor is zero."""
    n = cabs2(br, bi)
    re, im = cmul_conj(ar, ai, br, bi)
    return F.try_divide(re, n), F.try_divide(im, n)


def cabs2(re, im) -> Column:
    re, im = (F.col(c) if isinstance(c, str) else c for c in (re, im))
    return re * re + im * im


def cabs(re, im) -> Column:
    return F.sqrt(cabs2(re, im))


def carg(re, im) -> Column:
    return F.atan2(im, re)
