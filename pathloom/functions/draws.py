"""Reproducible draws: hashes of a seed, a draw and a step, equal in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int, digits: int = 8) -> Column:
    """A long in [0, 16^digits) from the parts."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def below(n: Column, *parts: Column | str | int) -> Column:
    """A long in [0, n): by 32 bits of the hash for n up to 2^20, by 60 beyond, so that no draw is noticeably likelier."""
    n = n.cast("long")
    return F.when(n <= 1 << 20, F.shiftright(uniform(*parts) * n, 32)).otherwise(F.pmod(uniform(*parts, digits=15), n))
