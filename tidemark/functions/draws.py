"""Random draws as hashes of counters: the same on any cluster, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13  # hexadecimal digits of a uniform draw: 52 bits


def _hash(counters: tuple, seed: int) -> Column:
    return F.md5(F.concat_ws(",", *[c.cast("string") for c in counters], F.lit(str(seed))))


def _unit(h: Column, first: int) -> Column:
    return (F.conv(F.substring(h, first, DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 4 * DIGITS)


def uniform_draw(*counters: Column, seed: int = 0) -> Column:
    """A value between 0 and 1 for each combination of counters."""
    return _unit(_hash(counters, seed), 1)


def normal_draw(*counters: Column, seed: int = 0) -> Column:
    """A standard normal value for each combination of counters: Box-Muller over the two halves of one hash."""
    h = _hash(counters, seed)
    return F.sqrt(-2 * F.ln(_unit(h, 1))) * F.cos(2 * math.pi * _unit(h, 1 + DIGITS))


def _unit_sql(h: str, first: int) -> str:
    return f"((CAST('0x' || substr({h}, {first}, {DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {1 << 4 * DIGITS}::DOUBLE)"


def normal_sql(*counters: str, seed: int = 0) -> str:
    """normal_draw in DuckDB's SQL."""
    h = f"md5(concat_ws(',', {', '.join(counters)}, '{seed}'))"
    return f"(sqrt(-2 * ln({_unit_sql(h, 1)})) * cos(2 * pi() * {_unit_sql(h, 1 + DIGITS)}))"
