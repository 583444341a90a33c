"""The normal distribution in columns. Spark has no error function: a polynomial stands in, right to about 1e-7."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Abramowitz and Stegun, 7.1.26.
P = 0.3275911
A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cumulative(x: Column) -> Column:
    """Probability of a value below x."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + P * z)
    poly = F.lit(0.0)
    for a in reversed(A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def cumulative_of(x: np.ndarray) -> np.ndarray:
    """The same polynomial of an array."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + P * z)
    poly = np.zeros_like(t)
    for a in reversed(A):
        poly = (poly + a) * t
    erf = 1 - poly * np.exp(-z * z)
    return np.where(x >= 0, (1 + erf) / 2, (1 - erf) / 2)


def cumulative_sql(x: str) -> str:
    """The same polynomial as SQL text."""
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1 / (1 + {P} * {z}))"
    poly = "0.0"
    for a in reversed(A):
        poly = f"(({poly} + ({a})) * {t})"
    erf = f"(1 - {poly} * exp(-{z} * {z}))"
    return f"(CASE WHEN {x} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"
