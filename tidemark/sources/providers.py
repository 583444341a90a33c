"""Sources of bars by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.bars import segment_bars, tick_bars, weekly_bars

PROVIDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"weekly": weekly_bars, "segments": segment_bars, "ticks": tick_bars}


def provider(name: str = "weekly") -> Callable[[SparkSession, str], DataFrame]:
    """The reader of that name, whatever its case; an unknown one is refused with the names that there are."""
    key = name.strip().lower()
    if key not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[key]
