"""Long histories in blocks: windows, running values and recurrences over any number of rows of one ticker.

A window by ticker puts a ticker into one task. Here its rows are numbered, side by side in periods of the calendar, and
cut into blocks of `size` rows that are worked on side by side:

- framed: each block also gets the rows just before (and after) it that frames of ROWS reach, so windows by block give
  what windows by ticker give;
- running: sums, products, extremes and last values within a block, joined with those of the blocks before it;
- scanned: what depends on the row before. A block is summed up as a map from the state it is entered in to the state it
  is left in; the maps of a ticker, one for each block, are applied in turn, and each block runs again from its own state.

Between blocks pass only their counts, values and maps: rows / size of them for a ticker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.windows import parted_by

SIZE = 1 << 16  # rows of a block
DAYS = 3653  # of a period in which rows are numbered
BLOCK = ("_key", "_block")

#: how a running value of a block goes together with that of the blocks before it; either may be missing
JOINS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "product": (F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def numbered(rows: DataFrame, *, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """rows with _pos (from 0, by date within a ticker), _block (_pos div size) and _key (the ticker, never null).

    Rows without a date come first; rows of one date in any order. The join is by ticker and period, as the numbering is.
    """
    period = F.coalesce(F.floor(F.unix_date(F.to_date("date")) / days).cast("int"), F.lit(-(1 << 31)))
    rows = rows.withColumns({"_key": F.struct("ticker"), "_period": period})
    counts = rows.groupBy("_key", "_period").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_key", "_period", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    own = F.row_number().over(Window.partitionBy("_key", "_period").orderBy("date")) - 1
    # a join that is dealt by ticker and period: a broadcast of few rows would leave all rows of a ticker in the task of its begins
    placed = rows.withColumn("_own", own).join(begins.hint("merge"), ["_key", "_period"]).withColumn("_pos", F.col("_begin") + F.col("_own"))
    return placed.withColumn("_block", F.floor(F.col("_pos") / size)).drop("_period", "_begin", "_own")


def _copies(rows: DataFrame, back: int, ahead: int, size: int) -> DataFrame:
    """Each row in the block that it is in, and in those whose first rows look `back` to it or whose last look `ahead` to it."""
    first = F.greatest(F.floor((F.col("_pos") - ahead) / size), F.lit(0))
    return rows.withColumn("_block", F.explode(F.sequence(first, F.floor((F.col("_pos") + back) / size))))


def _in_its_own(rows: DataFrame, size: int) -> DataFrame:
    return rows.filter(F.col("_block") == F.floor(F.col("_pos") / size))


def framed(rows: DataFrame, f: Callable[[DataFrame], DataFrame], *, back: int, ahead: int = 0, size: int = SIZE) -> DataFrame:
    """f(rows) of numbered rows, where the windows of f (by_date) look at most `back` rows back and `ahead` rows ahead."""
    with parted_by(*BLOCK):
        return _in_its_own(f(_copies(rows, back, ahead, size)), size)


def framed_groups(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, back: int, size: int = SIZE) -> DataFrame:
    """f of each block of numbered rows as a frame in the order of _pos, with the `back` rows before it. f adds columns to its
    frame; schema: those of its result that are kept."""
    names = StructType.fromDDL(schema).names

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values("_pos", ignore_index=True))
        return out.loc[out["_pos"] // size == out["_block"], names]

    return _copies(rows, back, 0, size).drop("_key").groupBy("ticker", "_block").applyInPandas(run, schema)


def running(rows: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """numbered rows with running values from a ticker's first row to each: {name: (sum, product, max, min or last, column)}.
    Nulls are passed over."""
    so_far = Window.partitionBy(*BLOCK).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals, carried, out = [], [], {}
    for name, (kind, column) in columns.items():
        function, join = JOINS[kind]
        total = F.max_by(column, F.when(column.isNotNull(), F.col("_pos"))) if kind == "last" else function(column)
        totals.append(total.alias(f"_t_{name}"))
        carried.append(function(F.col(f"_t_{name}")).over(before).alias(f"_c_{name}"))
        out[name] = join(F.col(f"_c_{name}"), function(column).over(so_far))
    carries = rows.groupBy(*BLOCK).agg(*totals).select(*BLOCK, *carried)
    return rows.join(carries.hint("shuffle_hash"), list(BLOCK)).withColumns(out).drop(*[f"_c_{name}" for name in columns])


def scanned(
    rows: DataFrame,
    schema: str,
    summary: Callable[[pd.DataFrame, bool], np.ndarray],
    step: Callable[[np.ndarray | None, np.ndarray], np.ndarray],
    apply: Callable[[pd.DataFrame, np.ndarray | None], pd.DataFrame],
) -> DataFrame:
    """apply(block, state) of each block of numbered rows, in the order of _pos, where state is what the block is entered in.

    summary(block, first): the map of a block as numbers; step(state, summary): the state after it. There is no state before
    a ticker's first block. schema: the columns of apply's result.
    """

    names = StructType.fromDDL(schema).names

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        numbers = summary(pdf.sort_values("_pos", ignore_index=True), block == 0)
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[:1], "_block": [block], "numbers": [numbers.tolist()]})

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, states = pdf.sort_values("_block", ignore_index=True), None, []
        for numbers in pdf["numbers"]:
            states.append(None if state is None else state.tolist())
            state = step(state, np.asarray(numbers, float))
        return pd.DataFrame({"ticker": pdf["ticker"], "_block": pdf["_block"], "state": states})

    def again(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        state = right["state"].iloc[0] if len(right) else None
        return apply(left.sort_values("_pos", ignore_index=True), None if state is None else np.asarray(state, float))[names]

    rows = rows.drop("_key")
    kind = rows.schema["ticker"].dataType.simpleString()
    maps = rows.groupBy("ticker", "_block").applyInPandas(summed, f"ticker {kind}, _block long, numbers array<double>")
    # one row for each block
    states = maps.groupBy("ticker").applyInPandas(entered, f"ticker {kind}, _block long, state array<double>")
    by_block = rows.groupBy("ticker", "_block"), states.groupBy("ticker", "_block")
    return by_block[0].cogroup(by_block[1]).applyInPandas(again, schema)


# --- recurrences ------------------------------------------------------------------------------------------------------


def _fade(x: np.ndarray, alpha: float, state: float | None) -> np.ndarray:
    """Exponential mean of x from a state, or from its first value. Missing values leave it as it is."""
    values = x if state is None else np.concatenate(([state], x))
    out = pd.Series(values).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
    return out if state is None else out[1:]


class Cascade:
    """Exponential means of a column, and of differences of two of them: {name: (source, alpha)}, source a column's name or
    a pair of names of means that come before. A state holds the last value of each mean."""

    def __init__(self, column: str, means: dict[str, tuple[str | tuple[str, str], float]]):
        self.column, self.means = column, means

    def run(self, x: np.ndarray, state: np.ndarray | None) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for i, (name, (source, alpha)) in enumerate(self.means.items()):
            values = x if isinstance(source, str) else out[source[0]] - out[source[1]]
            out[name] = _fade(values, alpha, None if state is None or np.isnan(state[i]) else state[i])
        return out

    def after(self, x: np.ndarray, state: np.ndarray | None) -> np.ndarray:
        return np.array([v[-1] for v in self.run(x, state).values()])

    def summary(self, pdf: pd.DataFrame, first: bool) -> np.ndarray:
        """The map of a block: it is affine, so what it makes of zero and of each unit state tells all of it. A first block, and
        one before which there was no value, leaves its own state: that is added."""
        x, size = pdf[self.column].to_numpy(float, na_value=np.nan), len(self.means)
        alone = self.after(x, None)
        if first:
            return np.concatenate([alone, np.zeros(size * (size + 1))])
        empty = np.where(np.isnan(x), np.nan, 0.0)
        shift = self.after(x, np.zeros(size))
        turns = [self.after(empty, unit) for unit in np.eye(size)]
        return np.concatenate([alone, shift, np.ravel(np.stack(turns, axis=1))])

    def step(self, state: np.ndarray | None, numbers: np.ndarray) -> np.ndarray:
        size = len(self.means)
        alone, shift, turn = numbers[:size], numbers[size : 2 * size], numbers[2 * size :].reshape(size, size)
        return alone if state is None or np.isnan(state).any() else turn @ state + shift


def exponential_means(rows: DataFrame, column: str, means: dict, more: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """numbered rows with the means of a Cascade; more(frame) finishes a block's frame to the columns of schema."""
    cascade = Cascade(column, means)

    def apply(pdf: pd.DataFrame, state: np.ndarray | None) -> pd.DataFrame:
        return more(pdf.assign(**cascade.run(pdf[column].to_numpy(float, na_value=np.nan), state)))

    return scanned(rows, schema, cascade.summary, cascade.step, apply)


class Moments:
    """Exponentially weighted mean and variance. A state: the mean, the variance and the values so far.

    A block of k values weighs 1 - (1 - alpha)^k against what was before; two groups with means m and variances v and weights
    p and 1 - p have mean p*m1 + (1-p)*m2 and variance p*v1 + (1-p)*v2 + p*(1-p)*(m1-m2)^2. So maps compose without loss of
    digits by large squares.
    """

    def __init__(self, column: str, alpha: float):
        self.column, self.alpha = column, alpha

    def _x(self, pdf: pd.DataFrame) -> np.ndarray:
        return pdf[self.column].to_numpy(float, na_value=np.nan)

    def _after(self, state: np.ndarray | None, group: np.ndarray) -> np.ndarray:
        """States after groups that follow a state: rows of (mean, variance, values) of the values since, as one group."""
        if state is None or not state[2]:
            return group
        keep = (1 - self.alpha) ** group[:, 2]
        apart = np.where(group[:, 2] > 0, state[0] - group[:, 0], 0.0)
        mean, variance = np.where(group[:, 2] > 0, group[:, 0], 0.0), np.where(group[:, 2] > 0, group[:, 1], 0.0)
        return np.column_stack([
            keep * state[0] + (1 - keep) * mean, keep * state[1] + (1 - keep) * variance + keep * (1 - keep) * apart**2, state[2] + group[:, 2],
        ])

    def groups(self, x: np.ndarray, first: bool) -> np.ndarray:
        """For each row: mean, variance and number of the values of its block up to it. As a block that others follow, each value
        weighs alpha and those before it fade; in a first block the first value has the weight of all before it."""
        weights = pd.Series(x).ewm(alpha=self.alpha, adjust=not first, ignore_na=True)
        return np.column_stack([weights.mean(), weights.var(bias=True), np.cumsum(~np.isnan(x))])

    def summary(self, pdf: pd.DataFrame, first: bool) -> np.ndarray:
        x = self._x(pdf)
        return np.concatenate([self.groups(x, first)[-1], self.groups(x, True)[-1]])

    def step(self, state: np.ndarray | None, numbers: np.ndarray) -> np.ndarray:
        begins = state is None or not state[2]
        return numbers[3:] if begins else self._after(state, numbers[None, :3])[0]

    def deviation(self, pdf: pd.DataFrame, state: np.ndarray | None) -> np.ndarray:
        """With the factor that makes up for weights: 1 / (1 - sum of squared weights); missing for a single value."""
        begins = state is None or not state[2]
        after = self._after(None if begins else state, self.groups(self._x(pdf), begins))
        n, fading = after[:, 2], (1 - self.alpha) ** 2
        limit = self.alpha / (2 - self.alpha)
        squares = limit + (1 - limit) * fading ** (np.maximum(n, 1) - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 1, np.sqrt(after[:, 1] / (1 - squares)), np.nan)


def weighted_deviation(rows: DataFrame, column: str, alpha: float, name: str, scale: float = 1.0) -> DataFrame:
    """(ticker, date, name): deviation of a column about its exponential mean, weights fading by 1 - alpha a row, times scale."""
    moments = Moments(column, alpha)

    def apply(pdf: pd.DataFrame, state: np.ndarray | None) -> pd.DataFrame:
        deviation = pd.Series(scale * moments.deviation(pdf, state)).astype("Float64")
        return pd.DataFrame({"ticker": pdf["ticker"], "date": pdf["date"], name: deviation})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("ticker", "date")}
    schema = f"ticker {kinds['ticker']}, date {kinds['date']}, {name} double"
    return scanned(rows.select("ticker", "date", column, "_pos", "_block", "_key"), schema, moments.summary, moments.step, apply)


def rolling_quantile(rows: DataFrame, column: str, n: int, share: float, name: str, *, size: int = SIZE) -> DataFrame:
    """(ticker, date, name): the interpolated quantile of the last n values, missing until all n are there.

    A block keeps its window in order, with one insertion and one deletion a row: n log n for a block, whatever n.
    """

    def quantile(pdf: pd.DataFrame) -> pd.DataFrame:
        value = pdf[column].astype(float).rolling(n).quantile(share)
        return pdf.assign(**{name: value.astype("Float64")})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("ticker", "date")}
    schema = f"ticker {kinds['ticker']}, date {kinds['date']}, {name} double"
    return framed_groups(rows.select("ticker", "date", column, "_pos", "_block", "_key"), quantile, schema, back=n - 1, size=size)
