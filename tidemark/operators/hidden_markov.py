"""Gaussian hidden Markov models with full covariances: fitted by expectation and maximization, decoded by max-product.

Decoding works over blocks of a ticker's rows. What a block makes of the scores that it is entered with is a matrix, of
states times states, under (max, +) for the best path and under (log-sum, +) for the probabilities; such matrices compose.
The matrices of a ticker, one for each block, give the state in which the best path leaves each block, and the forward and
backward scores at its ends; then each block finds its own part of the path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.histories import DAYS, SIZE, numbered

TINY = 1e-300  # probabilities are at least this


@dataclass
class Chain:
    """Probabilities of the first state and of transitions, and the density of each state. k states, d features."""

    start: np.ndarray
    transition: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def flat(self) -> list[float]:
        k, d = self.means.shape
        parts = ([k, d], self.start, self.transition, self.means, self.covariances)
        return np.concatenate([np.ravel(np.asarray(p, float)) for p in parts]).tolist()

    @staticmethod
    def of(numbers) -> Chain:
        numbers = np.asarray(numbers, float)
        k, d = int(numbers[0]), int(numbers[1])
        start, transition, means, covariances = np.split(numbers[2:], np.cumsum([k, k * k, k * d]))
        return Chain(start, transition.reshape(k, k), means.reshape(k, d), covariances.reshape(k, d, d))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Rows by states, by Cholesky factors: the squared distance is that of the whitened row."""
        out = np.empty((len(x), len(self.start)))
        for i, (mean, covariance) in enumerate(zip(self.means, self.covariances)):
            root = np.linalg.cholesky(covariance)
            white = np.linalg.solve(root, (x - mean).T)
            out[:, i] = -0.5 * ((white**2).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
        return out

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.log(np.maximum(self.start, TINY)), np.log(np.maximum(self.transition, TINY))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _through(log_b: np.ndarray, turn: np.ndarray, into: np.ndarray, joined) -> np.ndarray:
    """Scores after each row, for each row of `into`: scores before the first of them, by state. joined: max or log-sum."""
    out = np.empty((len(log_b), *into.shape))
    for t, b in enumerate(log_b):
        into = joined(into[:, :, None] + turn[None], 1) + b
        out[t] = into
    return out


def best_path(log_b: np.ndarray, start: np.ndarray, turn: np.ndarray, end: int | None = None) -> np.ndarray:
    """The states of highest score; start: scores of states before their first density is added; end: the last state, if given.
    Of equal scores the smallest state is taken."""
    n, k = log_b.shape
    from_, score = np.zeros((n, k), int), start + log_b[0]
    for t in range(1, n):
        both = score[:, None] + turn
        from_[t] = both.argmax(0)
        score = both[from_[t], np.arange(k)] + log_b[t]
    path = np.empty(n, int)
    path[-1] = score.argmax() if end is None else end
    for t in range(n - 1, 0, -1):
        path[t - 1] = from_[t, path[t]]
    return path


def decode(rows: DataFrame, features: list[str], chains: DataFrame, *, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """(ticker, date, state, state_probability, probabilities): the best path of each ticker through the states of its chain, and the
    probability of each state in a row given all rows. chains: ticker, numbers (Chain.flat), one row for each ticker.

    Rows with a missing feature, and tickers without a chain, are left out. Blocks of `size` rows are worked on side by side.
    """
    rows = numbered(rows.dropna(subset=features).select("ticker", "date", *features), size=size, days=days).drop("_key")
    kind = rows.schema["ticker"].dataType.simpleString()
    by = ("ticker", "_block")
    # one row for each block
    blocks = rows.select(F.col("ticker").alias("_t"), F.col("_block").alias("_b")).distinct()
    given = blocks.join(chains.select(F.col("ticker").alias("_t"), "numbers"), "_t")

    def observed(pdf: pd.DataFrame, chain: Chain) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        return pdf, chain.log_density(pdf[features].to_numpy(float))

    def summed(pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(given):
            return pd.DataFrame(columns=["ticker", "_block", "numbers", "best", "all"], dtype=object)
        chain = Chain.of(given["numbers"].iloc[0])
        start, turn = chain.logs()
        pdf, log_b = observed(pdf, chain)
        k = len(start)
        first = int(pdf["_block"].iloc[0]) == 0
        maps = []
        for joined in (np.max, _log_sum):
            # a first block is entered from the start; others from each state
            into = start[None] if first else np.where(np.eye(k) > 0, 0.0, -1e300)
            if first:
                head = into + log_b[0]
                maps.append(_through(log_b[1:], turn, head, joined)[-1] if len(log_b) > 1 else head)
            else:
                maps.append(_through(log_b, turn, into, joined)[-1])
        row = {"ticker": pdf["ticker"].iloc[:1], "_block": pdf["_block"].iloc[:1], "numbers": [given["numbers"].iloc[0]]}
        return pd.DataFrame(row | {"best": [maps[0].ravel().tolist()], "all": [maps[1].ravel().tolist()]})

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block: the state before it, its last state, and scores before its first and after its last row."""
        pdf = pdf.sort_values("_block", ignore_index=True)
        k = int(pdf["numbers"].iloc[0][0])
        best, total = ([np.asarray(m, float).reshape(-1, k) for m in pdf[c]] for c in ("best", "all"))
        forward, alpha = [best[0][0]], [total[0][0]]
        for m, a in zip(best[1:], total[1:]):
            forward.append((forward[-1][:, None] + m).max(0))
            alpha.append(_log_sum(alpha[-1][:, None] + a, 0))
        n = len(pdf)
        end, beta = np.zeros(n, int), np.zeros((n, k))
        end[-1] = forward[-1].argmax()
        for b in range(n - 1, 0, -1):
            end[b - 1] = (forward[b - 1] + best[b][:, end[b]]).argmax()
            beta[b - 1] = _log_sum(total[b] + beta[b][None], 1)
        state = [[end[b - 1] if b else -1, end[b], *(alpha[b - 1] if b else np.zeros(k)), *beta[b]] for b in range(n)]
        return pd.DataFrame({"ticker": pdf["ticker"], "_block": pdf["_block"], "numbers": pdf["numbers"], "state": [list(map(float, s)) for s in state]})

    def placed(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame(columns=["ticker", "date", "state", "state_probability", "probabilities"], dtype=object)
        chain, numbers = Chain.of(state["numbers"].iloc[0]), np.asarray(state["state"].iloc[0], float)
        (start, turn), k = chain.logs(), len(chain.start)
        pdf, log_b = observed(pdf, chain)
        before, end, alpha, beta = int(numbers[0]), int(numbers[1]), numbers[2 : 2 + k], numbers[2 + k :]
        path = best_path(log_b, start if before < 0 else turn[before], turn, end)
        head = (start if before < 0 else _log_sum(alpha[:, None] + turn, 0)) + log_b[0]
        forward = np.concatenate([head[None], _through(log_b[1:], turn, head[None], _log_sum)[:, 0]])
        backward = np.empty_like(forward)
        backward[-1] = beta
        for t in range(len(log_b) - 2, -1, -1):
            backward[t] = _log_sum(turn + (log_b[t + 1] + backward[t + 1])[None], 1)
        share = forward + backward
        share = np.exp(share - _log_sum(share, 1)[:, None])
        return pd.DataFrame({
            "ticker": pdf["ticker"], "date": pdf["date"], "state": path, "state_probability": share.max(1), "probabilities": share.tolist(),
        })

    numbers = f"ticker {kind}, _block long, numbers array<double>"
    maps = rows.groupBy(*by).cogroup(given.groupBy("_t", "_b")).applyInPandas(summed, f"{numbers}, best array<double>, all array<double>")
    states = maps.groupBy("ticker").applyInPandas(between, f"{numbers}, state array<double>")
    schema = f"ticker {kind}, date {rows.schema['date'].dataType.simpleString()}, state int, state_probability double, probabilities array<double>"
    return rows.groupBy(*by).cogroup(states.groupBy(*by)).applyInPandas(placed, schema)


# --- fitting ----------------------------------------------------------------------------------------------------------


def expectation(log_b: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of each state in each row, expected transitions, and the log-likelihood."""
    n, k = log_b.shape
    top = log_b.max(1)
    b = np.exp(log_b - top[:, None])
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        alpha[t] = (chain.start if t == 0 else alpha[t - 1] @ chain.transition) * b[t]
        scale[t] = max(alpha[t].sum(), TINY)
        alpha[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = chain.transition @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    turns = alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]) * chain.transition
    return alpha * beta, turns, float(np.log(scale).sum() + top.sum())


def maximization(x: np.ndarray, g: np.ndarray, turns: np.ndarray, chain: Chain, prior: float) -> Chain:
    weight = np.maximum(g.sum(0), 1e-12)
    means = g.T @ x / weight[:, None]
    apart = x[:, None] - means
    scatter = np.einsum("tk,tki,tkj->kij", g, apart, apart) + prior * np.eye(x.shape[1])
    out = turns.sum(1, keepdims=True)
    transition = np.where(out > 1e-12, turns / np.maximum(out, 1e-12), chain.transition)
    return Chain(g[0] / g[0].sum(), transition, means, scatter / weight[:, None, None])


def fit_chain(x: np.ndarray, k: int, *, rounds: int = 100, least: float = 1e-2, prior: float = 1e-2) -> tuple[Chain, list[float]]:
    """A chain fitted to the rows of x, and the objective of each round: the log-likelihood less prior times half the traces of
    the inverse covariances, which keeps covariances from collapsing. It never falls; a gain under `least` ends the rounds.

    States begin as parts of equal size by the first feature, and are numbered by its mean in the end.
    """
    g = np.eye(k)[np.minimum(k - 1, np.argsort(np.argsort(x[:, 0], kind="stable"), kind="stable") * k // len(x))]
    stay = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    chain = Chain(np.full(k, 1 / k), stay, np.zeros((k, x.shape[1])), np.stack([np.eye(x.shape[1])] * k))
    chain = maximization(x, g, np.zeros((k, k)), chain, prior)
    chain.start = np.full(k, 1 / k)
    trace: list[float] = []
    for _ in range(rounds):
        g, turns, likelihood = expectation(chain.log_density(x), chain)
        trace.append(likelihood - prior / 2 * float(np.trace(np.linalg.inv(chain.covariances), axis1=1, axis2=2).sum()))
        if len(trace) > 1 and trace[-1] - trace[-2] < least:
            break
        chain = maximization(x, g, turns, chain, prior)
    order = np.argsort(chain.means[:, 0], kind="stable")
    return Chain(chain.start[order], chain.transition[np.ix_(order, order)], chain.means[order], chain.covariances[order]), trace


def fit_chains(rows: DataFrame, features: list[str], k: int = 4, *, rounds: int = 100, least: float = 1e-2) -> DataFrame:
    """(ticker, numbers, likelihood, rounds): a chain fitted to each ticker. Features are standardized within a ticker for the fit;
    the chain is for them as they are. Fitting takes a ticker's rows in one task; decoding does not."""
    rows = rows.dropna(subset=features).select("ticker", "date", *features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date", ignore_index=True)[features].to_numpy(float)
        mean, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        chain, trace = fit_chain((x - mean) / spread, k, rounds=rounds, least=least)
        chain.means, chain.covariances = mean + chain.means * spread, chain.covariances * np.outer(spread, spread)
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[:1].to_numpy(), "numbers": [chain.flat()], "likelihood": [trace[-1]], "rounds": [len(trace)]})

    kind = rows.schema["ticker"].dataType.simpleString()
    return rows.groupBy("ticker").applyInPandas(run, f"ticker {kind}, numbers array<double>, likelihood double, rounds int")


def detected(rows: DataFrame, features: list[str], k: int = 4, *, least_rows: int = 60, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """decode() of each ticker under the chain fitted to it; tickers of fewer than least_rows rows are left out."""
    rows = rows.dropna(subset=features)
    enough = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_rows).select("ticker")
    return decode(rows, features, fit_chains(rows.join(enough, "ticker", "left_semi"), features, k), size=size, days=days)
