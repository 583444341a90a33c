"""Rule-based strategies: conditions on indicators, a position that enters and leaves, and what it earns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import YEAR, by_date, change, drawdown, gains, growth, ratio, rolling, rsi, so_far
from tidemark.operators.features import exponential
from tidemark.operators.histories import DAYS, SIZE, framed, numbered, running


def indicators(bars: DataFrame, conditions: list[dict]) -> DataFrame:
    """bars with a flag column for each condition, c0, c1, ...: false where its indicator is not there yet; unknown types are refused."""
    up, down = gains("close")
    out = bars.withColumns({"_up": up, "_down": down})
    if any(c["type"] in ("macd_above_signal", "macd_below_signal") for c in conditions):
        lines = exponential(bars, (12, 26)).select(F.col("ticker").alias("_ticker"), F.col("date").alias("_date"), F.col("macd").alias("_macd"), F.col("macd_signal").alias("_signal"))
        out = out.join(lines, F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("date").eqNullSafe(F.col("_date")), "left")
    sma = lambda n: rolling(F.avg, "close", n)
    close = F.col("close")

    def flag(c: dict) -> Column:
        n, fast, slow, value = c.get("period"), c.get("fast", 50), c.get("slow", 200), c.get("value")
        rsi_of = lambda: rsi(rolling(F.avg, "_up", n or 14), rolling(F.avg, "_down", n or 14))
        kinds = {
            "rsi_below": lambda: rsi_of() < (30 if value is None else value), "rsi_above": lambda: rsi_of() > (70 if value is None else value),
            "price_above_sma": lambda: close > sma(n or 50), "price_below_sma": lambda: close < sma(n or 50),
            "sma_fast_above_slow": lambda: sma(fast) > sma(slow), "sma_fast_below_slow": lambda: sma(fast) < sma(slow),
            "macd_above_signal": lambda: F.col("_macd") > F.col("_signal"), "macd_below_signal": lambda: F.col("_macd") < F.col("_signal"),
            "momentum_above": lambda: change("close", n or 20) > (value or 0), "momentum_below": lambda: change("close", n or 20) < (value or 0),
        }
        if c["type"] not in kinds:
            raise ValueError(f"unknown condition {c['type']!r}")
        return kinds[c["type"]]()

    return out.withColumns({f"c{i}": F.coalesce(flag(c), F.lit(False)) for i, c in enumerate(conditions)}).drop("_up", "_down", "_ticker", "_date", "_macd", "_signal")


def joined(flags: list[Column], mode: str = "all") -> Column:
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), flags) if flags else F.lit(False)


def positions(rows: DataFrame, enter: Column, leave: Column, *, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """position, 1 or 0: entered one row after `enter` holds while flat, left one row after `leave` holds while in.

    A row with one of both sets the state; a row with both turns it over. Such transitions compose: what a block of rows
    makes of a state is the state it sets last, if any, turned as often as there were turns since. With T turns so far, a
    row that sets a state s says s - T; so the last such number, plus T, is the state, and running values of blocks give both.
    """

    def before(rows: DataFrame) -> DataFrame:
        w = by_date()
        flags = {"_e": enter, "_x": leave}
        return rows.withColumns({name: F.coalesce(F.lag(flag).over(w), F.lit(False)) for name, flag in flags.items()})

    rows = framed(numbered(rows, size=size, days=days), before, back=1, size=size)
    rows = running(rows, {"_turns": ("sum", (F.col("_e") & F.col("_x")).cast("int"))})
    sets = F.when(F.col("_e") != F.col("_x"), F.col("_e").cast("int") - F.col("_turns"))
    rows = running(rows, {"_set": ("last", sets)})
    state = F.pmod(F.coalesce("_set", F.lit(0)) + F.col("_turns"), F.lit(2)).cast("int")
    return rows.withColumn("position", state).drop("_e", "_x", "_set", "_turns", "_pos", "_block", "_key")


def earned(rows: DataFrame, delay: int = 1, cost: float = 0.0) -> DataFrame:
    """strategy_return (the bar's return while in `delay` rows before, less cost for each change) and equity."""
    w = by_date()
    held = F.coalesce(F.lag("position", delay).over(w), F.lit(0))
    rows = rows.withColumn("_held", held)
    moved = F.abs(F.col("_held") - F.coalesce(F.lag("_held").over(w), F.lit(0)))
    rows = rows.withColumn("strategy_return", F.col("_held") * F.coalesce(change("close"), F.lit(0.0)) - cost * moved)
    return rows.withColumn("equity", growth("strategy_return")).drop("_held")


def statistics(rows: DataFrame) -> DataFrame:
    """Per ticker: return, yearly growth, volatility, Sharpe, Sortino (deviation of losses), drawdown, win rate, profit factor, exposure."""
    r = F.col("strategy_return")
    rows = rows.withColumn("_dd", drawdown("equity"))
    out = rows.groupBy("ticker").agg(
        (F.product(1 + r) - 1).alias("total_return"), F.count(r).alias("n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.stddev_samp(F.when(r < 0, r)).alias("_d"),
        F.min("_dd").alias("max_drawdown"), F.avg(F.when(r != 0, (r > 0).cast("double"))).alias("win_rate"),
        ratio(F.sum(F.when(r > 0, r)), F.nullif(-F.sum(F.when(r < 0, r)), F.lit(0.0))).alias("profit_factor"), F.avg((r != 0).cast("double")).alias("exposure"),
    )
    return out.withColumns({
        "cagr": F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), YEAR / F.col("n").cast("double")) - 1),
        "volatility": F.col("_s") * YEAR**0.5,
        "sharpe": ratio("_m", F.nullif(F.col("_s"), F.lit(0.0))) * YEAR**0.5, "sortino": ratio("_m", F.nullif(F.col("_d"), F.lit(0.0))) * YEAR**0.5,
    }).drop("_m", "_s", "_d")


def crossover(bars: DataFrame, fast: int = 10, slow: int = 40) -> DataFrame:
    """In while the fast mean is above the slow one, from the next row on."""
    a, b = rolling(F.avg, "close", fast), rolling(F.avg, "close", slow)
    return earned(bars.withColumn("position", F.coalesce(a > b, F.lit(False)).cast("int")))


def grid(bars: DataFrame, fasts: list[int], slows: list[int]) -> DataFrame:
    """Crossovers of all pairs fast < slow: Sharpe of each, and the best per ticker (the first pair of equal ones).

    Every mean is taken once over one window; pairs are then rows, as many as the grid has.
    """
    rows = bars.withColumns({f"_m{n}": rolling(F.avg, "close", n) for n in {*fasts, *slows}})
    pairs = [F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"), F.coalesce(F.col(f"_m{a}") > F.col(f"_m{b}"), F.lit(False)).cast("int").alias("position")) for a in fasts for b in slows if a < b]
    rows = rows.withColumn("r", F.coalesce(change("close"), F.lit(0.0))).select("ticker", "date", "r", F.explode(F.array(*pairs)).alias("p"))
    w = Window.partitionBy("ticker", "p.fast", "p.slow").orderBy("date")
    rows = rows.withColumn("s", F.coalesce(F.lag("p.position").over(w), F.lit(0)) * F.col("r"))
    out = rows.groupBy("ticker", F.col("p.fast").alias("fast"), F.col("p.slow").alias("slow")).agg((ratio(F.avg("s"), F.nullif(F.stddev_samp("s"), F.lit(0.0))) * YEAR**0.5).alias("sharpe"), (F.product(1 + F.col("s")) - 1).alias("total_return"))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc_nulls_last(F.round("sharpe", 9)), "fast", "slow"))
    return out.withColumn("best", rank == 1)


def trades(rows: DataFrame) -> DataFrame:
    """Stays in a position: entry and exit date, rows held and return; an open one ends with the data."""
    w = by_date()
    rows = rows.withColumn("_new", ((F.col("position") == 1) & (F.coalesce(F.lag("position").over(w), F.lit(0)) == 0)).cast("int"))
    rows = rows.withColumns({"_trade": F.sum("_new").over(so_far()), "_next": F.lead("close").over(w), "_next_date": F.lead("date").over(w)})
    out = rows.filter("position = 1").groupBy("ticker", F.col("_trade").alias("trade")).agg(F.min("date").alias("entry"), F.max(F.coalesce("_next_date", "date")).alias("exit"), F.count(F.lit(1)).alias("held"), F.min_by("close", "date").alias("_a"), F.max_by(F.coalesce("_next", "close"), "date").alias("_b"))
    return out.withColumn("trade_return", ratio("_b", "_a") - 1).drop("_a", "_b")


def monthly(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ticker", F.to_date(F.date_trunc("month", "date")).alias("month")).agg((F.product(1 + F.col("strategy_return")) - 1).alias("month_return"))


def measure(m: dict) -> Column:
    """An indicator of the rule engine: PRICE, CONST, SMA, RSI, MOMENTUM (percent) or BB (a Bollinger band: UPPER, MID or LOWER)."""
    n, kind, close = m.get("period", 20), m["kind"], F.col("close")
    if kind == "PRICE":
        return close
    if kind == "CONST":
        return F.lit(float(m["value"]))
    if kind == "MOMENTUM":
        return change("close", n) * 100
    if kind == "RSI":
        up, down = (rolling(F.sum, c, n) for c in ("_up", "_down"))
        return F.when(up + down == 0, 50.0).otherwise(100 - 100 / (1 + up / F.greatest(down, F.lit(1e-9))))
    if kind in ("SMA", "BB"):
        middle = rolling(F.avg, "close", n)
        sign = {"UPPER": 1, "LOWER": -1}.get(m.get("band"), 0) if kind == "BB" else 0
        return middle + sign * 2 * rolling(F.stddev_pop, "close", n)
    raise ValueError(f"unknown indicator {kind!r}")


def rules(bars: DataFrame, conditions: list[dict]) -> DataFrame:
    """bars with a flag for each condition (left, op, right), c0, c1, ...: false where a side is missing. op: > < >= <= ==, and CROSS_UP and
    CROSS_DN, which hold in the row where left comes to lie above or below right."""
    up, down = gains("close")
    sides = {f"_{side}{i}": c[side] for i, c in enumerate(conditions) for side in ("left", "right")}
    out = bars.withColumns({"_up": up, "_down": down})
    out = out.withColumns({name: measure(m) for name, m in sides.items()})

    def flag(i: int, op: str) -> Column:
        a, b = F.col(f"_left{i}"), F.col(f"_right{i}")
        pa, pb = F.lag(a).over(by_date()), F.lag(b).over(by_date())
        kinds = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": F.abs(a - b) < 1e-9, "CROSS_UP": (pa <= pb) & (a > b), "CROSS_DN": (pa >= pb) & (a < b)}
        return F.coalesce(kinds[op], F.lit(False))

    return out.withColumns({f"c{i}": flag(i, c["op"]) for i, c in enumerate(conditions)}).drop("_up", "_down", *sides)


def held_rows(rows: DataFrame, take: float | None = None, stop: float | None = None) -> DataFrame:
    """(ticker, row, held, entry_close, exited): held in a row if entered in an earlier one, at a close where `enter` holds while flat;
    left at a close where `leave` holds or that gained `take` or lost `stop` since. rows: with their number by ticker, `row`.
    Depends on the path: each ticker is walked once."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, at = pdf.sort_values("row"), [], None
        for i, (close, enter, leave) in enumerate(zip(pdf["close"], pdf["enter"], pdf["leave"])):
            if at is None:
                out.append((0, None, False))
                at = close if enter and i else None
                continue
            gain = close / at - 1
            gone = bool(leave or (take is not None and gain >= take) or (stop is not None and gain <= -stop))
            out.append((1, at, gone))
            at = None if gone else at
        held, entry, gone = zip(*out)
        entry = pd.array(entry, dtype="Float64")
        return pd.DataFrame({"ticker": pdf["ticker"].to_numpy(), "row": pdf["row"].to_numpy(), "held": held, "entry_close": entry, "exited": gone})

    walked = rows.select("ticker", "row", "close", "enter", "leave").groupBy("ticker")
    return walked.applyInPandas(walk, "ticker string, row int, held int, entry_close double, exited boolean")


def sized(rows: DataFrame, sizing: dict) -> DataFrame:
    """rows (held) with scale, strategy_return and equity. sizing: FIXED (percent), VOL_TARGET (the wanted volatility over that of the last 20
    returns, 2 at most; 1 in the first 20 rows) or KELLY (fraction)."""
    r = change("close")
    i = F.row_number().over(by_date())
    kind = sizing["kind"]
    rows = rows.withColumns({"_r": F.coalesce(r, F.lit(0.0)), "_i": i})
    realized = F.sqrt(F.avg(F.pow("_r", 2)).over(by_date().rowsBetween(-19, 0))) * YEAR**0.5
    scale = {"FIXED": lambda: F.lit(sizing["percent"] / 100), "KELLY": lambda: F.lit(float(sizing["fraction"])), "VOL_TARGET": lambda: F.when(F.col("_i") > 21, F.least(F.lit(2.0), sizing["target"] / F.greatest(F.lit(0.05), realized))).otherwise(1.0)}[kind]()
    rows = rows.withColumn("scale", scale).withColumn("strategy_return", F.col("held") * F.col("_r") * F.col("scale"))
    return rows.withColumn("equity", growth("strategy_return")).drop("_r", "_i")


def engine(bars: DataFrame, entry: list[dict], leave: list[dict], sizing: dict, take: float | None = None, stop: float | None = None) -> DataFrame:
    """bars with held, scale, strategy_return and equity of a strategy: in where all entry rules hold, out where any exit rule does or a bound is met."""
    flags = rules(bars, entry + leave)
    n = len(entry)
    flags = flags.withColumns({"enter": joined([F.col(f"c{i}") for i in range(n)]) if n else F.lit(True), "leave": joined([F.col(f"c{n + i}") for i in range(len(leave))], "any")})
    # numbered, as dates may repeat
    flags = flags.withColumn("row", F.row_number().over(by_date()))
    held = held_rows(flags, take, stop)
    return sized(flags.select(*bars.columns, "row").join(held, ["ticker", "row"]).drop("row"), sizing)


def engine_statistics(rows: DataFrame) -> DataFrame:
    """Per ticker, of engine(): growth, Sharpe and Sortino over the rows with a return, drawdown, and the trades' win rate, profit factor and number.
    A trade that is open in the last row counts with its gain there."""
    r, n = F.col("strategy_return"), F.count(F.lit(1))
    active = F.when(r != 0, r)
    last = F.max("date").over(Window.partitionBy("ticker"))
    closes = (F.col("held") == 1) & (F.col("exited") | (F.col("date") == last))
    rows = rows.withColumns({"_dd": drawdown("equity"), "_closes": closes}).withColumn("_gain", F.when(F.col("_closes"), (F.col("close") / F.col("entry_close") - 1) * 100))
    gain = F.col("_gain")
    out = rows.groupBy("ticker").agg(
        F.max_by("equity", "date").alias("_e"), n.alias("_n"), F.coalesce(F.avg(active), F.lit(0.0)).alias("_m"), F.coalesce(F.stddev_samp(active), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sqrt(F.avg(F.when(r < 0, r * r))), F.lit(0.0)).alias("_d"), F.least(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"), F.coalesce(F.avg((gain > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.sum(F.when(gain > 0, gain)), F.lit(0.0)).alias("_w"), F.coalesce(-F.sum(F.when(gain <= 0, gain)), F.lit(0.0)).alias("_l"), F.count(gain).alias("trades"), (F.sum("held") / n).alias("exposure"),
    )
    some = lambda a, b: F.when(F.col(b) > 0, F.col(a) * YEAR / (F.col(b) * YEAR**0.5)).otherwise(0.0)
    return out.withColumns({
        "cagr": F.pow("_e", 1 / F.greatest(F.lit(0.1), F.col("_n") / YEAR)) - 1, "sharpe": some("_m", "_s"), "sortino": some("_m", "_d"),
        "profit_factor": F.when(F.col("_l") > 0, F.col("_w") / F.col("_l")).when(F.col("_w") > 0, 99.0).otherwise(0.0),
    }).drop("_e", "_n", "_m", "_s", "_d", "_w", "_l")
