"""SQL of queries whose steps depend on each other: simulations, trees, walks, optimal weights, chunks."""

from __future__ import annotations

from itertools import combinations

from tidemark.plans.derivatives import SURFACE, tree_sql
from tidemark.plans.graphs import PATHS
from tidemark.plans.market import _QUOTES
from tidemark.plans.portfolio import _VAR, MOMENTS, TICKERS
from tidemark.plans.sql import OVER, WEEKLY
from tidemark.plans.sql import rounded as sql

SIZE, OVERLAP = 800, 150


def _scaled_weights(chosen: tuple[int, ...], e: dict[int, str]) -> dict[int, str]:
    """What weights of chosen assets are in proportion to: the inverse of their covariances times e."""
    s = lambda i, j: f"s{i}{j}"
    if len(chosen) == 1:
        return {chosen[0]: "1"}
    if len(chosen) == 2:
        a, b = chosen
        return {a: f"{s(b, b)} * ({e[a]}) - {s(a, b)} * ({e[b]})", b: f"{s(a, a)} * ({e[b]}) - {s(a, b)} * ({e[a]})"}
    minor = lambda i, j: "({0} * {3} - {1} * {2})".format(*[s(r, c) for r in (1, 2, 3) if r != i for c in (1, 2, 3) if c != j])
    return {i: " + ".join(f"({(-1) ** (i + j)}) * {minor(j, i)} * ({e[j]})" for j in (1, 2, 3)) for i in (1, 2, 3)}


def _best(kind: str, e: dict[int, str], order: str) -> str:
    """The best weights that are not negative among the optima of all sets of assets."""
    rows = []
    for n in (1, 2, 3):
        for chosen in combinations((1, 2, 3), n):
            w = _scaled_weights(chosen, e)
            rows.append("SELECT o.*, " + ", ".join(f"CAST({w.get(i, '0')} AS DOUBLE) AS x{i}" for i in (1, 2, 3)) + " FROM o")
    return f"""(SELECT '{kind}' AS strategy, m1, m2, m3, w1, w2, w3, sqrt({_VAR('w', 'w')}) AS v FROM (SELECT *, x1 / (x1 + x2 + x3) AS w1, x2 / (x1 + x2 + x3) AS w2, x3 / (x1 + x2 + x3) AS w3 FROM ({" UNION ALL ".join(rows)}))
      WHERE least(w1, w2, w3) >= 0 ORDER BY {order} LIMIT 1)"""


_next = lambda i, a, b, wa, wb: f"((-(s{i}{a} * {wa} + s{i}{b} * {wb}) + sqrt(pow(s{i}{a} * {wa} + s{i}{b} * {wb}, 2) + 4 * s{i}{i} / 3)) / (2 * s{i}{i}))"
_PARITY = f"""par AS (SELECT 0 AS it, o.*, 1 / sqrt(s11) AS w1, 1 / sqrt(s22) AS w2, 1 / sqrt(s33) AS w3 FROM o UNION ALL
    SELECT it + 1, * EXCLUDE (it, n1, n2, w2, w3), n2, {_next(3, 1, 2, 'n1', 'n2')} FROM (SELECT * EXCLUDE (w1), {_next(2, 1, 3, 'n1', 'w3')} AS n2, n1 AS w1 FROM (SELECT *, {_next(1, 2, 3, 'w2', 'w3')} AS n1 FROM par WHERE it < 200)))"""
_WEIGHTS = f"""WITH RECURSIVE {MOMENTS}, {_PARITY},
  al AS (SELECT 'equal' AS strategy, m1, m2, m3, 1 / 3 AS w1, 1 / 3 AS w2, 1 / 3 AS w3, sqrt(({_VAR('u', 'u')})) AS v FROM (SELECT *, 1 / 3 AS u1, 1 / 3 AS u2, 1 / 3 AS u3 FROM o)
    UNION ALL {_best('minimum_variance', {1: '1', 2: '1', 3: '1'}, 'v')} UNION ALL {_best('maximum_sharpe', {i: f'm{i} - 0.05' for i in (1, 2, 3)}, f'(w1 * m1 + w2 * m2 + w3 * m3 - 0.05) / sqrt({_VAR("w", "w")}) DESC')}
    UNION ALL SELECT 'risk_parity', m1, m2, m3, z1, z2, z3, sqrt({_VAR('z', 'z')}) FROM (SELECT *, w1 / (w1 + w2 + w3) AS z1, w2 / (w1 + w2 + w3) AS z2, w3 / (w1 + w2 + w3) AS z3 FROM par WHERE it = 200))"""
_STEPS = "list_distinct(list_transform(range(30), lambda k: CAST(round_even(1 + k * 51 / 29, 0) AS INTEGER)))"
_BRACKETS = f"""WITH RECURSIVE {WEEKLY}, g AS (SELECT *, close / lag(close) {OVER} - 1 AS r, row_number() {OVER} AS i FROM bars), f AS (SELECT *, coalesce(r > 0, false) AS enter, coalesce(r < -0.2, false) AS leave FROM g),
  p AS (SELECT ticker, i, CASE WHEN enter THEN close END AS px, CASE WHEN enter THEN date END AS entry, NULL::DATE AS done, NULL::DATE AS opened, NULL::VARCHAR AS reason, NULL::DOUBLE AS gain FROM f WHERE i = 1
    UNION ALL SELECT ticker, i, CASE WHEN px IS NULL THEN CASE WHEN enter THEN close END WHEN why IS NULL THEN px END, CASE WHEN px IS NULL THEN CASE WHEN enter THEN date END WHEN why IS NULL THEN entry END,
      CASE WHEN why IS NOT NULL THEN date END, entry, why, CASE WHEN why IS NOT NULL THEN close / px - 1 END
    FROM (SELECT f.*, px, entry, CASE WHEN px IS NULL THEN NULL WHEN close / px - 1 >= 0.1 THEN 'take' WHEN close / px - 1 <= -0.08 THEN 'stop' WHEN leave THEN 'rule' END AS why FROM p JOIN f ON f.ticker = p.ticker AND f.i = p.i + 1))"""
_CHUNKS = f"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g')) AS t FROM documents WHERE text IS NOT NULL),
  n AS (SELECT doc_id, t, length(t) AS len FROM t), c AS (SELECT doc_id, -1::BIGINT AS idx, 0::BIGINT AS begin_, 0::BIGINT AS end_, 0::BIGINT AS next_ FROM n UNION ALL
    SELECT doc_id, idx, begin_, end_, CASE WHEN begin_ < end_ - {OVERLAP} AND {OVERLAP} < end_ - begin_ AND begin_ + {SIZE} < len THEN end_ - {OVERLAP} ELSE end_ END FROM (
      SELECT *, CASE WHEN begin_ + {SIZE} < len AND cut > begin_ + {SIZE // 2} THEN cut + 1 ELSE least(begin_ + {SIZE}, len) END AS end_ FROM (
        SELECT *, begin_ + greatest(CASE WHEN strpos(rev, ' .') > 0 THEN length(rev) - strpos(rev, ' .') - 1 ELSE -1 - begin_ END, CASE WHEN strpos(rev, chr(10)) > 0 THEN length(rev) - strpos(rev, chr(10)) ELSE -1 - begin_ END) AS cut FROM (
          SELECT c.doc_id, idx + 1 AS idx, next_ AS begin_, len, reverse(substring(t, next_ + 1, {SIZE})) AS rev FROM c JOIN n ON n.doc_id = c.doc_id WHERE next_ < len))))"""

ORACLE_SQL = {
    "portfolio_weights": f"""{_WEIGHTS} SELECT strategy, t.ticker, round(CASE t.ticker WHEN 'A' THEN w1 WHEN 'N' THEN w2 ELSE w3 END, 6) AS w, {sql(expected_return='w1 * m1 + w2 * m2 + w3 * m3', volatility='v', sharpe='(w1 * m1 + w2 * m2 + w3 * m3 - 0.05) / v')}
        FROM al, (VALUES {", ".join(f"('{t}')" for t in TICKERS)}) t(ticker)""",
    "simulate_summary": f"""WITH {PATHS}, l AS (SELECT arg_max(price, step) AS p, any_value(s0) AS s0 FROM pa GROUP BY sim)
        SELECT round(avg(p), 4) AS mean, round(median(p), 4) AS median, round(min(p), 4) AS low, round(max(p), 4) AS high,
          round(avg(CAST(p / s0 - 1 < 0 AS DOUBLE)), 4) AS loss_probability, round(greatest(0, -quantile_cont(p / s0 - 1, 0.05)), 4) AS var FROM l""",
    "simulate_bands": f"WITH {PATHS} SELECT step, {', '.join(f'round(quantile_cont(price, {s}), 4) AS p{round(100 * s)}' for s in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM pa GROUP BY step",
    "simulate_densities": f"""WITH {PATHS}, c AS (SELECT * FROM pa WHERE list_contains({_STEPS}, step)), e AS (SELECT quantile_cont(price, 0.01) AS lo, (quantile_cont(price, 0.99) - quantile_cont(price, 0.01)) / 60 AS w, quantile_cont(price, 0.99) AS hi FROM c),
        b AS (SELECT step, CAST(least(59, floor((price - lo) / w)) AS INTEGER) AS bin, lo, w, count(*) AS n FROM c, e WHERE price BETWEEN lo AND hi GROUP BY ALL)
        SELECT step, bin, round(lo + bin * w, 6) AS low, round(n / (sum(n) OVER (PARTITION BY step) * w), 6) AS density FROM b""",
    "option_tree": f"""WITH RECURSIVE {_QUOTES}, z AS (SELECT p_partkey AS id, s, k, t::DOUBLE AS t, 0.05::DOUBLE AS r, v::DOUBLE AS v, 0.01::DOUBLE AS q, g::DOUBLE AS g FROM x), {tree_sql('z', 100, True, 'tr')} SELECT id AS p_partkey, round(v[1], 4) AS tree FROM tr WHERE lft = 0""",
    "option_surface": f"WITH {SURFACE} SELECT i, j, {sql(t='t', m='m', iv='iv')} FROM near",
    "strategy_brackets": f"{_BRACKETS} SELECT ticker, opened AS entry, done AS exit, reason, round(gain, 6) AS trade_return FROM p WHERE reason IS NOT NULL",
    "text_chunks": f"""{_CHUNKS}, k AS (SELECT c.doc_id, idx, begin_, regexp_replace(substring(t, begin_ + 1, end_ - begin_), '^\\s+|\\s+$', '', 'g') AS chunk FROM c JOIN n ON n.doc_id = c.doc_id WHERE idx >= 0)
        SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, CAST(begin_ AS INTEGER) AS start, md5(chunk) AS digest FROM k WHERE chunk <> ''""",
}

ORACLE_SQL["portfolio_weights_in_blocks"] = ORACLE_SQL["portfolio_weights"]
