"""Queries of dependency graphs and of what shocks do to a ticker."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.draws import normal_sql
from tidemark.operators import features as X
from tidemark.operators import graphs as G
from tidemark.operators import simulate as M
from tidemark.operators import stats as S
from tidemark.plans.models import _paths
from tidemark.plans.research import label_sql
from tidemark.plans.sql import LAGGED, OVER, WEEKLY, out, rolling
from tidemark.plans.sql import rounded as sql
from tidemark.plans.stats import _literal, _pair, _R
from tidemark.sources.bars import table, weekly_bars

KINDS = ("supplier", "Customer", "competitor ", "commodity", "segment", "company", "regulator", "sector_index", "", "unheard of", "related")
CONFIDENCE = ("0.9", "1.4", "high", "0.25")
LINKS = (("A", "N", "supplies"), ("A", "R", "competes_with"), ("N", "R", "owns"))
SHOCK, HORIZON, DRAWS = -0.2, 10, 2000


def _graphs(spark, d):
    """Orders as companies; their lines are nodes and edges of a payload, with repeated ids and labels and wrong ends."""
    k, line, s = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    one_of = lambda words, n: F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))
    node = F.struct(F.concat(F.lit("N "), k % 6).alias("id"), F.when(k % 10 > 0, F.concat(F.lit("Part "), s % 4, F.when(line % 2 == 1, " Ltd").otherwise("."))).otherwise("Apple").alias("label"), one_of(KINDS, k).alias("category"),
                    F.when(k % 8 == 0, "XYZ").otherwise("").alias("ticker"), F.lit("seen").alias("note"))
    own, other = F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("n_"), k % 6)
    edge = F.struct(F.when(line % 3 == 0, own).otherwise(other).alias("source"), F.when(line % 3 == 0, other).when(line % 3 == 1, own).otherwise(F.concat(F.lit("n_"), s % 6)).alias("target"), F.lit("linked").alias("relation"), F.lit("").alias("rationale"),
                    one_of(CONFIDENCE, k).alias("confidence"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", node.alias("n"), edge.alias("e")))).alias("x"))
    payload = F.to_json(F.struct(F.col("x.n").alias("nodes"), F.col("x.e").alias("edges")))
    return G.nodes(lines.select(F.col("l_orderkey").alias("company"), F.concat(F.lit("Order "), "l_orderkey", F.lit(" Inc")).alias("name"), F.concat(F.lit("O"), "l_orderkey").alias("ticker"), payload.alias("payload")))


def nodes(spark, d):
    return G.node_rows(_graphs(spark, d)).select("company", "company_id", "id", "label", "category", "ticker")


def edges(spark, d):
    return out(G.edges(_graphs(spark, d)).select("company", "source", "target", "relation", "confidence"))


def elements(spark, d):
    return G.elements(G.edges(_graphs(spark, d)))


def node_metrics(spark, d):
    """Nations as nodes, some with a ticker, and the last metrics of these."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("label"), F.get(F.array(*map(F.lit, ("A", "N", "R", "Z", ""))), (F.col("n_nationkey") % 5).cast("int")).alias("ticker"))
    metrics = G.last_metrics(X.enriched(weekly_bars(spark, d)), ["close", "cumulative_return", "rolling_volatility"])
    return out(G.with_metrics(n, metrics))


def sensitivities(spark, d):
    return out(G.sensitivities(weekly_bars(spark, d), _literal(spark, LINKS, "focal string,dep string,relation string")))


def shock(spark, d):
    pairs = _pair(spark, d).select(F.col("ra").alias("f"), F.col("rb").alias("d"))
    return out(M.shocked(pairs, SHOCK, HORIZON, DRAWS), 4)


def loss_tail(spark, d):
    return out(M.loss_tail(*_paths(spark, d)))


def return_histogram(spark, d):
    return out(M.histogram(*_paths(spark, d)))


_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_SLUG = lambda x: f"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'node')"
_RAW = f"""ln AS (SELECT l_orderkey AS company, l_linenumber AS line, l_partkey AS k, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
  nd AS (SELECT company, pos, 'n_' || (k % 6) AS id, CASE WHEN k % 10 > 0 THEN 'Part ' || (s % 4) || CASE WHEN line % 2 = 1 THEN ' Ltd' ELSE '.' END ELSE 'Apple' END AS label, lower(trim(list_extract({_KINDS}, 1 + k % 11))) AS raw,
    CASE WHEN k % 8 = 0 THEN 'XYZ' WHEN k % 10 = 0 THEN 'AAPL' ELSE '' END AS ticker FROM ln),
  nx AS (SELECT company, pos, id, label, ticker, CASE WHEN raw = '' THEN 'related' WHEN raw = 'company' THEN 'subsidiary' WHEN list_contains([{", ".join(f"'{c}'" for c in G.CATEGORIES)}], raw) THEN raw ELSE 'related' END AS category, {label_sql('label')} AS plain FROM nd)"""
# which nodes are kept: line by line, as each depends on those kept before it
_NODES = f"""{_RAW}, kp AS (SELECT company, 0::BIGINT AS pos, ['o' || company] AS ids, ['order ' || company] AS plains, true AS ok FROM (SELECT DISTINCT company FROM ln)
    UNION ALL SELECT nx.company, nx.pos, CASE WHEN t THEN ids ELSE list_append(ids, id) END, CASE WHEN t THEN plains ELSE list_append(plains, plain) END, NOT t FROM
      (SELECT nx.*, ids, plains, list_contains(ids, nx.id) OR (plain <> '' AND list_contains(plains, plain)) AS t FROM kp JOIN nx ON nx.company = kp.company AND nx.pos = kp.pos + 1) nx),
  gn AS (SELECT nx.company, nx.pos, id, label, category, ticker FROM nx JOIN kp ON kp.company = nx.company AND kp.pos = nx.pos AND ok UNION ALL SELECT DISTINCT company, 0, 'o' || company, 'Order ' || company || ' Inc', 'company', 'O' || company FROM ln)"""
_RULES = ", ".join(f"('{c}', '{w}', '{r}')" for c, w, r in G.EDGES)
_EDGES = f"""{_NODES}, re AS (SELECT company, pos, 'o' || company AS own, CASE WHEN line % 3 = 0 THEN 'o' || company ELSE 'n_' || (k % 6) END AS s, CASE WHEN line % 3 = 0 THEN 'n_' || (k % 6) WHEN line % 3 = 1 THEN 'o' || company ELSE 'n_' || (s % 6) END AS t,
    least(1, greatest(0, coalesce(try_cast(list_extract(['0.9', '1.4', 'high', '0.25'], 1 + k % 4) AS DOUBLE), 0.5))) AS c FROM ln),
  rl(kind, way, name) AS (VALUES {_RULES}), en AS (SELECT re.*, a.category AS sk, b.category AS tk FROM re JOIN gn a ON a.company = re.company AND a.id = re.s JOIN gn b ON b.company = re.company AND b.id = re.t WHERE s <> t),
  ek AS (SELECT en.*, way, name, CASE WHEN s = own THEN t WHEN t = own THEN s END AS oth FROM en LEFT JOIN rl ON rl.kind = CASE WHEN s = own THEN tk WHEN t = own THEN sk END),
  fx AS (SELECT company, pos, CASE WHEN way IS NULL THEN s WHEN way = 'in' THEN oth ELSE own END AS source, CASE WHEN way IS NULL THEN t WHEN way = 'in' THEN own ELSE oth END AS target, coalesce(name, 'linked') AS relation, c AS confidence FROM ek),
  fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, source, target ORDER BY pos) AS rn FROM fx) WHERE rn = 1),
  ad AS (SELECT gn.company, CASE WHEN way = 'in' THEN id ELSE 'o' || gn.company END AS source, CASE WHEN way = 'in' THEN 'o' || gn.company ELSE id END AS target, name AS relation, 0.5::DOUBLE AS confidence FROM gn JOIN rl ON rl.kind = category
    WHERE category <> 'company' AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.company = gn.company AND (source = id OR target = id))),
  ge AS (SELECT company, source, target, relation, confidence::DOUBLE AS confidence FROM fd UNION ALL SELECT * FROM ad)"""
_SENS = f"""{WEEKLY}, rt AS (SELECT *, close / lag(close) {OVER} - 1 AS r, close / lag(close, 4) {OVER} - 1 AS ret_4, close / lag(close, 13) {OVER} - 1 AS ret_13 FROM bars),
  lk(focal, dep, relation) AS (VALUES {", ".join(str(x) for x in LINKS)}), pr AS (SELECT focal, dep, a.date, a.r AS rf, b.r AS rd, row_number() OVER (PARTITION BY focal, dep ORDER BY a.date) AS i FROM lk JOIN rt a ON a.ticker = focal JOIN rt b ON b.ticker = dep AND b.date = a.date WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
  st AS (SELECT focal, dep, count(*) AS n, covar_samp(rf, rd) / var_samp(rd) AS beta, corr(rf, rd) AS corr FROM pr GROUP BY 1, 2),
  lg AS (SELECT a.focal, a.dep, l, corr(a.rf, b.rd) AS c FROM pr a, range(-5, 6) g(l), pr b WHERE b.focal = a.focal AND b.dep = a.dep AND b.i = a.i + l GROUP BY 1, 2, 3),
  bl AS (SELECT focal, dep, arg_max(l, (round(abs(c), 9), -l)) AS best_lag FROM lg GROUP BY 1, 2), la AS (SELECT ticker AS dep, arg_max(close, date) AS last, arg_max(ret_4, date) AS ret_4, arg_max(ret_13, date) AS ret_13 FROM rt GROUP BY 1)"""
_SHOCK = f"""{_R}, p AS (SELECT a.r AS f, b.r AS d FROM t a JOIN t b USING (date) WHERE a.ticker = 'A' AND b.ticker = 'N' AND a.r IS NOT NULL AND b.r IS NOT NULL),
  g AS (SELECT covar_samp(f, d) / var_samp(d) AS beta, avg(f) AS mf, avg(d) AS md, stddev_samp(f) AS sf, var_samp(f) AS vf, covar_samp(f, d) AS c FROM p), h AS (SELECT *, mf - beta * md AS alpha, sqrt(greatest(0, vf - beta * c)) AS rs FROM g),
  z AS (SELECT sim, any_value(beta) AS beta, product(1 + mf + sf * {normal_sql('sim', 'step', seed=42)}) - 1 AS base, product(1 + alpha + beta * {(1 + SHOCK) ** (1 / HORIZON) - 1}::DOUBLE + rs * {normal_sql('sim', 'step', seed=43)}) - 1 AS moved
    FROM h, range({DRAWS}) a(sim), range(1, {HORIZON + 1}) b(step) GROUP BY sim), u AS (SELECT 'baseline' AS scenario, beta, base AS r FROM z UNION ALL SELECT 'shocked', beta, moved FROM z)"""
#: Simulated paths of _paths(): (sim, step, price).
PATHS = f"""{LAGGED}, pm AS (SELECT round(avg(close), 2) AS s0, round(avg(simple_return) * 52, 4) AS mu, round(stddev_samp(simple_return) * sqrt(52), 4) AS sg FROM r),
  pz AS (SELECT sim, step, s0, CASE WHEN step > 0 THEN (mu - sg * sg / 2) / 52 + sg * sqrt(1 / 52) * {normal_sql('sim', 'step', seed=42)} ELSE 0 END AS z
    FROM pm, range(4000) a(sim), range(53) b(step)),
  pa AS (SELECT sim, CAST(step AS INTEGER) AS step, s0, s0 * exp(sum(z) OVER (PARTITION BY sim ORDER BY step)) AS price FROM pz)"""
_LAST = f"{PATHS}, fr AS (SELECT arg_max(price, step) / any_value(s0) - 1 AS r FROM pa GROUP BY sim)"

QUERIES = {
    "graph_nodes": nodes, "graph_fixed_edges": edges, "graph_elements": elements, "graph_node_metrics": node_metrics, "graph_sensitivities": sensitivities,
    "simulate_shock": shock, "simulate_loss_tail": loss_tail, "simulate_histogram": return_histogram,
}

ORACLE_SQL = {
    "graph_nodes": f"WITH RECURSIVE {_NODES} SELECT company, 'o' || company AS company_id, id, label, category, ticker FROM gn",
    "graph_fixed_edges": f"WITH RECURSIVE {_EDGES} SELECT company, source, target, relation, round(confidence, 6) AS confidence FROM ge",
    "graph_elements": f"""WITH RECURSIVE {_EDGES} SELECT company, CAST(to_json({{'data': {{'id': source || '->' || target, 'source': source, 'target': target, 'relation': relation, 'confidence': confidence}}}}) AS VARCHAR) AS element FROM ge""",
    "graph_node_metrics": f"""WITH {WEEKLY}, rt AS (SELECT *, close / lag(close) {OVER} - 1 AS r FROM bars), en AS (SELECT ticker, date, close, product(1 + coalesce(r, 0)) {OVER} - 1 AS cu, {rolling('stddev_samp', 'r', 20)} * sqrt(252) AS rv FROM rt),
        la AS (SELECT ticker, arg_max(close, date) AS close, arg_max(cu, date) AS cu, arg_max(rv, date) AS rv FROM en GROUP BY 1)
        SELECT n_name AS label, list_extract(['A', 'N', 'R', 'Z', ''], 1 + n_nationkey % 5) AS ticker, {sql(close='close', cumulative_return='cu', rolling_volatility='rv')} FROM nation LEFT JOIN la ON la.ticker = list_extract(['A', 'N', 'R', 'Z', ''], 1 + n_nationkey % 5)""",
    "graph_sensitivities": f"""WITH {_SENS}, al AS (SELECT * FROM lk LEFT JOIN st USING (focal, dep) LEFT JOIN bl USING (focal, dep) LEFT JOIN la USING (dep))
        SELECT focal, dep, relation, n, {sql(beta='beta', corr='corr', r2='corr * corr', last='last', ret_4='ret_4', ret_13='ret_13')}, CAST(best_lag AS INTEGER) AS best_lag, CAST(row_number() OVER (PARTITION BY focal ORDER BY round(abs(al.beta), 9) DESC, dep) AS INTEGER) AS rank FROM al""",
    "simulate_shock": f"""WITH {_SHOCK} SELECT scenario, {", ".join(f"round({v}, 4) AS {k}" for k, v in {'mean': 'avg(r)', 'median': 'median(r)', 'p5': 'quantile_cont(r, 0.05)', 'p95': 'quantile_cont(r, 0.95)', 'prob_loss': 'avg(CAST(r < 0 AS DOUBLE))', 'beta': 'any_value(beta)', 'expected_move': f'any_value(beta) * {SHOCK}::DOUBLE'}.items())} FROM u GROUP BY scenario""",
    "simulate_loss_tail": f"WITH {_LAST}, q AS (SELECT quantile_cont(r, 0.05) AS q FROM fr) SELECT round(greatest(0, -any_value(q)), 6) AS var, round(greatest(0, -avg(r)), 6) AS cvar FROM fr, q WHERE r <= q",
    "simulate_histogram": f"""WITH {_LAST}, e AS (SELECT min(r) AS lo, (max(r) - min(r)) / 40 AS w FROM fr), b AS (SELECT CAST(least(39, floor((r - lo) / w)) AS INTEGER) AS bin, lo, w FROM fr, e)
        SELECT bin, round(lo + (bin + 0.5) * w, 6) AS center, count(*) AS n FROM b GROUP BY bin, lo, w""",
}
