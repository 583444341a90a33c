"""Dependency graphs: nodes and edges from payloads, repaired edges, metrics on nodes, sensitivities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import NAMES
from tidemark.functions.windows import change
from tidemark.operators.research import plain_label, slug

# Kinds of nodes; for each kind the direction of its edge with the company and what it is called.
CATEGORIES = ("company", "supplier", "customer", "competitor", "commodity", "subsidiary", "segment", "sector_index", "regulator", "related")
EDGES = (
    ("supplier", "in", "supplies"),
    ("customer", "out", "sells_to"),
    ("competitor", "out", "competes_with"),
    ("commodity", "out", "exposed_to"),
    ("segment", "out", "operates"),
    ("subsidiary", "out", "owns"),
    ("regulator", "in", "regulates"),
    ("sector_index", "out", "benchmarked_against"),
)
MOST_NODES = 24
PAYLOAD = "nodes array<struct<id:string,label:string,category:string,ticker:string,note:string>>, edges array<struct<source:string,target:string,relation:string,rationale:string,confidence:string>>"
_EDGE = "array<struct<source:string,target:string,relation:string,rationale:string,confidence:string>>"
_NODE = "array<struct<id:string,label:string,category:string,ticker:string,note:string>>"


def _cleaned(n: Column) -> Column:
    label = F.trim(F.coalesce(F.nullif(n["label"], F.lit("")), n["id"], F.lit("")))
    kind = F.lower(F.trim(F.coalesce(F.nullif(n["category"], F.lit("")), F.lit("related"))))
    kind = F.when(kind == "company", "subsidiary").when(kind.isin(*CATEGORIES), kind).otherwise("related")
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for t, name in NAMES for x in (name.lower(), t)]), F.lower(label))
    ticker = F.coalesce(F.nullif(F.trim(n["ticker"]), F.lit("")), by_name, F.lit(""))
    return F.struct(slug(F.coalesce(F.nullif(n["id"], F.lit("")), label)).alias("id"), label.alias("label"), kind.alias("category"), ticker.alias("ticker"), F.substring(F.coalesce(n["note"], F.lit("")), 1, 120).alias("note"))


def nodes(rows: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """rows (company, name, ticker, payload) with graph_nodes, the company first, and raw edges.

    A node goes if its id or its plain label was taken by a node kept before it: a fold over the list of one payload, which is
    what a model returns at once. Payloads that are no JSON give the company alone.
    """
    parsed = rows.withColumn("_p", F.from_json("payload", PAYLOAD))
    own = F.struct(slug(F.coalesce(F.nullif(F.col("ticker"), F.lit("")), F.col("name"))).alias("id"), F.col("name").alias("label"), F.lit("company").alias("category"), F.col("ticker"), F.lit("").alias("note"))
    given = F.filter(F.transform(F.coalesce(F.col("_p.nodes"), F.array().cast(_NODE)), _cleaned), lambda n: n["label"] != "")
    parsed = parsed.withColumns({"_own": own, "_given": F.transform(given, lambda n: F.struct(n.alias("n"), plain_label(n["label"]).alias("plain")))})
    start = F.struct(F.array(F.col("_own")).cast(_NODE).alias("kept"), F.array(plain_label(F.col("name"))).alias("plain"))

    def step(s: Column, x: Column) -> Column:
        taken = F.exists(s["kept"], lambda k: k["id"] == x["n"]["id"]) | ((x["plain"] != "") & F.array_contains(s["plain"], x["plain"]))
        full = F.size(s["kept"]) >= most
        return F.when(taken | full, s).otherwise(F.struct(F.concat(s["kept"], F.array(x["n"]).cast(_NODE)).alias("kept"), F.concat(s["plain"], F.array(x["plain"])).alias("plain")))

    kept = F.aggregate("_given", start, step)["kept"]
    return parsed.withColumn("graph_nodes", kept).select("company", F.col("_own.id").alias("company_id"), "graph_nodes", F.col("_p.edges").alias("raw_edges"))


def node_rows(graphs: DataFrame) -> DataFrame:
    return graphs.select("company", "company_id", F.posexplode("graph_nodes").alias("position", "n")).select("company", "company_id", "position", "n.*")


def edges(graphs: DataFrame) -> DataFrame:
    """(company, position, source, target, relation, rationale, confidence) of graphs from nodes(): ends must be nodes, confidence is kept
    within 0..1 (0.5 if it is no number), edges with the company take the direction and name of the other end's kind, the
    first edge between two ends counts, and nodes without any get one.

    All that an edge depends on lies in its company's row, so nothing is joined and no graph is made twice.
    """
    own = F.col("company_id")
    rules = F.create_map(*[x for c, d, r in EDGES for x in (F.lit(c), F.struct(F.lit(d).alias("way"), F.lit(r).alias("name")))])
    rule = lambda k: F.try_element_at(rules, F.coalesce(k, F.lit("")))
    kind_of = lambda x: F.get(F.filter("graph_nodes", lambda n: n["id"] == x), 0)["category"]

    def given(e: Column, i: Column) -> Column:
        s, t = slug(F.coalesce(e["source"], F.lit(""))), slug(F.coalesce(e["target"], F.lit("")))
        return F.struct(i.alias("position"), s.alias("s"), t.alias("t"), e["relation"].alias("relation"), e["rationale"].alias("rationale"), e["confidence"].try_cast("double").alias("c"))

    def ended(e: Column) -> Column:
        return F.struct(e.alias("e"), kind_of(e["s"]).alias("s_kind"), kind_of(e["t"]).alias("t_kind"))

    def ruled(x: Column) -> Column:
        e = x["e"]
        kind = F.when(e["s"] == own, x["t_kind"]).when(e["t"] == own, x["s_kind"])
        return F.struct(e.alias("e"), F.when(e["s"] == own, e["t"]).when(e["t"] == own, e["s"]).alias("other"), rule(kind).alias("rule"))

    def fixed(x: Column) -> Column:
        e, r, inward = x["e"], x["rule"], x["rule"]["way"] == "in"
        return F.struct(
            e["position"].alias("position"), F.when(r.isNull(), e["s"]).when(inward, x["other"]).otherwise(own).alias("source"),
            F.when(r.isNull(), e["t"]).when(inward, own).otherwise(x["other"]).alias("target"),
            F.coalesce(r["name"], F.substring(F.coalesce(F.nullif(e["relation"], F.lit("")), F.lit("related_to")), 1, 40)).alias("relation"),
            F.substring(F.coalesce(e["rationale"], F.lit("")), 1, 160).alias("rationale"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(e["c"], F.lit(0.5)))).alias("confidence"),
        )

    def added(n: Column, i: Column) -> Column:
        return F.struct(n["id"].alias("id"), (i + 1_000_000).alias("position"), rule(n["category"]).alias("rule"))

    def alone(x: Column) -> Column:
        inward = x["rule"]["way"] == "in"
        return F.struct(
            x["position"].alias("position"), F.when(inward, x["id"]).otherwise(own).alias("source"), F.when(inward, own).otherwise(x["id"]).alias("target"),
            x["rule"]["name"].alias("relation"), F.lit("").alias("rationale"), F.lit(0.5).alias("confidence"),
        )

    raw = F.filter(F.transform(F.coalesce("raw_edges", F.array().cast(_EDGE)), given), lambda e: e["s"] != e["t"])
    met = F.filter(F.transform(raw, ended), lambda x: x["s_kind"].isNotNull() & x["t_kind"].isNotNull())
    rows = graphs.withColumn("_fixed", F.transform(F.transform(met, ruled), fixed))
    rows = rows.withColumn("_ends", F.transform("_fixed", lambda e: F.struct(e["source"], e["target"])))
    rows = rows.withColumn("_first", F.filter("_fixed", lambda e, i: F.array_position("_ends", F.get("_ends", i)) == i + 1))
    idle = F.filter(F.transform("graph_nodes", added), lambda x: (x["id"] != own) & x["rule"].isNotNull() & ~F.exists("_first", lambda e: (e["source"] == x["id"]) | (e["target"] == x["id"])))
    return rows.select("company", F.inline(F.concat("_first", F.transform(idle, alone))))


def with_metrics(node_table: DataFrame, metrics: DataFrame) -> DataFrame:
    """Nodes with the metrics of their ticker; those without one, or of a ticker without metrics, keep nulls."""
    return node_table.join(metrics, "ticker", "left")


def last_metrics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of each ticker's last row."""
    return rows.groupBy("ticker").agg(*[F.max_by(c, "date").alias(c) for c in columns])


def elements(edge_table: DataFrame) -> DataFrame:
    """(company, element): each edge as the JSON that graph views read."""
    data = F.struct(F.concat_ws("->", "source", "target").alias("id"), "source", "target", "relation", "confidence")
    return edge_table.select("company", F.to_json(F.struct(data.alias("data"))).alias("element"))


def sensitivities(bars: DataFrame, edge_table: DataFrame, most_lag: int = 5, least: int = 30) -> DataFrame:
    """Per edge (focal, dep, relation) of tickers: slope, correlation and explained share of focal's returns on dep's (null under `least`
    common dates), the shift of strongest correlation, dep's change over 4 and 13 rows and last close, and the rank by slope.

    Edges choose which pairs of returns meet; these are joined on dates.
    """
    rows = bars.withColumns({"r": change("close"), "ret_4": change("close", 4), "ret_13": change("close", 13)})
    r = rows.filter(F.col("r").isNotNull()).select("ticker", "date", "r")
    f = edge_table.select("focal", "dep").distinct().join(r.select(F.col("ticker").alias("focal"), "date", F.col("r").alias("rf")), "focal")
    pairs = f.join(r.select(F.col("ticker").alias("dep"), "date", F.col("r").alias("rd")), ["dep", "date"])
    beta = F.coalesce(F.try_divide(F.covar_samp("rf", "rd"), F.var_samp("rd")), F.lit(0.0))
    link = pairs.groupBy("focal", "dep").agg(F.count(F.lit(1)).alias("n"), beta.alias("beta"), F.corr("rf", "rd").alias("corr"))
    enough = lambda c: F.when(F.col("n") >= least, c)
    link = link.select("focal", "dep", "n", enough(F.col("beta")).alias("beta"), enough(F.col("corr")).alias("corr"), enough(F.col("corr") * F.col("corr")).alias("r2"))
    numbered = pairs.withColumn("i", F.row_number().over(Window.partitionBy("focal", "dep").orderBy("date")))
    left = numbered.select("focal", "dep", "i", "rf", F.explode(F.sequence(F.lit(-most_lag), F.lit(most_lag))).alias("lag"))
    shifted = left.withColumn("k", F.col("i") + F.col("lag")).join(numbered.select("focal", "dep", F.col("i").alias("k"), "rd"), ["focal", "dep", "k"])
    lags = shifted.groupBy("focal", "dep", "lag").agg(F.corr("rf", "rd").alias("c"))
    best = lags.groupBy("focal", "dep").agg(F.max(F.struct(F.round(F.abs("c"), 9), (-F.col("lag")).alias("l")))["l"].alias("l")).select("focal", "dep", (-F.col("l")).alias("best_lag"))
    last = rows.groupBy("ticker").agg(*[F.max_by(c, "date").alias(c) for c in ("close", "ret_4", "ret_13")]).withColumnsRenamed({"ticker": "dep", "close": "last"})
    out = edge_table.join(link, ["focal", "dep"], "left").join(best, ["focal", "dep"], "left").join(last, "dep", "left")
    rank = F.row_number().over(Window.partitionBy("focal").orderBy(F.desc(F.round(F.abs(F.coalesce("beta", F.lit(0.0))), 9)), "dep"))
    return out.withColumn("rank", rank)


