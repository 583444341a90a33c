"""Edges of a graph come from its own row."""

import json

from tidemark.operators import graphs


def test_edges_are_made_without_joins(spark):
    payload = {"nodes": [{"id": "S 1", "label": "One", "category": "supplier"}, {"id": "x", "label": "Two", "category": "customer"}, {"id": "y", "label": "Three", "category": "related"}],
               "edges": [{"source": "o1", "target": "s_1", "relation": "r", "confidence": "high"}, {"source": "s_1", "target": "o1"}, {"source": "y", "target": "s_1", "confidence": "7"}, {"source": "y", "target": "gone"}, {"source": "y", "target": "y"}]}
    rows = spark.createDataFrame([(1, "Order", "O1", json.dumps(payload)), (2, "Alone", "O2", "no json")], "company long, name string, ticker string, payload string")
    made = graphs.edges(graphs.nodes(rows))
    got = [(r.company, r.position, r.source, r.target, r.relation, r.confidence) for r in made.orderBy("company", "position").collect()]
    assert got == [(1, 0, "s_1", "o1", "supplies", 0.5), (1, 2, "y", "s_1", "related_to", 1.0), (1, 1000002, "o1", "x", "sells_to", 0.5)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
