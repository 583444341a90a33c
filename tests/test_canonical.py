"""Canonical JSON against Python's, and ids of snapshots."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tidemark.functions.canonical import SECRET, canonical, public, snapshot_ids


def dumped(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def any_value(rng, depth=4):
    kind = rng.randrange(7 if depth else 5)
    if kind < 5:
        return [None, True, rng.randrange(-99, 99), rng.choice(["", "é\n\"/\\", "x y", " "]), rng.choice([0.5, -2.25])][kind]
    if kind == 5:
        return [any_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcXYZ_ü") + str(i): any_value(rng, depth - 1) for i in range(rng.randrange(4))}


def shuffled(rng, value):
    if isinstance(value, dict):
        items = list(value.items())
        rng.shuffle(items)
        return {k: shuffled(rng, v) for k, v in items}
    return [shuffled(rng, v) for v in value] if isinstance(value, list) else value


def test_canonical(spark):
    rng = random.Random(5)
    values = [any_value(rng) for _ in range(150)]
    rows = [(i, json.dumps(shuffled(rng, v), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)]
    rows += [(1000, None), (1001, "not {json"), (1002, '{"a":1,"a":2}')]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, s string").select("i", canonical(F.col("s")).alias("c")).collect()}
    assert [got[i] for i in range(150)] == [dumped(v) for v in values]
    assert got[1000] == "null" and got[1001] == '"not {json"' and got[1002] == dumped('{"a":1,"a":2}')


def test_snapshot_ids(spark):
    params = {"page": 1, "q": {"z": 1, "a": [1, {"y": 2, "x": 3}]}}
    texts = [json.dumps(params), '{"q":{"a":[1,{"x":3,"y":2}],"z":1},"page":1}', json.dumps({"KEY": "s", **params, "Subscription-Key": 7, "api_key": None})]
    other = [json.dumps({**params, "page": 2}), json.dumps({**params, "q": {"key": 1}}), None, "{}", "[2,1]"]
    rows = spark.createDataFrame([(i, t, '{"b": 1, "a": 2}' if i % 2 else '{"a":2,"b":1}') for i, t in enumerate(texts + other)], "i int, p string, x string")
    ids = snapshot_ids(F.lit('pro"vider é'), F.lit("http://x/?a=1"), F.col("p"), F.col("x"))
    got = rows.select("i", public(F.col("p")).alias("public"), *[c.alias(n) for n, c in ids.items()]).orderBy("i").collect()
    assert len({r.snapshot_id for r in got[:3]}) == 1 and len({r.content_hash for r in got}) == 1
    want = hashlib.sha256(dumped({"provider": 'pro"vider é', "source_url": "http://x/?a=1", "params": params}).encode()).hexdigest()
    assert got[0].request_id == want and got[0].content_hash == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()
    assert got[0].snapshot_id == hashlib.sha256(f"{want}:{got[0].content_hash}".encode()).hexdigest()
    # secrets go from the request's own parameters, not from what they hold
    assert got[4].public == '{"page":1,"q":{"key":1}}' and got[5].public == got[6].public == "{}" and got[7].public == "[2,1]"
    assert len({r.request_id for r in got}) == 5 and "api_key" in SECRET
