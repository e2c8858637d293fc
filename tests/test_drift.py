"""Fields observed in raw responses against a plain walk over parsed JSON, and departures from a schema."""

import json
import random
from collections import Counter

import pytest

from doorstep.sources import drift


def plain(value, path="$", out=None):
    """Kinds by path of one response."""
    out = {} if out is None else out
    kind = (
        "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float))
        else "text" if isinstance(value, str) else "list" if isinstance(value, list) else "object"
    )
    out.setdefault(path, set()).add(kind)
    if kind == "object":
        for k, v in value.items():
            plain(v, f"{path}.{drift._quoted(k)}", out)
    for v in value if kind == "list" else ():
        plain(v, f"{path}[]", out)
    return out


def made(rng, depth=0):
    pick = rng.random()
    if depth < 3 and pick < 0.45:
        names = ["a", "b c", "x`y", "OBJECT", "12", "été", "d_1", "p.q", "e: f", "<>"]
        return {k: made(rng, depth + 1) for k in rng.sample(names, rng.randint(0, 4))}
    if depth < 3 and pick < 0.65:
        # Elements of one kind, so that what lies below them is told by the shape.
        return [rng.randint(0, 9) for _ in range(rng.randint(1, 3))] if pick < 0.6 else [made(rng, depth + 1)]
    return rng.choice([1, 2.5, "s", True, None, -10**12, "`: <>"])


def test_observed_fields_equal_a_plain_walk(spark):
    rng = random.Random(5)
    docs = [(n % 3, json.dumps(made(rng))) for n in range(300)]
    want = Counter()
    for group, text in docs:
        for path, kinds in plain(json.loads(text)).items():
            assert len(kinds) == 1
            want[group, path, *kinds] += 1
    got = drift.observed_fields(spark.createDataFrame(docs, "g int, raw string"), ["g"]).collect()
    assert {(r.g, r.path, r.kind): r.responses for r in got} == dict(want)
    assert len(got) == len(want) and any("`x``y`" in r.path for r in got)


SCHEMA = "q string, n bigint, list array<struct<u string, `odd name` int>>, free variant, flag boolean"


@pytest.mark.parametrize("raw, want", [
    ('{"q":"x","n":1,"list":[{"u":"a","odd name":1}],"free":{"z":[1]},"flag":true}', set()),
    ('{"q":5,"n":null,"list":[null],"free":1,"flag":null}', set()),
    ('{"q":"x","n":"1","list":[],"free":1,"flag":1}',
     {("retyped", "$.n", "number", "text", 1), ("retyped", "$.flag", "boolean", "number", 1)}),
    ('{"q":"x","n":1,"list":[{"u":"a","new":{"deep":1}}],"free":1,"flag":true}',
     {("unknown", "$.list[].new", None, "object", 1), ("missing", "$.list[].`odd name`", "number", None, 0)}),
    ('{"q":"x","n":1,"list":{"u":1},"free":1,"flag":true}', {("retyped", "$.list", "list", "object", 1)}),
    ('{}', {("missing", f"$.{c}", k, None, 0) for c, k in
            (("q", "text"), ("n", "number"), ("list", "list"), ("free", "any"), ("flag", "boolean"))}),
    ("[1]", {("retyped", "$", "object", "list", 1)}),
    ("", {("retyped", "$", "object", "not json", 1)}),
    (None, {("retyped", "$", "object", "not json", 1)}),
])
def test_departures(spark, raw, want):
    rows = drift.drift(spark.createDataFrame([(raw,)], "raw string"), SCHEMA).collect()
    assert {(r.finding, r.path, r.declared, r.observed, r.responses) for r in rows} == want and len(rows) == len(want)


def test_groups_counts_and_empty_tables(spark):
    docs = [(1, '{"q":{}}')] * 30 + [(1, '{"q":1}')] * 5 + [(2, '{"q":"a","r":1}')] * 2 + [(None, "no")]
    df = spark.createDataFrame(docs, "day int, raw string")
    got = {tuple(r) for r in drift.drift(df, "q string", ["day"]).collect()}
    assert got == {
        (1, "retyped", "$.q", "text", "object", 30), (2, "unknown", "$.r", None, "number", 2),
        (None, "retyped", "$", "object", "not json", 1),
    }
    assert drift.drift(df.limit(0), "q string", ["day"]).count() == 0
