"""The JSON walk against a recursive one."""

import json
import random

from sluice.operators import jsonwalk


def plain(value, path="$", name=None):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from plain(v, f"{path}.{k}" if k.isidentifier() and k.isascii() else f"{path}[{json.dumps(k, ensure_ascii=False)}]", k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from plain(v, f"{path}[{i}]", name)
    elif isinstance(value, dict | list):
        yield path, name, None, "object" if isinstance(value, dict) else "array"
    elif value is None:
        yield path, name, None, "null"
    elif isinstance(value, bool):
        yield path, name, "true" if value else "false", "boolean"
    else:
        yield path, name, value if isinstance(value, str) else json.dumps(value), "value"


def made(rng, depth=0):
    kind = rng.randrange(7 if depth < 5 else 4)
    if kind < 4:
        return [None, True, rng.randrange(10**20), rng.choice(["}", "a\"{", "é\n", ""])][kind]
    if kind == 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["id", "a b", "ü", "x1", ""]): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_equals_recursion(spark, monkeypatch):
    monkeypatch.setattr(jsonwalk, "ROWS", 7)
    rng = random.Random(3)
    values = [{"v": made(rng)} for _ in range(60)]
    rows = [(str(i), f"<script>var x = {json.dumps(v, ensure_ascii=bool(i % 2))};</script> {{not}} [1, 2,]") for i, v in enumerate(values)]
    rows += [("null", None), ("none", "no json {"), ("two", '[1] and {"a": [[], {}]} var x = [true]')]
    got = {}
    for r in sorted(jsonwalk.walk(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect(), key=lambda r: (r.k, r.part, r.ord)):
        got.setdefault((r.k, r.part), []).append((r.path, r.name, r.value, r.kind))
    for i, v in enumerate(values):
        assert got[str(i), 0] == list(plain(v))
    assert got["two", 0] == [("$[0]", None, "1", "value")] and got["two", 1] == [("$.a[0]", "a", None, "array"), ("$.a[1]", "a", None, "object")] and got["two", 2][0][2] == "true"
    assert not {k for k, _ in got} & {"null", "none"}
    after = jsonwalk.walk(spark.createDataFrame(rows[-1:], "k string, t string"), "k", "t", r"x\s*=").collect()
    assert [(r.part, r.path, r.value) for r in after] == [(0, "$[0]", "true")]


def test_depth_and_first_ids(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = [(1, f"{deep} [7]"), (3, "[" * 100_000), (2, '{"id": "b", "n": [{"id": "a"}, {"id": ["b", "c"]}, {"id": {"x": "d"}}]} {"id": "a", "id": "z"}')]
    found = jsonwalk.walk(spark.createDataFrame(rows, "k long, t string"), "k", "t").cache()
    assert sorted((r.k, r.part, r.value, r.kind) for r in found.where("k <> 2").collect()) == [(1, 0, "too deep", "error"), (1, 1, "7", "value"), (3, 0, "too deep", "error")]
    first = sorted(tuple(r) for r in jsonwalk.first_of_each(found, "k", "id").collect())
    assert first == [(2, "a", 0, 1), (2, "b", 0, 0), (2, "c", 0, 3), (2, "z", 1, 0)]
