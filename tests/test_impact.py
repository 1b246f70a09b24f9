"""Impact, paths and centrality on small graphs."""

from __future__ import annotations

import pytest

from quarry.operators import clusters, graph, impact, retrieval
from quarry.streaming import limits


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def start(spark, node):
    return spark.createDataFrame([(node,)], "node string")


CHAIN = [("c", "b"), ("b", "a"), ("d", "c")]
DIAMOND = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]


def test_reports(spark):
    got = [tuple(r) for r in impact.report(frame(spark, CHAIN), start(spark, "a")).collect()]
    assert got == [("b", 1, "HIGH", 1, ["a", "b"]), ("c", 2, "MEDIUM", 1, ["a", "b", "c"]), ("d", 3, "LOW", 0, ["a", "b", "c", "d"])]
    got = [tuple(r) for r in impact.report(frame(spark, DIAMOND), start(spark, "a")).collect()]
    assert got == [("b", 1, "HIGH", 1, ["a", "b"]), ("c", 1, "HIGH", 1, ["a", "c"]), ("d", 2, "MEDIUM", 0, ["a", "b", "d"])]
    assert impact.report(frame(spark, CHAIN), start(spark, "a"), 1).count() == 1
    for edges in ([], [("a", "a")], CHAIN):
        assert impact.report(frame(spark, edges), start(spark, "d")).count() == 0


def test_summary(spark):
    star = frame(spark, [(f"f{i}", "a") for i in range(5)])
    text = impact.summary("a", impact.report(star, start(spark, "a")))
    assert text.split("\n")[1] == "  HIGH risk (5): f0, f1, f2 (and 2 more)" and "affects 5 function(s) across 1 level(s)" in text
    assert "no detected blast radius" in impact.summary("x", impact.report(star, start(spark, "x"))) and "not found" in impact.summary("x", star, False)


def test_paths(spark):
    e = frame(spark, [*DIAMOND, ("a", "d")])
    assert graph.shortest_path(e, "d", "a") == ["d", "b", "a"] and graph.shortest_path(e, "b", "zz") == []
    assert sorted(r[0] for r in impact.simple_paths(e, "d", "a").collect()) == [["d", "b", "a"], ["d", "c", "a"]]
    assert not graph.is_dag(e) and graph.is_dag(frame(spark, DIAMOND)) and graph.is_dag(frame(spark, []))


def test_centrality(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    between = dict(tuple(r) for r in impact.betweenness(nodes, frame(spark, DIAMOND)).collect())
    assert between == {"a": 0.0, "b": pytest.approx(0.5 / 12, abs=1e-6), "c": pytest.approx(0.5 / 12, abs=1e-6), "d": 0.0, "e": 0.0}
    degree = {r[0]: (r[1], r[2]) for r in impact.degree_centrality(nodes, frame(spark, DIAMOND)).collect()}
    assert degree["a"] == (0.5, 0.0) and degree["d"] == (0.0, 0.5) and degree["e"] == (0.0, 0.0)


def hit(path, name, a, b, callers=()):
    return {"file_path": path, "function_name": name, "start_line": a, "end_line": b, "caller_of": list(callers)}


def test_places_of_hits():
    rows = [hit("f", "C", 1, 99), hit("g", "x", 1, 2), hit("f", "C.push", 50, 60), hit("f", "mod", 1, 200)]
    assert [h["function_name"] for h in retrieval.specific_first(rows)] == ["x", "C.push", "C", "mod"]
    top = [hit("a", f"n{i}", 1, 2) for i in range(5)]
    caller, test = hit("b", "app", 5, 9, ["a::n0"]), hit("tests/t.py", "t", 1, 2, ["a::n0"])
    assert [h["function_name"] for h in retrieval.with_caller(top, [*top, test, caller], 5)] == ["n0", "n1", "n2", "n3", "app"]
    assert retrieval.with_caller(top, [*top, test], 5) == top and retrieval.with_caller([], [caller], 5) == [] and retrieval.with_caller(top[:1], [caller], 1) == top[:1]
    assert [h["function_name"] for h in retrieval.with_caller(top[:2], [*top, caller], 5)] == ["n0", "n1", "app"]


def test_snippets():
    big = {"snippet": "class A:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(300)), "language": "python", "start_line": 10, "end_line": 700}
    small = {"snippet": "x = 1", "language": "python", "start_line": 1, "end_line": 1}
    out = retrieval.within_snippets([small, big, small])
    assert out[0]["snippet"] == "x = 1" and out[1]["snippet"].endswith("... [truncated]") and "outline only" in out[1]["snippet"] and len(out) == 2
    assert [len(s["snippet"]) for s in retrieval.within_snippets([small, small], 3)] == [3 + len("\n... [truncated]")]


def test_clusters(spark):
    rows = [(f"k{i:02}", "py" if i < 30 else "go", [1.0, 0.02 * (i % 5), 0.0]) for i in range(40)] + [("odd", "py", [0.3, 1.0, 2.0]), ("zero", "py", [0.0] * 3), ("null", "py", None), ("short", "py", [1.0])]
    df = spark.createDataFrame(rows, "chunk_id string, language string, embedding array<double>")
    assert [clusters.k_of(n) for n in (0, 1, 4, 8, 18, 50, 200)] == [0, 1, 2, 2, 3, 5, 5]
    found = clusters.detect(df).collect()
    assert {r["chunk_id"] for r in found} <= {r[0] for r in rows[:30]} | {"odd"} and all(r["z"] > 2 for r in found)
    assert clusters.detect(df.limit(3)).count() == 0 and clusters.detect(df.limit(0)).count() == 0
    assert {r["chunk_id"] for r in clusters.dominant(df, "language", "chunk_id").collect()} == {r[0] for r in rows if r[1] == "py"}
    assert clusters.representatives(df.limit(5)).count() == 5


def test_window_counts(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:59"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:00:10"), (None, "2024-01-01 00:00:10")], "user_id long, ts string").selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts")
    got = sorted(((r["user_id"], r["start"].minute, r["n"], r["allowed"], r["refused"]) for r in limits.window_counts(df, 1).collect()), key=repr)
    assert got == [(1, 0, 2, 1, 1), (1, 1, 1, 1, 0), (2, 0, 1, 1, 0), (None, 0, 1, 1, 0)]


def test_upsert(spark, tmp_path):
    path, k = str(tmp_path), [0]

    def read():
        return spark.read.parquet(f"{path}/{k[0]}") if k[0] else None

    def write(df):
        df.write.parquet(f"{path}/{k[0] + 1}")
        k[0] += 1

    batch = limits.upsert_into(read, write, "id")
    batch(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), 0)
    batch(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), 1)
    assert sorted(tuple(r) for r in read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
