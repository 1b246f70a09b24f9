"""The call-graph queries of the catalog against plain Python over whole tables, which shares no filter with their SQL."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import pairwise

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.plans import catalog
from tests.conftest import SF


def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def parts():
    return pd.read_parquet(f"{SF}/part.parquet")


@pytest.fixture(scope="module")
def edges():
    """Every two neighbouring lines of an order, whatever their quantity."""
    orders = defaultdict(list)
    for row in pd.read_parquet(f"{SF}/lineitem.parquet").itertuples(index=False):
        orders[row.l_orderkey].append((row.l_linenumber, row.l_partkey, row.l_suppkey, row.l_extendedprice))
    return {(a[1], b[1]) for lines in orders.values() for a, b in pairwise(sorted(lines)) if a[1] != b[1]}


def near(edges, start, depth):
    step = defaultdict(set)
    for a, b in edges:
        step[a].add(b)
    found, front = {}, {start}
    for hop in range(1, depth + 1):
        front = {b for a in front for b in step[a]} - set(found) - {start}
        found |= dict.fromkeys(front, hop)
    return found


def run(spark, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()]


def test_edges_are_whole(spark, edges):
    assert {tuple(r) for r in catalog._edges(tables(spark)).collect()} == edges


def test_degrees_hubs_and_entry_points_are_whole(spark, edges, parts):
    nodes, ins, outs = set(parts.p_partkey), Counter(b for _, b in edges), Counter(a for a, _ in edges)
    assert sorted(run(spark, "degrees")) == sorted((n, ins[n], outs[n]) for n in nodes)
    assert run(spark, "hubs") == sorted(ins.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert {n for (n,) in run(spark, "entry_points")} == nodes - set(ins)
    assert run(spark, "graph_stats") == [(len(nodes), len(edges), round(len(edges) / len(nodes), 6))]


def test_reach_is_whole(spark, edges):
    back, ins = {(b, a) for a, b in edges}, Counter(b for _, b in edges)
    assert dict(run(spark, "callers_bfs")) == near(back, 1, 3)
    assert dict(run(spark, "callees_bfs")) == near(edges, 1, 2)
    risk = {1: "HIGH", 2: "MEDIUM"}
    assert set(run(spark, "impact_risk")) == {(n, d, risk.get(d, "LOW"), ins[n]) for n, d in near(back, 1, 4).items()}
    assert set(run(spark, "distance_scores")) == {(n, d, round(max(0.0, 1 - 0.2 * (d - 1)), 6)) for n, d in near(back, 1, 3).items()}


def test_expansion_and_centrality_are_whole(spark, edges):
    want = []
    for seed in (1, 2, 3):
        found = sorted((b for a, b in edges if a == seed), key=lambda b: (b % 2, b))
        want += [(seed, b, k, round(0.9 / seed, 6)) for k, b in enumerate(found[:4], 1)]
    assert sorted(run(spark, "neighbour_expansion")) == sorted(want)
    ins = Counter(b for _, b in edges)
    got = catalog.QUERIES["centrality_hybrid"](spark, SF).select("vec_id", "structural").collect()
    assert len(got) == 30 and all(r["structural"] == round(min(ins[r["vec_id"]] / 10, 1.0), 6) for r in got)


def test_call_edges_are_whole(spark, parts):
    by_name = defaultdict(set)
    for row in parts.itertuples(index=False):
        by_name[row.p_name, row.p_brand].add(row.p_partkey)
    assert set(run(spark, "call_edges")) == {(a, b) for same in by_name.values() for a in same for b in same if a != b}


def shuffled(spark):
    """Rows written to shuffle files by the stages so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_pairs_of_one_name_are_not_shuffled(spark):
    nodes = spark.createDataFrame([(i, "close" if i < 600 else f"f{i}") for i in range(700)], "node long, name string")
    before = shuffled(spark)
    hit = graph.resolve_calls(nodes.withColumnRenamed("node", "src"), nodes).agg(F.count(F.lit(1)), F.countDistinct("src"), F.min(F.abs(F.col("src") - F.col("dst")))).first()
    assert tuple(hit) == (600 * 599, 600, 1)
    written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert written < 20_000, written  # of 359,400 pairs


@pytest.mark.parametrize("cell", [1, 3, 10, graph.CELL])
def test_cells_hold_every_pair_once(spark, cell):
    """Repeated rows, nodes and callers of several names, a name with many of one side only, and nulls."""
    defs = [(i, "get") for i in range(25)] + [(i, "set") for i in range(20, 30)] + [(3, "get"), (7, "run"), (8, "run"), (None, "get"), (9, None), (40, "unused")]
    calls = [(i, n) for i in range(12) for n in ("get", "set")] + [(i, "run") for i in range(60)] + [(1, "get"), (2, "run"), (None, "get"), (5, None), (5, "missing")]
    got = graph.resolve_calls(spark.createDataFrame(calls, "src long, name string"), spark.createDataFrame(defs, "node long, name string"), cell).collect()
    want = {(a, b) for a, n in calls for b, m in defs if None not in (a, b, n, m) and n == m and a != b}
    assert sorted(map(tuple, got)) == sorted(want)


def test_stub_nodes_are_the_parts_without_a_vector(spark, tmp_path):
    lines = [(1, part, 1, n, 1.0, 1.0) for n, part in enumerate([3, 6, 7, 3, 9, 9], 1)] + [(2, 12, 1, 1, 50.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3,), (7,), (50,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(3,), (6,), (7,), (9,), (12,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(tuple(r) for r in catalog.QUERIES["stub_nodes"](spark, str(tmp_path)).collect()) == [(6,), (9,)]


def test_pagerank_has_converged(spark, edges, parts):
    nodes, out, step = sorted(parts.p_partkey), Counter(a for a, _ in edges), defaultdict(list)
    for a, b in edges:
        step[b].append(a)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        loose = sum(r for n, r in rank.items() if not out[n])
        rank, old = {n: (0.15 + 0.85 * loose) / len(nodes) + 0.85 * sum(rank[a] / out[a] for a in step[n]) for n in nodes}, rank
        if sum(abs(rank[n] - old[n]) for n in nodes) < 1e-6 * len(nodes):
            break
    got = dict(run(spark, "pagerank"))
    assert set(got) == set(nodes) and all(abs(got[n] - rank[n]) < 1e-6 for n in nodes)
