"""What a change reaches: callers with the path to them, reports, paths between functions, centrality. Edges are (src, dst), distinct.

No edges: no rows. A start that isn't in the graph has no rows. Self-links and repeated edges change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.storage import discard, materialize

#: Fixed values.
MOST_DEPTH, RISKY_CALLERS, RISKY_COMPLEXITY, NAMED = 10, 5, 10, 3
LEVELS = ("HIGH", "MEDIUM", "LOW")


def other_scale(distance: Column) -> Column:
    """The response scale: high for 1, medium for 2 and 3, low beyond."""
    return F.when(distance == 1, "high").when(distance <= 3, "medium").otherwise("low")


def directness(distance: Column, what: str = "caller") -> Column:
    return F.concat(F.when(distance == 1, "direct_").otherwise("indirect_"), F.lit(what))


def is_high_risk(callers: Column, complexity: Column) -> Column:
    return (F.coalesce(callers, F.lit(0)) >= RISKY_CALLERS) | (F.coalesce(complexity, F.lit(0)) >= RISKY_COMPLEXITY)


def call_paths(edges: DataFrame, start: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """node, distance, call_path of all transitive callers; the path starts at the changed node. Of several shortest paths the least stays."""
    step = materialize(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")), "step")
    front = start.select("node", F.array("node").alias("call_path"))
    seen, found = start.select("node"), []
    for hop in range(1, depth + 1):
        new = front.join(step, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min(F.concat("call_path", F.array("b"))).alias("call_path"))
        front = materialize(new.join(seen, "node", "left_anti"), "paths")
        found.append(front.select("node", F.lit(hop).alias("distance"), "call_path"))
        seen = seen.unionByName(front.select("node"))
        if front.isEmpty():
            break
    discard(step)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def report(edges: DataFrame, start: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """position, node, distance, risk, dependents, call_path: by risk, then most dependents, then distance, then node. Depth is held to 1..MOST_DEPTH."""
    hit = call_paths(edges, start, max(1, min(depth, MOST_DEPTH)))
    deg = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    rows = hit.join(deg, "node", "left").select("node", "distance", graph.risk(F.col("distance")).alias("risk"), F.coalesce("dependents", F.lit(0)).cast("long").alias("dependents"), "call_path")
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("risk"))
    return rows.orderBy(level, F.desc("dependents"), "distance", "node")


def summary(changed: str, rows: DataFrame, known: bool = True) -> str:
    """The report in words: counts by risk with the first three names of each. Only the counts and those names reach the driver."""
    if not known:
        return f"Impact analysis unavailable: '{changed}' was not found in the indexed call graph."
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("risk"))
    names = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("dependents")).alias("d"), "distance", "node"))), 1, NAMED)
    # a risk level is bounded by its three best rows before they are collected into a list
    from pyspark.sql import Window

    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("risk").orderBy(F.desc("dependents"), "distance", "node"))).where(F.col("k") <= NAMED)
    totals = rows.groupBy("risk").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    got = totals.join(best.groupBy("risk").agg(names.alias("names")), "risk").orderBy(level).collect()
    if not got:
        return f"Changing '{changed}' has no detected blast radius. No other functions in the indexed codebase call this function directly or transitively."
    lines = [f"Changing '{changed}' affects {sum(r['n'] for r in got)} function(s) across {max(r['far'] for r in got)} level(s) of the call stack."]
    for r in got:
        more = f" (and {r['n'] - NAMED} more)" if r["n"] > NAMED else ""
        lines.append(f"  {r['risk']} risk ({r['n']}): " + ", ".join(x["node"] for x in r["names"]) + more)
    return "\n".join(lines)


def rings(reached: DataFrame) -> DataFrame:
    """Adds place and of: the place of each node on the ring of its distance, and how many stand on it."""
    from pyspark.sql import Window

    ring = Window.partitionBy("distance")
    return reached.withColumn("place", F.row_number().over(ring.orderBy("node"))).withColumn("of", F.count(F.lit(1)).over(ring))


def simple_paths(edges: DataFrame, source, goal, depth: int = 6) -> DataFrame:
    """path: every path from source to goal of at most `depth` edges that repeats no node."""
    kind = dict(edges.dtypes)["src"]
    front = edges.sparkSession.createDataFrame([([source],)], f"path array<{kind}>")
    step = materialize(edges, "step")
    done = []
    for _ in range(depth):
        last = F.element_at("path", -1)
        front = front.join(step, last == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        front = materialize(front.distinct(), "paths")
        done.append(front.where(F.element_at("path", -1) == goal))
        front = front.where(F.element_at("path", -1) != goal)
        if front.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def degree_centrality(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node, in_centrality, out_centrality: degrees over the number of other nodes, 6 places; 1 for the only node."""
    n = nodes.count()
    share = lambda c: F.round(F.col(c) / max(n - 1, 1) if n > 1 else F.lit(1.0), 6)
    return graph.degrees(nodes.select(F.col(node).alias("node")), edges).select("node", share("in_degree").alias("in_centrality"), share("out_degree").alias("out_centrality"))


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int = 500, most: int = 100, node: str = "node") -> DataFrame:
    """node, betweenness, 6 places: the share of shortest directed paths through a node, over all pairs of others.

    Up to `pivots` nodes every one is a source. Beyond, `most` sources are drawn by a hash of the node, the same in each run,
    and the sum is scaled, which is an estimate. Sources run side by side: forward, their paths are counted level by level; then
    their dependencies flow back. Rows: (source, node) that a source reaches.
    """
    n = nodes.count()
    all_ = nodes.select(F.col(node).alias("node"))
    sources = all_ if n <= pivots else all_.orderBy(F.xxhash64("node"), "node").limit(most)
    k = n if n <= pivots else min(most, n)
    step = materialize(edges.where("src <> dst").distinct(), "step")
    levels = [materialize(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("ways")), "level")]
    seen = levels[0].select("s", "node")
    while True:
        new = levels[-1].join(step, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        new = materialize(new.join(seen, ["s", "node"], "left_anti"), "level")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("s", "node"))
    below = None
    parts = []
    for level in reversed(levels):
        if below is None:
            own = level.withColumn("d", F.lit(0.0))
        else:
            back = below.select("s", F.col("node").alias("c"), F.col("ways").alias("wc"), F.col("d").alias("dc")).join(step, F.col("c") == F.col("dst")).select("s", F.col("src").alias("node"), "wc", "dc")
            got = level.join(back, ["s", "node"]).groupBy("s", "node").agg(F.sum(F.col("ways") / F.col("wc") * (1 + F.col("dc"))).alias("d"))
            own = level.join(got, ["s", "node"], "left").select("s", "node", "ways", F.coalesce("d", F.lit(0.0)).alias("d"))
        below = materialize(own, "level")
        parts.append(below.where(F.col("s") != F.col("node")).select("node", "d"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    scale = (n / k if k else 0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    by = total.groupBy("node").agg(F.sum("d").alias("d"))
    return all_.join(by, "node", "left").select("node", F.round(F.coalesce("d", F.lit(0.0)) * scale, 6).alias("betweenness"))


def nearest(results: DataFrame) -> DataFrame:
    """One row a node of several results (node, distance, and what else): the least distance, then the least of the rest."""
    rest = [c for c in results.columns if c not in ("node", "distance")]
    by = results.groupBy("node").agg(F.min(F.struct("distance", *rest)).alias("x"))
    return by.select("node", "x.*")


def nodes_of_file(nodes: DataFrame, path: str, file: str = "file_path", line: str = "start_line") -> DataFrame:
    """The nodes whose path starts with, or else holds, the given one, by line."""
    return nodes.where(F.col(file).startswith(path) | F.col(file).contains(path)).orderBy(line, "node")
