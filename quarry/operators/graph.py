"""Call graph: construction by name resolution, degrees, traversals, paths, centrality. Edges are (src, dst), distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import discard, materialize


#: Calls and definitions of one name meet in cells of about this many by as many.
CELL = 4096


def resolve_calls(calls: DataFrame, definitions: DataFrame, cell: int = CELL) -> DataFrame:
    """src, dst: every call (src, name) to every definition (node, name) of that name, without self-links.

    There can be very many pairs, so they aren't shuffled: both sides are distinct before they meet, and only pairs with nodes of several
    names, which can share more than one with a caller, are made distinct after. A name's pairs are dealt out as a grid of cells.
    """
    calls = calls.select("src", "name").where("src IS NOT NULL AND name IS NOT NULL").distinct()
    named = definitions.select(F.col("node").alias("dst"), "name").where("dst IS NOT NULL AND name IS NOT NULL").repartition("dst").distinct()
    named = named.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("dst")) > 1)
    sizes = [df.groupBy("name").agg(F.count(F.lit(1)).alias(n)) for df, n in ((calls, "m"), (named, "n"))]
    large = sizes[0].join(sizes[1], "name").where((F.col("m") > cell) | (F.col("n") > cell))
    large = F.broadcast(large.select("name", F.ceil(F.col("m") / cell).alias("rows"), F.ceil(F.col("n") / cell).alias("columns")))
    tasks = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, or few tasks would make all pairs of a small table

    def dealt(df: DataFrame, node: str, own: str, other: str) -> DataFrame:
        of = lambda n: F.coalesce(F.col(n), F.lit(1))
        df = df.join(large, "name", "left").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), of(other) - 1)))
        return df.withColumn(own, F.pmod(F.xxhash64(node), of(own))).repartition(tasks, "name", "rows", "columns")

    calls, named = dealt(calls, "src", "rows", "columns"), dealt(named, "dst", "columns", "rows")
    once, more = (calls.join(named.where(x).hint("merge"), ["name", "rows", "columns"]).where("src <> dst").select("src", "dst") for x in ("NOT several", "several"))
    return once.unionByName(more.distinct())


def stub_nodes(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """End points of edges that aren't nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(node)).distinct()
    return ends.join(nodes.select(node), node, "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """in_degree and out_degree of each node, 0 without edges. One shuffle of the edge ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    by = ends.groupBy("n").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.join(by, nodes[node] == by["n"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


def entry_points(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias(node)).distinct(), node, "left_anti")


def hubs(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree")).orderBy(F.desc("in_degree"), "node").limit(n)


def reach(edges: DataFrame, start: DataFrame, depth: int, backwards: bool = False) -> DataFrame:
    """node, distance within `depth` hops of the start nodes (which are left out). A hop is one join with the frontier."""
    step = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")) if backwards else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    step = materialize(step, "step")  # read by each hop, made once
    seen = start.select("node", F.lit(0).alias("distance"))
    frontier = seen
    for hop in range(1, depth + 1):
        new = frontier.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = materialize(new.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(hop)), "graph")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def shortest_path(edges: DataFrame, source, goal, depth: int = 10) -> list:
    """Nodes of the shortest directed path, the least one in order of nodes on ties; empty if there is none within depth."""
    frontier = edges.sparkSession.createDataFrame([(source, [source])], f"node {dict(edges.dtypes)['src']}, path array<{dict(edges.dtypes)['src']}>")
    seen = frontier.select("node")
    for _ in range(depth):
        if (hit := frontier.where(F.col("node") == goal).agg(F.min("path")).first()[0]) is not None:
            return hit
        new = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = materialize(new.join(seen, "node", "left_anti"), "graph")
        seen = seen.unionByName(frontier.select("node"))
    return frontier.where(F.col("node") == goal).agg(F.min("path")).first()[0] or []


def risk(distance: Column) -> Column:
    return F.when(distance == 1, "HIGH").when(distance == 2, "MEDIUM").otherwise("LOW")


def impact(edges: DataFrame, start: DataFrame, depth: int = 4) -> DataFrame:
    """node, distance, risk, dependents (in-degree) of all transitive callers."""
    hit = reach(edges, start, depth, backwards=True)
    deg = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    return hit.join(deg, "node", "left").select("node", "distance", risk(F.col("distance")).alias("risk"), F.coalesce("dependents", F.lit(0)).cast("long").alias("dependents"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, node: str = "node") -> DataFrame:
    """node, rank; the mass of nodes without callees is spread over all. Ends when the ranks of a round differ by less than tolerance a node on average, or after `rounds`.

    No nodes: no rows. Edges to or from what isn't a node are ignored.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    base = materialize(nodes.select(F.col(node).alias("node")).join(out, F.col("node") == F.col("src"), "left").select("node", "n_out"), "base")
    given_by = materialize(edges.repartition("src"), "step")
    n = base.count()
    ranks = materialize(base.withColumn("rank", F.lit(1.0 / max(n, 1))), "ranks")
    for _ in range(rounds):
        given = ranks.join(given_by, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        loose = ranks.where("n_out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        new = F.lit((1 - damping + damping * loose) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))
        moved = ranks.join(given, F.col("node") == F.col("dst"), "left").select("node", "n_out", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))
        moved = materialize(moved, "ranks")
        change = moved.agg(F.sum("moved")).first()[0] or 0.0
        discard(ranks)
        ranks = moved
        if change < tolerance * n:
            break
    discard(given_by, base)
    return ranks.select("node", "rank")


def is_dag(edges: DataFrame) -> bool:
    """Kahn's removal of nodes without callers, all of a layer at once."""
    while True:
        left = materialize(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "graph")
        n, m = edges.count(), left.count()
        if m == 0 or m == n:
            return m == 0
        edges = left


def resolve_node(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """The one best node for a name: exact id, then id without case, then equal name, then prefix, then substring; most callers first, then least id. nodes has node and name."""
    q = query.lower()
    score = F.when(F.col("node") == query, 1).when(F.lower("node") == q, 2).when(F.lower("name") == q, 3).when(F.lower("name").startswith(q), 4).when(F.lower("node").contains(q), 5)
    deg = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    return nodes.select("node", "name", score.alias("bucket")).where("bucket IS NOT NULL").join(deg, "node", "left").orderBy("bucket", F.desc(F.coalesce("d", F.lit(0))), "node").limit(1).select("node", "bucket")
