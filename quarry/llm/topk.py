"""Exact top-k inner-product search: a grid of query groups and vector cells, a ball tree per cell, branch and bound.

Vectors are dealt to cells by hash and queries to groups, each of at most about VALUES components; every group meets every cell
once, in a task of its own that holds the two and nothing else. So a query is sent once to each cell and a vector once to each
group, as rows (two bytes a component where floor(256 * x) fits): 15 million vectors with 64 components make 129 cells
and 3 groups. Nothing passes the driver but the largest component, and a row for each length of vectors.

In a cell, a node of the tree bounds the inner product with a query q by q . centre + |q| * radius. BLOCK queries go
down the tree together: at every node the queries whose bound is under their current k-th score leave, each of the others sees the
child with its own higher bound first, and leaves are multiplied as matrices. Ties go to the smaller vec_id; bounds
keep equality for that.

Vectors that are null or hold null or non-finite components take no part. A query meets candidates of its own length only.
Rows that repeat an id, or id and vector, are rows like others: each is a query, and a candidate for all rows but itself. Equal
rows are aggregated first: of more than k + 1 of them a list can't hold more, and all of them have the same list, which is
searched once. No rows: no rows. Scores are exact integers; where they could pass 2**53 they are summed as Python integers (beyond 64 bits: the limit of long).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import materialize

#: Components of a cell, and of a group (64 MB as doubles); ROW counts for the rest of a row.
VALUES, ROW = 1 << 23, 8
#: A small table is cut into cells of SHARD rows or more, to keep all tasks busy.
SHARD, BLOCK, LEAF, SCALE = 4096, 2048, 128, 256.0
K, EVERY = 5, 50
EXACT = 2.0**53


class Ball:
    """A node: centre, radius and either two children or the places of its points, ascending by id; of equal points only the first `most`."""

    __slots__ = ("centre", "radius", "children", "points")

    def __init__(self, x: np.ndarray, points: np.ndarray, most: int):
        own = x[points]
        self.centre = own.mean(0)
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(1)).max())
        self.children, self.points = (), points
        if self.radius == 0:
            self.points = points[:most]
        elif len(points) > LEAF:
            far = own[np.argmax(((own - self.centre) ** 2).sum(1))]
            along = (own - self.centre) @ (far - self.centre)
            order = np.argsort(along, kind="stable")
            half = len(points) // 2
            self.children = (Ball(x, np.sort(points[order[:half]]), most), Ball(x, np.sort(points[order[half:]]), most))


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.kth = np.full(n, -np.inf)

    def merge(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        if score.shape[1] > 4 * k:  # all that reach the k-th best, then in order
            edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            keep = (score >= np.maximum(edge, self.kth[rows])[:, None]).sum(1).max()
            order = np.argsort(-score, axis=1, kind="stable")[:, :keep]
            score, ids = np.take_along_axis(score, order, 1), ids[order]
        else:
            ids = np.broadcast_to(ids, score.shape)
        score = np.concatenate([self.score[rows], score], 1)
        ids = np.concatenate([self.id[rows], ids], 1)
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        self.kth[rows] = np.maximum(self.kth[rows], self.score[rows][:, -1])


def descend(node: Ball, x: np.ndarray, ids: np.ndarray, q: np.ndarray, norms: np.ndarray, own: np.ndarray, rows: np.ndarray, best: Best) -> None:
    if not len(rows):
        return
    bound = q[rows] @ node.centre + norms[rows] * node.radius
    rows = rows[bound + 1e-6 * (1 + np.abs(bound)) >= best.kth[rows]]
    if not len(rows):
        return
    if node.children:
        left, right = node.children
        first = q[rows] @ (left.centre - right.centre) + norms[rows] * (left.radius - right.radius) >= 0
        descend(left, x, ids, q, norms, own, rows[first], best)
        descend(right, x, ids, q, norms, own, rows, best)
        descend(left, x, ids, q, norms, own, rows[~first], best)
        return
    score = q[rows] @ x[node.points].T
    mine = own[rows][:, None] == node.points  # a query isn't its own candidate
    best.merge(rows, np.where(mine, -np.inf, score), ids[node.points])


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (-inf: none) and ids of the k best of x, which is ascending by id, for each of q; own holds a query's own place or -1."""
    tree, norms, best = Ball(x, np.arange(len(ids)), k + 1), np.sqrt((q * q).sum(1)), Best(len(q), k)
    for at in range(0, len(q), BLOCK):
        descend(tree, x, ids, q, norms, own, np.arange(at, min(at + BLOCK, len(q))), best)
    return best.score, best.id


def search_exact(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[list[list[int]], list[list[int]]]:
    """The same without bounds in Python integers, for components so large that doubles would round; lists end where no candidate is left."""
    top: list[list[tuple[int, int]]] = [[] for _ in q]
    for at in range(0, len(x), SHARD):
        vx = [[int(c) for c in v] for v in x[at : at + SHARD]]
        for a, v in enumerate(q):
            w = [int(c) for c in v]
            top[a] = heapq.nsmallest(k, top[a] + [(-sum(map(int.__mul__, w, c)), int(ids[at + j])) for j, c in enumerate(vx) if at + j != own[a]])
    return [[max(-(2**63), min(2**63 - 1, -s)) for s, _ in t] for t in top], [[i for _, i in t] for t in top]


def vectors_of(e: pa.ChunkedArray, dim: int) -> np.ndarray:
    """floor(256 * x) of the vectors as doubles; integers are that already."""
    flat = e.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.astype("f8").reshape(len(e), dim)
    return x if flat.dtype.kind == "i" else np.floor(SCALE * x)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by `every`, against all rows but itself."""
    e = F.col("e")
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(kind).alias("e"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & e.isNotNull() & ~bad)
    most = rows.agg(F.max(F.array_max(F.transform(e, F.abs)))).first()[0] or 0.0
    if most * SCALE < 2**15 - 1:
        rows = rows.withColumn("e", F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(SCALE)).cast("short")))
    # a table: row numbers stay what they are, and it is aggregated once for its three readers
    rows = materialize(rows.groupBy("id", "e").agg(F.count(F.lit(1)).alias("times")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    rows = rows.withColumn("dim", F.size("e"))
    parts, size = F.lit(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.col("dim") + ROW
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("m")).where("m > 0")
    cells = F.greatest(F.ceil(F.col("n") * size / VALUES), F.least(4 * parts, F.ceil(F.col("n") / SHARD))).cast("int")
    # lengths are few: d of them take d * d / 2 components
    sizes = F.broadcast(sizes.select("dim", cells.alias("cells"), F.ceil(F.col("m") * size / VALUES).cast("int").alias("groups")))
    rows, key = rows.join(sizes, "dim"), F.xxhash64("id", "e")
    cell, group = F.pmod(key, F.col("cells")).cast("int").alias("cell"), F.pmod(F.xxhash64(key), F.col("groups")).cast("int").alias("group")
    right = rows.select("dim", cell, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "row", "id", "e", "times")
    left = rows.where(F.col("id") % every == 0).select("dim", group, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "row", "id", "e", "times").toDF("q_dim", "q_group", "q_cell", "q", "q_id", "q_e", "q_times")
    out = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("times", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out.empty_table()
        dim, right = left.column("q_dim")[0].as_py(), right.sort_by([("id", "ascending"), ("row", "ascending")])
        copies = np.minimum(right.column("times").to_numpy(), k + 1)
        place = dict(zip(right.column("row").to_numpy().tolist(), (np.cumsum(copies) - copies).tolist(), strict=True))
        own = np.array([place.get(r, -1) for r in left.column("q").to_numpy().tolist()])
        x, q = vectors_of(right.column("e"), dim), vectors_of(left.column("q_e"), dim)
        ids = right.column("id").to_numpy()
        if copies.max() > 1:
            ids, x = np.repeat(ids, copies), np.repeat(x, copies, axis=0)
        if dim and max(1.0, float(np.abs(q).max())) * max(1.0, float(np.abs(x).max())) * dim >= EXACT:
            score, found = search_exact(x, ids, q, own, k)
            n = [len(s) for s in score]
            score, found = np.array([v for s in score for v in s], "i8"), np.array([v for f in found for v in f], "i8")
        else:
            score, found = search(x, ids, q, own, k)
            good = np.isfinite(score)
            n, score, found = good.sum(1), score[good].astype("i8"), found[good]
        return pa.table([np.repeat(left.column(c).to_numpy(), n) for c in ("q", "q_id", "q_times")] + [found, score], schema=out)

    found = left.groupBy("q_dim", "q_group", "q_cell").cogroup(right.groupBy("dim", "group", "cell")).applyInArrow(meet, "query long, query_id long, times long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM v),
s AS (SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM f q JOIN f c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
