"""Similarity search and score fusion over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero; null where either is null."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(F.try_divide(dot(a, b), size))


def search(vectors: DataFrame, query: list[float], k: int = 30, least: float | None = 0.5, where: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, score of the k nearest by cosine, those at or over `least`; filters apply before the scores. The query is a literal, so the scan needs no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if where is None else vectors.where(where)
    hits = rows.select(F.col(key), F.round(cosine(F.col(vector), q), 6).alias("score"))
    hits = hits if least is None else hits.where(F.col("score") >= least)
    return hits.orderBy(F.desc("score"), key).limit(k)


def fuse(a: DataFrame, b: DataFrame, k: int, weight: float = 0.7, key: str = "vec_id") -> DataFrame:
    """Full outer join of two hit lists; a missing score is 0."""
    both = a.select(key, F.col("score").alias("sa")).join(b.select(key, F.col("score").alias("sb")), key, "full_outer")
    score = F.round(weight * F.coalesce("sa", F.lit(0.0)) + (1 - weight) * F.coalesce("sb", F.lit(0.0)), 6)
    return both.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def with_centrality(hits: DataFrame, callers: DataFrame, weight: float = 0.7, key: str = "vec_id") -> DataFrame:
    """hybrid = weight * similarity + the rest * min(callers / 10, 1)."""
    rows = hits.join(callers, key, "left").withColumn("structural", F.least(F.coalesce("in_degree", F.lit(0)) / 10.0, F.lit(1.0)))
    return rows.select(key, "score", F.round("structural", 6).alias("structural"), F.round(weight * F.col("score") + (1 - weight) * F.col("structural"), 6).alias("hybrid"))


def outliers(vectors: DataFrame, over: float = 2.0, cluster: str = "label", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, cluster, z: distance to the cluster's mean over the spread of those distances (1 for a single member), where z > over.

    The mean is taken per dimension over exploded components, so a hot cluster is combined before the shuffle.
    """
    parts = vectors.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    far = vectors.join(centre, cluster).select(key, cluster, F.sqrt(F.aggregate(F.zip_with(vector, "centre", lambda x, c: (x.cast("double") - c) * (x.cast("double") - c)), F.lit(0.0), lambda s, x: s + x)).alias("d"))
    spread = far.groupBy(cluster).agg(F.when(F.count(F.lit(1)) == 1, 1.0).otherwise(F.greatest(F.stddev_pop("d"), F.lit(1e-8))).alias("s"))
    z = F.round(F.col("d") / F.col("s"), 4)
    return far.join(spread, cluster).select(key, cluster, z.alias("z")).where(F.col("z") > over)
