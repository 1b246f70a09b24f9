"""Clusters of vectors and what stands out of them: k-means, summaries, outliers with severity, representatives of a large scope.

Vectors that are null, empty or zero, or of another length than most, take no part. Fewer than LEAST vectors: no clusters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import vectors as vx

LEAST, SEED, SAMPLE = 4, 42, 40


def k_of(n: int) -> int:
    """max(2, min(floor(sqrt(n / 2)), 5)), at most n."""
    return min(n, max(2, min(math.isqrt(n // 2) if n > 1 else 0, 5)))


def severity(z: Column) -> Column:
    return F.when(z >= 4, "severe").when(z >= 3, "moderate").otherwise("minor")


def dominant(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The rows of the most frequent group; on ties of the one that comes first by `order`."""
    top = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first")).orderBy(F.desc("__n"), "__first").limit(1)
    return rows.join(top.select(group), group, "left_semi")


def normalised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with usable vectors, each of length one."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(vx.dot(F.col("__v"), F.col("__v")))
    out = rows.withColumn("__v", v).withColumn("__s", size).where((F.col("__s") > 0) & ~F.isnan("__s") & (F.col("__s") < float("inf")))
    usual = out.groupBy(F.size("__v").alias("n")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "n").limit(1).collect()
    out = out.where(F.size("__v") == (usual[0]["n"] if usual else 0))
    return out.withColumn(vector, F.transform("__v", lambda x: F.try_divide(x, F.col("__s")))).drop("__v", "__s")


def assign(rows: DataFrame, k: int, vector: str = "embedding", seed: int = SEED) -> DataFrame:
    """Adds cluster: k-means on unit vectors with k-means|| seeding, the same in each run for the same partitions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    wide = rows.withColumn("__features", array_to_vector(F.col(vector)))
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster", maxIter=50).fit(wide)
    return model.transform(wide).drop("__features")


def with_distance(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds distance: to the mean of the row's cluster. Means are taken by component, so a large cluster is combined before the shuffle."""
    parts = rows.select("cluster", F.posexplode(vector).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    centre = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("__c"))
    gap = F.aggregate(F.zip_with(vector, "__c", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)
    return rows.join(centre, "cluster").withColumn("distance", F.sqrt(gap)).drop("__c")


def spread(distance: str = "distance") -> Column:
    """Population deviation of the distances; 1 for a single member, 1e-8 at least."""
    return F.when(F.count(F.lit(1)) == 1, 1.0).otherwise(F.greatest(F.stddev_pop(distance), F.lit(1e-8)))


def summaries(placed: DataFrame, key: str) -> DataFrame:
    """cluster, size, spread, closest (three keys), largest cluster first."""
    w = Window.partitionBy("cluster").orderBy("distance", key)
    near = placed.withColumn("__k", F.row_number().over(w)).where("__k <= 3").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", key))), lambda s: s[key]).alias("closest"))
    by = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), spread().alias("spread"))
    return by.join(near, "cluster").orderBy(F.desc("size"), "cluster")


def outliers(placed: DataFrame, key: str, over: float = 2.0) -> DataFrame:
    """key, cluster, z, severity of rows whose distance is more than `over` spreads, farthest first."""
    by = placed.groupBy("cluster").agg(spread().alias("s"))
    z = F.round(F.col("distance") / F.col("s"), 4)
    return placed.join(by, "cluster").select(key, "cluster", z.alias("z")).where(F.col("z") > over).withColumn("severity", severity(F.col("z"))).orderBy(F.desc("z"), key)


def detect(chunks: DataFrame, key: str = "chunk_id", language: str = "language", vector: str = "embedding") -> DataFrame:
    """Outliers among the chunks of the dominant language: key, cluster, z, severity. Fewer than LEAST chunks, before or after the filter: none."""
    schema = f"{key} {dict(chunks.dtypes)[key]}, cluster int, z double, severity string"
    none = chunks.sparkSession.createDataFrame([], schema)
    rows = normalised(chunks, vector)
    if rows.count() < LEAST:
        return none
    rows = dominant(rows, language, key)
    n = rows.count()
    if n < LEAST:
        return none
    return outliers(with_distance(assign(rows, k_of(n), vector), vector), key)


def describe(found: DataFrame, key: str = "chunk_id", named: int = 10) -> str:
    rows = found.orderBy(F.desc("z"), key).limit(named).collect()
    if not rows:
        return "No inconsistent chunks found."
    return "\n".join([f"{found.count()} chunk(s) differ from their cluster:", *(f"  {r[key]} (z={r['z']:.2f}, {r['severity']})" for r in rows)])


def analytical_score(similarity: Column, z: Column) -> Column:
    """0.7 of the similarity and 0.3 of min(1, z / 5), z null for what is no outlier."""
    return 0.7 * similarity + 0.3 * F.coalesce(F.least(F.lit(1.0), z / 5.0), F.lit(0.0))


def representatives(rows: DataFrame, key: str = "chunk_id", vector: str = "embedding", most: int = SAMPLE) -> DataFrame:
    """All rows of a scope of at most `most`; of a larger one the member nearest to each of `most` centres. This is the feature: a sample to be read."""
    usable = normalised(rows, vector)
    if usable.count() <= most:
        return rows
    placed = with_distance(assign(usable, most, vector), vector)
    w = Window.partitionBy("cluster").orderBy("distance", key)
    best = placed.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(key)
    return rows.join(best, key, "left_semi")
