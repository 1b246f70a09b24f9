"""Snapshots, budgets, limits, history and evaluation as window and join operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import discard, materialize


def snapshot_diff(old: DataFrame, new: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """path, change of two listings: added, modified or deleted; unchanged paths are left out."""
    o, n = old.select(F.col(path), F.col(digest).alias("a")), new.select(F.col(path), F.col(digest).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return o.join(n, path, "full_outer").select(path, change.alias("change")).where("change IS NOT NULL")


def renames(old: DataFrame, new: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """old_path, new_path: deleted and added paths of one digest, paired in order of path."""
    number = lambda df, as_: df.select(F.col(digest), F.col(path).alias(as_), F.row_number().over(Window.partitionBy(digest).orderBy(path)).alias("k"))
    gone, come = old.join(new.select(path), path, "left_anti"), new.join(old.select(path), path, "left_anti")
    return number(gone, "old_path").join(number(come, "new_path"), [digest, "k"]).select("old_path", "new_path")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def ring(rows: DataFrame, keys: list[str], keep: int, *order: Column) -> DataFrame:
    """The first `keep` rows of each key, with their rank as `position`."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= keep)


def rate_limited(requests: DataFrame, limit: int, window: str, client: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Adds n_in_window (running count of the client in the fixed window) and allowed."""
    w = Window.partitionBy(client, F.date_trunc(window, F.col(ts))).orderBy(ts, key).rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("n_in_window", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("n_in_window") <= limit)


def within_budget(rows: DataFrame, keys: list[str], cost: Column, budget: int, *order: Column) -> DataFrame:
    """Rows in order until the running cost first passes the budget; the first row of each key always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    spent = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).withColumn("__k", F.row_number().over(w)).where((F.col("spent") <= budget) | (F.col("__k") == 1)).drop("__k")


def percentile_rows(rows: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """Nearest-rank percentiles: the value at place round_half_even(p / 100 * (n - 1)) of each key."""
    w = Window.partitionBy(*keys)
    numbered = rows.select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    picks = [F.max(F.when(F.col("i") == F.bround(F.lit(p / 100.0) * (F.col("n") - 1), 0).cast("long"), F.round(value, 3))).alias(f"p{p}") for p in percents]
    return numbered.groupBy(*keys).agg(*picks, F.round(F.avg(value), 3).alias("mean"), F.round(F.max(value), 3).alias("max"), F.count(F.lit(1)).alias("n"))


def container_order(rows: DataFrame, path: str = "file", first: str = "start", last: str = "end", rank: str = "rank") -> DataFrame:
    """Adds position: a row stands half a place after the last-placed of what it strictly contains in its file, level by level.

    Equal ranges don't contain each other. Rows that repeat are rows of their own. A null path or end contains nothing. One round
    for each level of nesting.
    """
    range_ = lambda p: [F.col(path).alias(p + "f"), F.col(first).alias(p + "a"), F.col(last).alias(p + "b")]
    distinct = rows.groupBy(path, first, last).agg(F.max(F.col(rank).cast("double")).alias("__p"))
    outer, inner = distinct.select(*range_("o")), distinct.select(*range_("i"))
    inside = (F.col("of") == F.col("if")) & (F.col("oa") <= F.col("ia")) & (F.col("ib") <= F.col("ob")) & ((F.col("oa") != F.col("ia")) | (F.col("ob") != F.col("ib")))
    held = materialize(outer.join(inner, inside), "nested")
    # the place of what a range holds, without its own rank; a row's own rank joins at the end
    place = materialize(distinct, "place")
    while True:
        of = place.select(*range_("p"), F.col("__p").alias("pp"))
        up = held.join(of, (F.col("if") == F.col("pf")) & (F.col("ia") == F.col("pa")) & (F.col("ib") == F.col("pb"))).groupBy("of", "oa", "ob").agg((F.max("pp") + 0.5).alias("up"))
        bare = place.drop("up")
        new = materialize(bare.join(up, bare[path].eqNullSafe(up["of"]) & bare[first].eqNullSafe(up["oa"]) & bare[last].eqNullSafe(up["ob"]), "left").select(path, first, last, F.greatest("__p", "up").alias("__p"), "up"), "place")
        changed = place.select(F.sum("__p")).first()[0] != new.select(F.sum("__p")).first()[0]
        discard(place)
        place = new
        if not changed:
            break
    up = place.select(*range_("p"), "up")
    out = rows.join(up, rows[path].eqNullSafe(up["pf"]) & rows[first].eqNullSafe(up["pa"]) & rows[last].eqNullSafe(up["pb"]), "left")
    return out.select(*[rows[c] for c in rows.columns], F.greatest(rows[rank].cast("double"), F.coalesce("up", F.lit(-1.0))).alias("position"))
