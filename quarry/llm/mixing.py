"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source shuffles its documents by a hash of their id. A pass over a source repeats that order; the virtual finish time of
a document in pass k is (k * source size + running size up to and with the document) / target. All finish times, of all
sources, are sorted together and cut where the running total passes the budget, which is the size of the corpus.

No running total is taken over a whole source: rows fall into buckets by leading digits of their hash, bucket sums give each
bucket its start, and a window runs within one bucket of one source. The cut works alike: sums by slice of finish time find
the slice where the budget runs out, and only that slice is sorted.

Null text: size 0. Size 0: taken 0. Null source: a source of its own, sorted last. No rows: no rows. Repeated rows: each has
its place in the queue (rows that are equal in id and size are interchangeable). Extra columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import word_count
from quarry.storage import materialize

WEIGHTS = (5, 2, 1)
PASSES = 3
#: Rows in a bucket of one source, about; buckets grow with the corpus.
BUCKET_ROWS = 4000
#: Slices of finish time around 1 that the cut looks at.
SLICES = 1 << 20


def shuffled(doc_id: Column) -> Column:
    """A number of 60 bits from the id, the same in every run and in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = PASSES) -> DataFrame:
    """source, source_size, target of each source. sizes has source and size.

    Level filling: a source gets weight * level, at most cap * its size; the level rises until the shares add up to the
    budget. Each round fixes the sources that are over their cap, so it ends after as many rounds as sources change sides.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    by = materialize(by.withColumn("weight", weight.cast("long")), "mix-sources")
    total, level = by.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while total:
        full = F.col("source_size") * cap < F.col("weight") * F.lit(level)
        held, rest = by.agg(F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        new = float(total - held) / float(rest) if rest else level
        if new <= level:
            break
        level = new
    goal = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * cap).cast("double"))
    return by.select("source", "source_size", goal.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, doc_id: str = "doc_id", text: str = "text", source: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, rid (hash of the text), size, source_size, target, taken (words taken, repeats counted) for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), shuffled(F.coalesce(F.col(doc_id), F.lit(-1))).alias("r"), F.xxhash64(F.col(text)).alias("rid"))
    rows = materialize(rows, "mix-rows")
    goals = targets(rows, weights, passes)
    goals = materialize(goals.withColumn("sid", F.xxhash64(F.coalesce(F.col("source"), F.lit("\0")), F.col("source").isNull())), "mix-goals")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    bits = max(0, (max(n, 1) // bucket_rows).bit_length())
    # 60 bits of hash: the leading ones number the bucket
    rows = rows.withColumn("b", F.shiftright("r", 60 - bits).cast("long") if bits else F.lit(0).cast("long"))
    by_bucket = rows.groupBy("source", "b").agg(F.sum("size").alias("s"))
    run = Window.partitionBy("source").orderBy("b")
    starts = by_bucket.withColumn("start", F.sum("s").over(run) - F.col("s")).drop("s")
    starts = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(starts["source"].alias("s2"), F.col("b").alias("b2"), "start", "source_size", "target")
    within = Window.partitionBy("source", "b").orderBy("r", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumn("cum", F.sum("size").over(within))
    cum = cum.join(starts, cum["source"].eqNullSafe(starts["s2"]) & (cum["b"] == starts["b2"])).withColumn("cum", F.col("cum") + F.col("start"))
    # finish times of the passes; those up to 1 fit into the targets, so only later ones compete for what is left
    times = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda k: (k * F.col("source_size") + F.col("cum")).cast("double") / F.col("target"))
    queued = materialize(cum.select("doc_id", "source", "rid", "size", "source_size", "target", "r", F.when((F.col("target") > 0) & (F.col("size") > 0), times).alias("f")), "mix-queue")
    sure = F.coalesce(F.size(F.filter("f", lambda x: x <= 1)), F.lit(0))
    sure = F.when(sure > 0, sure).otherwise(0)
    left = int(total or 0) - int(queued.agg(F.sum(sure * F.col("size"))).first()[0] or 0)
    late = queued.select("doc_id", "source", "size", "r", F.explode("f").alias("f")).where("f > 1")
    late = late.withColumn("slice", F.least(F.floor((F.col("f") - 1) * SLICES), F.lit(SLICES * passes)).cast("long"))
    sums = late.groupBy("slice").agg(F.sum("size").alias("s"))
    ahead = sums.withColumn("run", F.sum("s").over(Window.orderBy("slice")))
    cut = ahead.where(F.col("run") > left).agg(F.min(F.struct("slice", (F.col("run") - F.col("s")).alias("before")))).first()[0]
    if cut is None:
        limit = None
    else:  # within the slice where the budget runs out, in order of finish time
        order = Window.orderBy("f", "r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        inside = late.where(F.col("slice") == cut["slice"]).withColumn("run", F.sum("size").over(order) + cut["before"])
        last = inside.where(F.col("run") <= left).agg(F.max(F.struct("f", "r", "doc_id", "size"))).first()[0]
        limit = last or ("before", cut["slice"])
    if limit is None:
        extra = F.size(F.filter("f", lambda x: x > 1))
    elif limit[0] == "before":
        extra = F.size(F.filter("f", lambda x: (x > 1) & (F.floor((x - 1) * SLICES) < limit[1])))
    else:
        at = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(("f", "r", "doc_id", "size"), limit, ("double", "long", dict(queued.dtypes)["doc_id"], "long"), strict=True)])
        extra = F.size(F.filter("f", lambda x: (x > 1) & (F.struct(x.alias("f"), F.col("r"), F.col("doc_id"), F.col("size")) <= at)))
    taken = F.when(F.col("f").isNull(), 0).otherwise(sure + extra) * F.col("size")
    return queued.select("doc_id", "source", "rid", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture_table(docs: DataFrame) -> DataFrame:
    """The mix of `documents`: doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with the columns of docs. Rows that are equal in id, source and text share out what the mix gives to them."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    picks = mix(docs).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("rid").alias("__r")).agg(F.sort_array(F.collect_list(times)).alias("__k")).where(F.exists("__k", lambda k: k > 0))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.xxhash64("text").alias("__rid"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__row.doc_id", "__row.source", "__rid").orderBy("__rid")))
    out = rows.join(picks, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & F.col("__row.source").eqNullSafe(F.col("__s")) & (F.col("__rid") == F.col("__r")))
    times = F.get("__k", F.col("__n") - 1)
    return out.where(times > 0).select("__row", F.explode(F.sequence(F.lit(1), times))).select("__row.*")


_SIZED = """
t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS r FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0e0 / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM o),
v AS (SELECT min_by(level, k) AS level FROM l WHERE level * weight <= source_size * 3),
g AS (SELECT source, source_size, least(weight * coalesce(v.level, 0), (source_size * 3)::DOUBLE) AS target FROM w, v),
c AS (SELECT t.*, source_size, target, sum(size) OVER (PARTITION BY t.source ORDER BY r, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
      FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
q AS (SELECT c.*, k, (k * source_size + cum)::DOUBLE / target AS f FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND target > 0),
p AS (SELECT *, f <= 1 OR sum(size) OVER (ORDER BY f, r, doc_id, size ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM t) AS used FROM q),
n AS (SELECT doc_id, source, count(*) FILTER (WHERE used) AS times FROM p GROUP BY doc_id, source)
"""
ORACLE = "WITH " + _SIZED.format(docs="documents") + """
SELECT c.doc_id, size, source_size, target, coalesce(times * size, 0)::BIGINT AS taken
FROM c LEFT JOIN n ON c.doc_id IS NOT DISTINCT FROM n.doc_id AND c.source IS NOT DISTINCT FROM n.source
"""
