"""Chunks from entities: types, documentation, names, citations, summaries; complexity of functions and its rollup.

Entities are rows of quarry.sources.files.ENTITY. A row without a path, a name or a body makes no chunk; the rest of its file stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: Raw entity types and the chunk types they become; others are errors and their rows are dropped.
CHUNK_TYPES = {"function": "function", "async_function": "function", "method": "method", "class": "class", "interface": "class", "module": "module"}
RATINGS = ("low", "moderate", "high", "very_high")


def raw_type(kind: Column, is_async: Column, is_interface: Column) -> Column:
    return F.when((kind == "function") & is_async, "async_function").when((kind == "class") & is_interface, "interface").otherwise(kind)


def chunk_type(raw: Column, class_name: Column) -> Column:
    """Null for a type that isn't known. A function that stands in a class is a method."""
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in CHUNK_TYPES.items() for x in kv]), raw)
    return F.when((mapped == "function") & class_name.isNotNull(), "method").otherwise(mapped)


def clean_docstring(doc: Column) -> Column:
    """Stripped, the indent that all later lines share removed, null if nothing is left."""
    lines = F.split(F.regexp_replace(doc, r"^\s+|\s+$", ""), "\n", -1)
    later = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x) != "")
    indent = F.coalesce(F.array_min(F.transform(later, lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    moved = F.transform(lines, lambda x, i: F.when(i == 0, x).when(F.trim(x) == "", "").otherwise(F.substring(x, indent + 1, F.length(x))))
    return F.nullif(F.array_join(moved, "\n"), F.lit(""))


def qualified_name(name: Column, class_name: Column) -> Column:
    return F.concat_ws(".", class_name, name)


def citations(path: Column, qualified: Column, name: Column, first: Column, last: Column) -> dict[str, Column]:
    """The three spellings of a place."""
    a, b = first.cast("string"), last.cast("string")
    return {
        "long": F.concat(path, F.lit(" :: "), qualified, F.lit(" (lines "), a, F.lit("–"), b, F.lit(")")),
        "short": F.concat(path, F.lit("::"), name, F.lit(" [lines "), a, F.lit("–"), b, F.lit("]")),
        "inline": F.concat(path, F.lit(":"), name, F.lit(":L"), a, F.lit("-L"), b),
    }


def build(entities: DataFrame, url: str = "") -> DataFrame:
    """A chunk for each function, method, class and module: id, type, names, text to embed, complexity, lines, imports of its file."""
    e = entities.withColumn("raw", raw_type(F.col("kind"), F.coalesce("is_async", F.lit(False)), F.coalesce("is_interface", F.lit(False))))
    e = e.withColumn("chunk_type", chunk_type(F.col("raw"), F.col("class_name"))).where("chunk_type IS NOT NULL AND rel_path IS NOT NULL AND coalesce(name, '') <> '' AND body IS NOT NULL")
    imports = entities.where("kind = 'import'").groupBy(F.col("rel_path").alias("of")).agg(F.array_sort(F.collect_set("name")).alias("imports"))
    doc, name, qualified = clean_docstring(F.col("docstring")), F.col("name"), qualified_name(F.col("name"), F.col("class_name"))
    counted = F.greatest(F.lit(1), 1 + tx.decision_count(F.col("body"), F.col("language")))
    out = e.select(
        tx.chunk_id(F.lit(url), F.col("rel_path"), qualified, F.col("start_line")).alias("chunk_id"),
        F.col("rel_path").alias("file_path"), "chunk_type", name, "class_name", qualified.alias("qualified_name"), "language", "start_line", "end_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("line_count"), "signature", doc.alias("docstring"), F.col("body").alias("code"),
        F.when(~F.col("chunk_type").isin("class", "module"), counted).alias("complexity"),
        tx.embeddable(F.coalesce(F.nullif("signature", F.lit("")), name), F.coalesce(doc, F.lit("")), F.col("body")).alias("embed_text"),
        (~name.startswith("_")).alias("is_public"),
        F.coalesce("has_errors", F.lit(False)).alias("has_errors"),
    )
    return out.join(imports, F.col("file_path") == F.col("of"), "left").drop("of").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


def summary(chunks: DataFrame) -> DataFrame:
    """One row: total, by_type (a map), avg_complexity (2 places), missing_docstrings and their percentage (1 place); of no chunks 0, {}, null, 0, 0."""
    by = chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"), F.sum("complexity").alias("c"), F.count("complexity").alias("m"), F.count_if(F.col("docstring").isNull()).alias("bare"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return by.agg(
        total.alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_type", "n")))).alias("by_type"), F.round(F.try_divide(F.sum("c"), F.sum("m")), 2).alias("avg_complexity"),
        F.coalesce(F.sum("bare"), F.lit(0)).alias("missing_docstrings"), F.coalesce(F.round(F.try_divide(100.0 * F.sum("bare"), F.sum("n")), 1), F.lit(0.0)).alias("missing_percent"),
    )


def rollup(functions: DataFrame, name: str = "name", complexity: str = "complexity", loc: str = "loc", named: int = 10) -> DataFrame:
    """One row: count, mean (2 places), max, min, loc, a count for each of the four ratings (zeros too), and the first of the names rated high or worse."""
    c, rate = F.col(complexity), tx.rating(F.col(complexity))
    counts = [F.count_if(rate == r).alias(r) for r in RATINGS]
    high = functions.where(rate.isin("high", "very_high")).orderBy(F.desc(complexity), name).limit(named).agg(F.sort_array(F.collect_list(F.struct((-c).alias("k"), F.col(name).alias("name")))).alias("h"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    one = functions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias("mean"), zero(F.max(c)).alias("max"), zero(F.min(c)).alias("min"), zero(F.sum(loc)).alias("loc"), *counts)
    return one.crossJoin(high.select(F.transform("h", lambda x: x["name"]).alias("high_names")))  # two single rows
