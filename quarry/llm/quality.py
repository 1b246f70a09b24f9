"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean column over the text and the base counts. `plan_cascade` times each rule and counts what it rejects
on a bounded sample, and orders the rules by rejections per second; `CASE WHEN` then evaluates them in that order and
stops at the first that rejects. The order can't change a verdict (a document is kept if no rule rejects it), so the sample
decides speed only.

Null text: no words, so it fails the base. Empty text: the same. Repeated rows: each gets its own row. Very long texts: all
work is within the row, sorting 16 bytes per word. Other columns of the input, whatever their names, don't take part.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, chars_of, words

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Documents on which rules are timed and counted, and the length up to which a document may be among them; they bound the
#: planning (and what it brings to the driver), not the data that is judged.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000


def _same(x: Column, y: Column) -> Column:
    return F.coalesce(F.call_function("shiftright", x, F.col("__b")) == F.call_function("shiftright", y, F.col("__b")), F.lit(False))


def _place(x: Column) -> Column:
    return (x - F.call_function("shiftleft", F.call_function("shiftright", x, F.col("__b")), F.col("__b"))).cast("int")


def _window(x: Column) -> Column:
    return F.concat_ws(" ", F.slice("__w", _place(x) + 1, 3))


def _by_text() -> Column:
    """Positions of the windows that occur twice or more, from their text."""
    spelled = F.array_sort(F.transform("__k", lambda x: F.struct(_window(x).alias("s"), _place(x).alias("p"))))
    twice = F.filter(F.transform(spelled, lambda x, i: F.when((x["s"] == F.get(spelled, i + 1)["s"]) | (x["s"] == F.get(spelled, i - 1)["s"]), x["p"])), lambda p: p.isNotNull())
    return twice


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base columns (and helper columns named __*) to every row.

    n_repeat_words counts the positions in windows of three words that occur twice or more in the text. A window is a long,
    its hash with the position in the low bits; after sorting, those whose hash equals a neighbour's are kept and overlapping
    windows are counted once. Should two neighbours of equal hash differ in their words, the row is counted by the windows' text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("__t", t)
        .withColumn("__w", words(F.col("__t")))
        .withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("__b", F.greatest(F.length(F.bin("n_words")), F.lit(1)))
        .withColumn("__k", F.when(F.col("n_words") >= 4, F.transform(F.slice("__w", 1, F.size("__w") - 2), lambda w, i: F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)), F.col("__b")), F.col("__b")).bitwiseOR(i.cast("long")))))
        .withColumn("__h", F.sort_array("__k"))
        .withColumn("__q", F.filter("__h", lambda x, i: _same(x, F.get("__h", i + 1)) | _same(x, F.get("__h", i - 1))))
        .withColumn("__x", F.exists(F.transform("__q", lambda x, i: _same(x, F.get("__q", i + 1)) & (_window(x) != _window(F.get("__q", i + 1)))), lambda x: x))
        .withColumn("__p", F.sort_array(F.when(F.coalesce("__x", F.lit(False)), _by_text()).otherwise(F.transform("__q", _place))))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("__p", lambda p, i: F.least(F.coalesce(F.get("__p", i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
        .withColumn("word_chars", (F.length("__t") - chars_of(F.col("__t"), SPACES)).cast("long"))
        .withColumn("n_symbols", chars_of(F.col("__t"), SYMBOLS).cast("long"))
        .withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def default_rules() -> dict[str, Column]:
    """True rejects. Over the columns of base_counts; thresholds are far from what running prose of any length has."""
    t, n, chars = F.col("__t"), F.col("n_words"), F.col("word_chars")
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 2 * F.col("n_dup_lines") > F.size("__l"),
        "word_length": (chars < 2 * n) | (chars > 15 * n),
        "exclamations": 2 * chars_of(t, "!?") > n,
        "digits": 10 * chars_of(t, "0-9") > 4 * chars,
        "capitals": 10 * chars_of(t, "A-ZÀ-ÖØ-Þ") > 4 * chars,
    }


def plan_cascade(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per second on a bounded sample, best first; ties by name. An empty sample: by name.

    The sample is taken from as few partitions as hold it; limit() would send that many rows of every partition to one task.
    A rule's cost is the time its count takes beyond that of counting rows alone.
    """
    spark = docs.sparkSession
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select("text").take(sample_rows)
    if not texts:
        return sorted(rules)
    sample = base_counts(spark.createDataFrame([(r[0],) for r in texts], "text string")).persist()

    def timed(what: Column) -> tuple[int, float]:
        began = time.perf_counter()
        return sample.agg(what).first()[0], time.perf_counter() - began

    try:
        timed(F.count(F.lit(1)))  # fills the cache
        n, bare = timed(F.count(F.lit(1)))
        rate = {}
        for name, rule in rules.items():
            rejected, took = timed(F.count_if(rule))
            rate[name] = (rejected + 0.5) / (n + 1) / max(took - bare, 1e-3)
        return sorted(rules, key=lambda k: (-rate[k], k))
    finally:
        sample.unpersist()


def judge(docs: DataFrame, text: str = "text", rules: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """All columns of docs, the base counts, base_failed and kept. Rules may name the columns of base_counts."""
    counted = base_counts(docs.select(F.col(text).alias("text"), F.struct(*docs.columns).alias("__row")))
    rules = default_rules() if rules is None else rules
    cascade = F.when(F.col("base_failed"), False)
    for name in order or plan_cascade(docs.select(F.col(text).alias("text")), rules):
        cascade = cascade.when(rules[name], False)
    return counted.withColumn("kept", cascade.otherwise(True))


def quality_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed and kept."""
    return judge(docs.select("doc_id", "text")).select(F.col("__row.doc_id").alias("doc_id"), *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the cascade keeps, with the columns of docs."""
    # a column that differs from run to run keeps the filter above the counts; pushed below, it would spell each of them out anew
    return judge(docs).withColumn("__fence", F.monotonically_increasing_id()).where("kept AND __fence >= 0").select("__row.*")


_W = r"[\x20\x09-\x0D]+"
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '{_W}'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
b AS (SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_W}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * length(regexp_replace(text, '[^!?]', '', 'g')) > n_words
            OR 10 * length(regexp_replace(text, '[^0-9]', '', 'g')) > 4 * word_chars
            OR 10 * length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) > 4 * word_chars) AS kept
FROM f
"""
