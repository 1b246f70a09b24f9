"""From hits to an answer: neighbours of the best hits, order, a place for a caller, budgets, context, refusal.

The hits of one question are a short list of dicts (at most the search's k and its neighbours); what is looked up for them in
whole tables is a DataFrame operation whose result is bounded by those hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.scanner import outline

#: Fixed values.
SEEDS, PER_SEED, DISCOUNT, GATE, SNIPPET_CHARS, SOURCES = 3, 4, 0.9, 0.5, 6000, 5
TYPES = ("lookup", "relational", "summarization", "analytical")
RULES = (
    ("analytical", r"(?i)\b(inconsisten\w*|outlier\w*|unusual|anomal\w*|differs? from)\b"),
    ("relational", r"(?i)\b(calls?|callers?|callees?|invokes?|uses|used by|depends?|impact|breaks?|path|chain|reach\w*)\b"),
    ("summarization", r"(?i)\b(summar\w*|overview|explain|describe|how does)\b"),
)


def question_type(question: Column) -> Column:
    """analytical, relational, summarization, else lookup: the first rule whose words the question holds; lookup for null."""
    out = F.lit("lookup")
    for kind, pattern in reversed(RULES):
        out = F.when(F.coalesce(question, F.lit("")).rlike(pattern), kind).otherwise(out)
    return out


def collapse(question: Column) -> Column:
    return F.trim(F.regexp_replace(question, r"(?U)\s+", " "))


def distance_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.2 * (distance - 1))


def neighbours(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, callees: bool = False, per_seed: int = PER_SEED) -> DataFrame:
    """seed, node, relationship, place: at most per_seed direct callers of each seed, and as many callees if asked.

    Code comes before tests, the seed's own file before others, then by node. nodes: node, file_path, is_test. A seed that is no
    node has none.
    """
    known = seeds.join(nodes.select("node", F.col("file_path").alias("seed_path")), "node").select(F.col("node").alias("seed"), "seed_path")
    sides = [("direct_caller", "dst", "src")] + ([("direct_callee", "src", "dst")] if callees else [])
    out = None
    for what, own, other in sides:
        # seeds are few: a semi-join on them leaves their edges alone
        met = edges.join(known, F.col(own) == F.col("seed")).select("seed", "seed_path", F.col(other).alias("node"))
        met = met.join(nodes, "node").withColumn("relationship", F.lit(what))
        out = met if out is None else out.unionByName(met)
    order = Window.partitionBy("seed", "relationship").orderBy("is_test", F.col("file_path") != F.col("seed_path"), "node")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_seed).select("seed", "node", "relationship", "place")


def overlap(question: Column, text: Column) -> Column:
    """The default reranker: the share of the question's words that the text holds, and a little for how often."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2)
    q, t = F.array_distinct(words(question)), words(text)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0)) + 0.01 * F.log1p(F.size(F.filter(t, lambda w: F.array_contains(q, w))))


def reranked(hits: DataFrame, question: Column, keep: int, by: tuple[str, ...] = (), key: str = "chunk_id") -> DataFrame:
    """The best `keep` rows of each group with rerank_score and rank, from the best; ties by key."""
    text = F.concat_ws("\n", "docstring", "code", "file_path")
    order = Window.partitionBy(*by).orderBy(F.desc("rerank_score"), key)
    return hits.withColumn("rerank_score", F.round(overlap(question, text), 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def rank_change(before: DataFrame, after: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, before, after, delta (places won) of rows that both lists hold."""
    return before.select(key, F.col("rank").alias("before")).join(after.select(key, F.col("rank").alias("after")), key).withColumn("delta", F.col("before") - F.col("after"))


def node_of(hit: dict) -> str:
    return f"{hit['file_path']}::{hit['function_name']}"


def specific_first(hits: list[dict]) -> list[dict]:
    """A hit stands just after the last-placed of what it strictly contains in its file."""

    def holds(a: dict, b: dict) -> bool:
        x, y = (a["start_line"], a["end_line"]), (b["start_line"], b["end_line"])
        return a["file_path"] == b["file_path"] and x != y and x[0] <= y[0] and y[1] <= x[1]

    place = [float(i) for i in range(len(hits))]
    # widest last, so that what a hit contains has its place before the hit gets its own
    for i in sorted(range(len(hits)), key=lambda i: hits[i]["end_line"] - hits[i]["start_line"]):
        place[i] = max([place[i], *(place[j] + 0.5 for j, h in enumerate(hits) if holds(hits[i], h))])
    return [hits[i] for i in sorted(range(len(hits)), key=lambda i: (place[i], i))]


def is_test(path: str) -> bool:
    parts = path.lower().split("/")
    return bool({"test", "tests"} & set(parts)) or parts[-1].startswith("test_")


def with_caller(top: list[dict], ranked: list[dict], most: int) -> list[dict]:
    """top with the best-ranked caller, outside tests, of its most specific hit; it takes the last place if there is no free one."""
    if not top or most < 2:
        return top
    anchor, present = node_of(specific_first(top)[0]), {node_of(h) for h in top}
    caller = next((h for h in ranked if anchor in (h.get("caller_of") or ()) and not is_test(h["file_path"])), None)
    if caller is None or node_of(caller) in present:
        return top
    return [*top[: most - 1], caller]


def within_snippets(sources: list[dict], budget: int = SNIPPET_CHARS) -> list[dict]:
    """Snippets in rank order while characters are left: one that is too long becomes its outline, and is cut if that is too long as well."""
    out = []
    for s in sources:
        if budget <= 0:
            break
        text = s["snippet"]
        if len(text) > budget:
            text = outline(text, s["language"], s["start_line"], s["end_line"]) or text
            if len(text) > budget:
                text = text[:budget] + "\n... [truncated]"
        out.append(s | {"snippet": text})
        budget -= len(text)
    return out


def context(question: str, sources: list[dict], kind: str, most: int = SOURCES) -> str:
    """The prompt: the question, and a block with the citation of each source."""
    blocks = [f"[{i}] {s['file_path']}:{s['function_name']}:L{s['start_line']}-L{s['end_line']}\n{s['snippet']}" for i, s in enumerate(sources[:most], 1)]
    return "\n\n".join([f"Question ({kind}): {question}", *blocks, "Cite sources as [path:name:Lfirst-Llast]."])


def extractive(prompt: str, sources: list[dict]) -> str:
    """The default answerer: names and cites every source."""
    said = [f"`{s['function_name']}` [{s['file_path']}:{s['function_name']}:L{s['start_line']}-L{s['end_line']}]" for s in sources]
    return "Relevant code: " + "; ".join(said) + "."


def refusal(question: str, confidence: float) -> dict:
    return {"question": question, "answer": "The indexed code holds nothing that answers this with enough confidence.", "refused": True, "confidence": round(confidence, 4), "sources": [], "sources_used": 0, "primary": None}


def parse_reply(reply: Column) -> Column:
    """answer and at most three followups of a JSON reply; null if there is no answer."""
    x = F.from_json(reply, "answer string, followups array<string>")
    return F.when(F.nullif(F.trim(x["answer"]), F.lit("")).isNotNull(), F.struct(x["answer"].alias("answer"), F.slice(F.coalesce(x["followups"], F.array().cast("array<string>")), 1, 3).alias("followups")))


def band(similarity: float) -> str:
    s = max(0.0, min(1.0, similarity))
    return "high" if s >= 0.8 else "medium" if s >= 0.65 else "low"


