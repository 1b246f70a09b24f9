"""A code base as tables, and questions to it: Engine(spark, folder).ingest(root), .query(question), .impact(name), .summarize(scope), .inconsistencies().

Tables are Parquet under a shared folder: files, chunks, nodes, edges, and a state row with the digest of all files. Ingesting the
same files again does nothing. Embedder and answerer are callables; the defaults need no model.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunks as ck
from quarry.operators import clusters, graph, impact, retrieval, vectors
from quarry.sources import files as fl

DIMENSIONS, CANDIDATES, RESULTS, BATCH = 384, 30, 5, 20


def hashed_words(text: str | None, size: int = DIMENSIONS) -> list[float]:
    """The default embedding: words and the parts of names, hashed to `size` counts, length one; zero without words."""
    import zlib

    import numpy as np

    words = re.findall(r"[^\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text or "").lower())
    v = np.bincount([zlib.crc32(w.encode()) % size for w in words if len(w) > 2], minlength=size).astype(float)
    v = np.sqrt(v)
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


class Engine:
    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[str | None], list[float]] = hashed_words, answer: Callable[[str, list[dict]], str] = retrieval.extractive):
        self.spark, self.folder, self.embed, self.answer = spark, folder.rstrip("/"), embed, answer

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    def state(self) -> dict | None:
        """The last ingest; None where there is none or it can't be read."""
        try:
            row = self.table("state").first()
        except Exception:  # a missing or corrupt table counts as no state
            return None
        return row.asDict() if row else None

    def ingest(self, root: str, force: bool = False) -> dict:
        """Scans root and builds all tables. status is up_to_date, without work, if no file differs from the last time."""
        began = time.time()
        scanned = fl.kept(fl.scan(self.spark, root)).persist()
        try:
            one = scanned.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "rel_path", "content_hash")))), 256).alias("head")).first()
            last = self.state()
            if last and last["head"] == one["head"] and not force:
                return last | {"status": "up_to_date"}
            warning = fl.within_limits(one["n"])
            self._write("files", scanned.select("rel_path", "language", "size_bytes", "content_hash"))
            found = self._write("entities", fl.entities(scanned))
        finally:
            scanned.unpersist()
        embed = F.udf(self.embed, "array<double>") if self.embed is not hashed_words else _hashed_udf()
        made = ck.build(found, root)
        made = made.withColumn("node", F.concat("file_path", F.lit("::"), "qualified_name")).withColumn("embedding", embed("embed_text"))
        made = self._write("chunks", made)
        functions = made.where("chunk_type IN ('function', 'method')")
        nodes = self._write("nodes", functions.select("node", F.col("name"), "qualified_name", "file_path", "start_line", "end_line", "language", "complexity", "is_public", tx.test_path(F.col("file_path")).alias("is_test")).dropDuplicates(["node"]))
        calls = functions.select(F.col("node").alias("src"), F.explode(tx.call_names(F.col("code"), F.col("name"))).alias("name"))
        edges = self._write("edges", graph.resolve_calls(calls, nodes.select("node", "name")))
        state = {"root": root, "head": one["head"], "files": one["n"], "chunks": made.count(), "nodes": nodes.count(), "edges": edges.count(), "languages": sorted(r[0] for r in made.select("language").distinct().collect()), "seconds": round(time.time() - began, 3), "warning": warning}
        self._write("state", self.spark.createDataFrame([state], "root string, head string, files long, chunks long, nodes long, edges long, languages array<string>, seconds double, warning string"))
        return state | {"status": "indexed"}

    # --- questions ---

    def _hits(self, question: str, k: int, language: str | None, path: str | None) -> list[dict]:
        """The k nearest chunks. Filters apply before the scores."""
        where = F.lit(True)
        if language:
            where &= F.col("language") == language
        if path:
            where &= F.col("file_path").contains(path)
        near = vectors.search(self.table("chunks"), self.embed(question), k, None, where, "embedding", "chunk_id")
        full = self.table("chunks").join(F.broadcast(near), "chunk_id")  # at most k rows
        return [self._hit(r, r["score"]) for r in full.orderBy(F.desc("score"), "chunk_id").collect()]

    @staticmethod
    def _hit(r, score: float) -> dict:
        return {"chunk_id": r["chunk_id"], "node": r["node"], "file_path": r["file_path"], "function_name": r["qualified_name"], "start_line": r["start_line"], "end_line": r["end_line"], "language": r["language"], "code": r["code"], "docstring": r["docstring"], "semantic": score, "structural": 0.0, "hybrid": score, "caller_of": []}

    def _with_centrality(self, hits: list[dict]) -> list[dict]:
        """hybrid = 0.7 of the similarity and 0.3 of min(callers / 10, 1), best first."""
        callers = {r["dst"]: r["n"] for r in self.table("edges").where(F.col("dst").isin([h["node"] for h in hits])).groupBy("dst").agg(F.count(F.lit(1)).alias("n")).collect()}
        for h in hits:
            h["structural"] = min(callers.get(h["node"], 0) / 10, 1.0)
        return hits

    def _expand(self, hits: list[dict], kind: str) -> list[dict]:
        """New hits: direct callers (and callees for a summarization) of the first seeds; hits that are there already are tagged caller_of."""
        seeds = self.spark.createDataFrame([(h["node"],) for h in hits[: retrieval.SEEDS]], "node string").distinct()
        found = retrieval.neighbours(self.table("edges"), self.table("nodes"), seeds, kind == "summarization")
        rows = found.join(self.table("chunks"), "node").orderBy("seed", "relationship", "place").collect()  # at most 2 * SEEDS * PER_SEED
        by, new = {h["node"]: h for h in hits}, []
        for seed in hits[: retrieval.SEEDS]:
            for r in (r for r in rows if r["seed"] == seed["node"]):
                hit = by.get(r["node"])
                if hit is None:
                    hit = by[r["node"]] = self._hit(r, seed["semantic"] * retrieval.DISCOUNT)
                    new.append(hit)
                if r["relationship"] == "direct_caller" and seed["node"] not in hit["caller_of"]:
                    hit["caller_of"].append(seed["node"])
        return new

    def _traversed(self, question: str) -> list[dict]:
        """Hits of the graph traversals that the question asks for, the nearest distance of each node."""
        one = self.spark.range(1).select(tx.route(F.lit(question)).alias("route"), tx.target(F.lit(question)).alias("target"), *[c.alias(a) for c, a in zip(tx.ends_of_path(F.lit(question)), ("first", "last"), strict=True)]).first()
        edges, nodes = self.table("edges"), self.table("nodes")
        node = lambda name: (r := graph.resolve_node(nodes, edges, name).first()) and r["node"]
        if one["route"] == "path":
            a, b = node(one["first"]), node(one["last"])
            path = graph.shortest_path(edges, a, b) if a and b else []
            reached = self.spark.createDataFrame([(n, i + 1) for i, n in enumerate(path)], "node string, distance int")
        else:
            start = node(one["target"])
            if not start:
                return []
            start = self.spark.createDataFrame([(start,)], "node string")
            plan = {"impact": [(4, True)], "callees": [(2, False)], "callers": [(3, True)], "callers_and_callees": [(3, True), (2, False)]}[one["route"]]
            reached = None
            for depth, backwards in plan:
                part = graph.reach(edges, start, depth, backwards)
                reached = part if reached is None else reached.unionByName(part)
            reached = impact.nearest(reached)
        near = reached.withColumn("score", retrieval.distance_score(F.col("distance"))).orderBy("distance", "node").limit(CANDIDATES)
        return [self._hit(r, r["score"]) for r in near.join(self.table("chunks"), "node").orderBy("distance", "node").collect()]

    def query(self, question: str, max_results: int = RESULTS, language: str | None = None, path: str | None = None) -> dict:
        """answer, sources, confidence and type; refused below the gate."""
        question = " ".join(question.split())
        kind = self.spark.range(1).select(retrieval.question_type(F.lit(question))).first()[0]
        hits = self._traversed(question) if kind == "relational" else []
        hits = hits or self._hits(question, CANDIDATES, language, path)
        if not hits:
            return retrieval.refusal(question, 0.0) | {"type": kind}
        ranked = hits
        if kind in ("lookup", "summarization"):
            ranked = hits + self._expand(hits, kind)
            score = self.spark.createDataFrame([(h["chunk_id"], h["docstring"], h["code"], h["file_path"]) for h in ranked], "chunk_id string, docstring string, code string, file_path string")
            order = {r["chunk_id"]: r["rank"] for r in retrieval.reranked(score, F.lit(question), len(ranked)).collect()}
            # the similarity that admitted a hit and its words weigh alike
            first = {h["chunk_id"]: i for i, h in enumerate(sorted(ranked, key=lambda h: -h["hybrid"]), 1)}
            ranked = sorted(ranked, key=lambda h: (order[h["chunk_id"]] + first[h["chunk_id"]], h["chunk_id"]))
        elif kind == "analytical":
            odd = {r["chunk_id"]: r["z"] for r in self.inconsistencies().collect()}
            for h in self._with_centrality(hits):
                h["hybrid"] = 0.7 * h["semantic"] + 0.3 * min(1.0, odd.get(h["chunk_id"], 0.0) / 5)
            ranked = sorted(hits, key=lambda h: -h["hybrid"])
        top = ranked[:max_results]
        if kind == "lookup":
            top = retrieval.with_caller(top, ranked, max_results)
        confidence = max(0.0, min(1.0, top[0]["hybrid"]))
        if confidence < self.gate:
            return retrieval.refusal(question, confidence) | {"type": kind}
        sources = [h | {"snippet": h["code"] or "", "similarity": max(0.0, min(1.0, h["hybrid"])), "band": retrieval.band(h["hybrid"])} for h in retrieval.specific_first(top)]
        sources = retrieval.within_snippets(sources)
        answer = self.answer(retrieval.context(question, sources, kind), sources)
        paths = F.array(*[F.lit(s["file_path"]) for s in sources])
        used = self.spark.range(1).select(tx.sources_used(F.lit(answer), paths)).first()[0]
        primary = max(sources, key=lambda s: s["similarity"])
        return {"question": question, "type": kind, "answer": answer, "refused": False, "confidence": round(confidence, 4), "band": retrieval.band(confidence), "sources": sources, "sources_used": used, "primary": retrieval.node_of(primary)}

    #: The least confidence of an answer. Similarities of the default embedding are lower than a model's.
    gate = 0.15

    def query_batch(self, questions: Iterable[str]) -> list[dict]:
        """At most BATCH questions; one that fails has its error in its place."""
        questions = list(questions)
        if len(questions) > BATCH:
            raise ValueError(f"at most {BATCH} questions")
        out = []
        for q in questions:
            try:
                out.append(self.query(q))
            except Exception as e:
                out.append({"question": q, "error": str(e)})
        return out

    def impact(self, name: str, depth: int = 4) -> dict:
        """The node that the name resolves to, its direct callers, all it affects in order, and a summary."""
        edges = self.table("edges")
        found = graph.resolve_node(self.table("nodes"), edges, name).first()
        if not found:
            return {"node": None, "summary": impact.summary(name, self.spark.createDataFrame([], "risk string"), False), "affected": None}
        start = self.spark.createDataFrame([(found["node"],)], "node string")
        rows = impact.report(edges, start, depth)
        return {"node": found["node"], "direct": rows.where("distance = 1"), "affected": rows, "summary": impact.summary(found["node"], rows)}

    def inconsistencies(self) -> DataFrame:
        return clusters.detect(self.table("chunks").where("chunk_type <> 'module'"))

    def summarize(self, scope: str | None = None) -> dict:
        """A file, a folder or (None) all: counts, the five most called components, entry points from outside, whether a sample was read."""
        chunks = self.table("chunks")
        if scope:
            chunks = chunks.where((F.col("file_path") == scope) | F.col("file_path").startswith(scope.rstrip("/") + "/"))
        one = chunks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files")).first()
        if not one["n"]:
            raise LookupError(f"nothing is indexed under {scope}")
        read = clusters.representatives(chunks)
        own = chunks.select("node")
        into = self.table("edges").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
        key = [r["node"] for r in graph.hubs(into, 5).collect()]
        outside = into.join(own.withColumnRenamed("node", "src"), "src", "left_anti").select("dst").distinct().orderBy("dst").limit(20)
        return {"scope": scope or "repository", "files": one["files"], "chunks": one["n"], "read": read.count(), "sampled": one["n"] > clusters.SAMPLE, "components": key, "entry_points": [r[0] for r in outside.collect()]}


def _hashed_udf():
    def embed(texts):
        return texts.map(hashed_words)

    return F.pandas_udf(embed, "array<double>", F.PandasUDFType.SCALAR)
