"""Queries over the driver's tables, each with its SQL. Documents stand in for chunks, parts for graph nodes, events for requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunks, clusters, graph, impact, retrieval, tables, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# --- scans, snapshots -------------------------------------------------------------------------------------------------


@query("SELECT lang, CASE WHEN n_chars > 20000 THEN 'size' WHEN n_chars < 100 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def scan_summary(t):
    reason = F.when(F.col("n_chars") > 20000, "size").when(F.col("n_chars") < 100, "short").otherwise("kept")
    return t("documents").groupBy("lang", reason.alias("reason")).agg(count())


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND source LIKE '%src1%' AND n_chars >= 500 AND n_chars <= 5000")
def filter_chunks(t):
    return t("documents").where((F.col("lang") == "en") & F.col("source").contains("src1") & F.col("n_chars").between(500, 5000)).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, substr(sha256(concat_ws('::', source, lang, doc_id::VARCHAR, '1')), 1, 16) AS chunk_id FROM documents")
def chunk_ids(t):
    return t("documents").select("doc_id", tx.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.lit(1)).alias("chunk_id"))


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1")
def chunk_dedupe_latest(t):
    return tables.latest(t("documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], F.desc("doc_id"))


_SNAP = "o AS (SELECT doc_id AS path, sha256(text) AS a FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS b FROM documents WHERE doc_id % 5 <> 0)"


def _snapshots(t):
    d = t("documents")
    old = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    new = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return old, new


@query(f"WITH {_SNAP}, j AS (SELECT path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' WHEN a <> b THEN 'modified' END AS change FROM o FULL JOIN n USING (path)) SELECT * FROM j WHERE change IS NOT NULL")
def snapshot_diff(t):
    return tables.snapshot_diff(*_snapshots(t))


@query(f"WITH {_SNAP} SELECT path FROM n LEFT JOIN o USING (path) WHERE coalesce(a <> b, true)")
def stale_files(t):
    old, new = _snapshots(t)
    return new.join(old.withColumnRenamed("sha256", "was"), "path", "left").where(F.coalesce(F.col("sha256") != F.col("was"), F.lit(True))).select("path")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src3')")
def delete_by_path(t):
    d = t("documents").select("doc_id", "source")
    return d.join(d.where(F.col("source").isin("src0", "src3")).select("source").distinct(), "source", "left_anti").select("doc_id", "source")


@query(r"SELECT page_id, list_has_any(string_split(url, '/'), ['venv', '.venv', 'env', '__pycache__', 'node_modules', '.git', 'dist', 'build', '.mypy_cache', '.pytest_cache', 'htmlcov', 'migrations']) OR regexp_matches(url, '(\.min\.js|\.min\.ts|\.d\.ts)$') AS excluded FROM pages")
def excluded_paths(t):
    return t("pages").select("page_id", tx.excluded_path(F.col("url")).alias("excluded"))


@query("SELECT page_id, split_part(url, '/', 3) AS host, list_extract(string_split(url, '/'), -1) AS last_part FROM pages")
def repository_urls(t):
    p = F.split("url", "/")
    return t("pages").select("page_id", F.get(p, F.lit(2)).alias("host"), F.element_at(p, -1).alias("last_part"))


# --- text -------------------------------------------------------------------------------------------------------------

#: Every sign that parts words, doubled, so that neighbouring words each keep one: RE2 has no Unicode word boundary.
_PARTED = r"regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g')"
_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"

_RATING = "CASE WHEN c <= 5 THEN 'low' WHEN c <= 10 THEN 'moderate' WHEN c <= 20 THEN 'high' ELSE 'very_high' END"


@query(rf"""WITH w AS (SELECT doc_id, text, lang, {_WORDS} AS w, {_PARTED} AS p FROM documents)
SELECT doc_id, greatest(1, 1 + len(list_filter(w, lambda x: x IN ('if', 'elif', 'for', 'while', 'except', 'case', 'catch') OR lang = 'en' AND x IN ('and', 'or')))
  + len(regexp_extract_all(p, '(?:^|[^\p{{L}}\p{{N}}_])else  if(?:$|[^\p{{L}}\p{{N}}_])')) + len(regexp_extract_all(text, '&&')) + len(regexp_extract_all(text, '\|\|')))::INT AS complexity FROM w""")
def decision_count(t):
    """English documents stand in for Python sources."""
    language = F.when(F.col("lang") == "en", "python").otherwise("other")
    return t("documents").select("doc_id", F.greatest(F.lit(1), 1 + tx.decision_count(F.col("text"), language)).alias("complexity"))


@query(f"WITH c AS (SELECT lang, least(40, n_chars // 200)::BIGINT AS c FROM documents) SELECT lang, {_RATING} AS rating, count(*) AS n, round(avg(c), 2) AS mean, max(c) AS most, min(c) AS least FROM c GROUP BY ALL")
def complexity_rating_rollup(t):
    d = t("documents").select("lang", F.least(F.lit(40), F.floor(F.col("n_chars") / 200)).cast("long").alias("c"))
    return d.groupBy("lang", tx.rating(F.col("c")).alias("rating")).agg(count(), F.round(F.avg("c"), 2).alias("mean"), F.max("c").alias("most"), F.min("c").alias("least"))


@query("""WITH c AS (SELECT doc_id::VARCHAR AS name, least(40, n_chars // 200)::BIGINT AS c, n_chars FROM documents),
h AS (SELECT list(name ORDER BY c DESC, name) AS names FROM (SELECT * FROM c WHERE c > 10 ORDER BY c DESC, name LIMIT 10))
SELECT count(*) AS n, coalesce(round(avg(c), 2), 0) AS mean, max(c) AS max, min(c) AS min, sum(n_chars)::BIGINT AS loc, count(*) FILTER (WHERE c <= 5) AS low, count(*) FILTER (WHERE c > 5 AND c <= 10) AS moderate, count(*) FILTER (WHERE c > 10 AND c <= 20) AS high,
 count(*) FILTER (WHERE c > 20) AS very_high, array_to_string(any_value(names), ',') AS high_names FROM c, h""")
def complexity_rollup(t):
    d = t("documents").select(F.col("doc_id").cast("string").alias("name"), F.least(F.lit(40), F.floor(F.col("n_chars") / 200)).cast("long").alias("complexity"), F.col("n_chars").alias("loc"))
    return chunks.rollup(d).withColumn("high_names", F.array_join("high_names", ","))


@query("SELECT source, count(*) AS total, count(DISTINCT lang) AS languages, round(avg(n_chars), 2) AS mean_chars, count(*) FILTER (WHERE n_chars < 500) AS small, round(100.0 * count(*) FILTER (WHERE n_chars < 500) / count(*), 1)::DOUBLE AS small_percent FROM documents GROUP BY source")
def chunk_summary(t):
    return t("documents").groupBy("source").agg(count("total"), F.countDistinct("lang").alias("languages"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.count_if(F.col("n_chars") < 500).alias("small"), F.round(100.0 * F.count_if(F.col("n_chars") < 500) / F.count(F.lit(1)), 1).alias("small_percent"))


@query("SELECT doc_id, md5(concat_ws(chr(10), source, nullif(trim(lang), ''), CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || ' ... ' || right(text, 150) ELSE text END)) AS digest FROM documents")
def embeddable_text(t):
    return t("documents").select("doc_id", F.md5(tx.embeddable(F.col("source"), F.col("lang"), F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(#|//|\*|/\*)')))::INT AS loc FROM documents")
def loc_count(t):
    return t("documents").select("doc_id", tx.lines_of_code(F.col("text")).alias("loc"))


_CALL_WORDS = "'if', 'for', 'while', 'switch', 'catch', 'return', 'print', 'super', 'new', 'async', 'await', 'yield', 'with', 'except', 'elif', 'func', 'function', 'def', 'lambda'"


@query(rf"""WITH m AS (SELECT page_id, regexp_replace(html, '(^|[^\p{{L}}\p{{N}}_])(?:(?:def|class|function\*?)\s+[A-Za-z_][A-Za-z0-9_]*|func\s*(?:\([^)]*\)\s*)?[A-Za-z_][A-Za-z0-9_]*)', '\1 ', 'g') AS t FROM pages),
c AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(t, '([\p{{L}}\p{{N}}_]+)\s*\(', 1))) AS name FROM m)
SELECT page_id, name FROM c WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') AND name NOT IN ({_CALL_WORDS})""")
def call_names(t):
    return t("pages").select("page_id", F.explode(tx.call_names(F.col("html"))).alias("name"))


@query(r"SELECT page_id, list_has_any(string_split(lower(url), '/'), ['test', 'tests']) OR starts_with(list_extract(string_split(lower(url), '/'), -1), 'test_') AS is_test FROM pages")
def test_paths(t):
    return t("pages").select("page_id", tx.test_path(F.col("url")).alias("is_test"))


_STOP = "'what', 'who', 'which', 'does', 'do', 'calls', 'call', 'calling', 'the', 'a', 'an', 'is', 'are', 'in', 'of', 'to', 'on', 'from', 'function', 'method', 'module', 'class', 'would', 'break', 'if', 'changed', 'change', 'depend', 'depends', 'and', 'or', 'how'"
_E = r"[^\p{L}\p{N}_]"
_N = "[A-Za-z_][A-Za-z0-9_]*"


def _target_sql(text: str) -> str:
    """SQL for the target of a question."""
    p = rf"regexp_replace({text}, '({_E})', '\1\1', 'g')"
    words = rf"list_filter(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '{_N}') AND length(x) > 2 AND lower(x) NOT IN ({_STOP}) AND NOT list_contains(list_transform(regexp_extract_all({p}, '(?:^|{_E})({_N})\.\.[a-z]{{1,4}}(?:$|{_E})', 1), lambda y: lower(y)), lower(x)))"
    code = f"list_filter({words}, lambda x: contains(x, '_') OR (regexp_matches(x, '^[A-Z]') AND upper(x) <> x))"
    return rf"coalesce(regexp_extract_all({p}, '(?:^|{_E})({_N})\s*\(\(\)\)', 1)[-1], regexp_extract_all({p}, '(?:^|{_E})({_N})\s+(?:function|method|class)(?:$|{_E})', 1)[-1], ({code})[-1], ({words})[-1], {text})"


@query(f"""WITH c AS (SELECT conv_id, turn, text, lower(text) AS q, strpos(text, ' to ') AS k FROM conversations),
e AS (SELECT *, {_target_sql("substr(text, 1, greatest(k - 1, 0)::INT)")} AS a, {_target_sql("substr(text, k + 4)")} AS b FROM c)
SELECT conv_id, turn, CASE WHEN contains(q, 'break') OR contains(q, 'impact') OR contains(q, 'blast radius') OR contains(q, 'risky') OR contains(q, 'risk of changing') THEN 'impact'
  WHEN (contains(q, 'chain') OR contains(q, 'path') OR contains(q, 'reach')) AND contains(q, ' to ') AND k > 0 AND a <> '' AND b <> '' AND a <> b THEN 'path'
  WHEN contains(q, 'what does') OR contains(q, 'depend on') OR contains(q, 'depends on') OR contains(q, 'does it call') OR contains(q, 'calls what') THEN 'callees'
  WHEN contains(q, 'call') OR contains(q, 'invoke') OR contains(q, 'uses') OR contains(q, 'used by') THEN 'callers' ELSE 'callers_and_callees' END AS route FROM e""")
def query_routing(t):
    return t("conversations").select("conv_id", "turn", tx.route(F.col("text")).alias("route"))


@query(f"SELECT conv_id, turn, {_target_sql('text')} AS target FROM conversations")
def target_extraction(t):
    return t("conversations").select("conv_id", "turn", tx.target(F.col("text")).alias("target"))


@query(r"""WITH a AS (SELECT conv_id, turn, ['src/m' || (turn % 3) || '.py', 'lib/x.go', 'tests/t.py'] AS paths, CASE conv_id % 8
    WHEN 0 THEN text || ' [src/m0.py:A.run:L3-L9]' WHEN 1 THEN '【src/m1.py:run:3-9】' || text WHEN 2 THEN text || ' `lib/x.go:F:1–2`' WHEN 3 THEN text || ' (src/m2.py:B.go:L1 - L2), [ lib/x.go:G:4-5 ]'
    WHEN 4 THEN text || ' [src/m0.py:L3-L9]' WHEN 5 THEN text || ' src/m1.py:A:1-2' ELSE text END AS answer FROM conversations),
c AS (SELECT *, regexp_extract_all(answer, '[\[【`(]\s*([^\[\]【】`()\s:]+):[^\[\]【】`():]+:L?\d+\s*[-–]\s*L?\d+\s*[\]】`)]', 1) AS p FROM a)
SELECT conv_id, turn, len(list_distinct(p))::INT AS n_cited, len(list_filter(paths, lambda x: list_contains(p, x)))::INT AS sources_used FROM c""")
def citation_count(t):
    """Texts with citations in every form, in a form that isn't one, and without."""
    x, k = F.col("text"), F.col("conv_id") % 8
    made = {0: F.concat(x, F.lit(" [src/m0.py:A.run:L3-L9]")), 1: F.concat(F.lit("【src/m1.py:run:3-9】"), x), 2: F.concat(x, F.lit(" `lib/x.go:F:1–2`")), 3: F.concat(x, F.lit(" (src/m2.py:B.go:L1 - L2), [ lib/x.go:G:4-5 ]")), 4: F.concat(x, F.lit(" [src/m0.py:L3-L9]")), 5: F.concat(x, F.lit(" src/m1.py:A:1-2"))}
    answer = F.coalesce(*[F.when(k == i, a) for i, a in made.items()], x)
    paths = F.array(F.concat(F.lit("src/m"), (F.col("turn") % 3).cast("string"), F.lit(".py")), F.lit("lib/x.go"), F.lit("tests/t.py"))
    return t("conversations").select("conv_id", "turn", F.size(tx.cited(answer)).alias("n_cited"), tx.sources_used(answer, paths).alias("sources_used"))


# --- call graph -------------------------------------------------------------------------------------------------------

_EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""


def _edges(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    e = t("lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst IS NOT NULL AND src <> dst").distinct()


def _nodes(t):
    return t("part").select(F.col("p_partkey").alias("node"))


@query("WITH d AS (SELECT p_partkey AS node, concat_ws(' ', p_name, p_brand) AS name FROM part) SELECT DISTINCT c.node AS src, d.node AS dst FROM d c JOIN d USING (name) WHERE c.node <> d.node")
def call_edges(t):
    named = t("part").select(F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return graph.resolve_calls(named.withColumnRenamed("node", "src"), named)


@query(f"WITH {_EDGES} SELECT DISTINCT n AS node FROM (SELECT src AS n FROM e UNION SELECT dst FROM e) WHERE n NOT IN (SELECT vec_id FROM embeddings)")
def stub_nodes(t):
    return graph.stub_nodes(_edges(t), t("embeddings").select(F.col("vec_id").alias("node")))  # parts without a vector


@query(f"WITH {_EDGES} SELECT p_partkey AS node, (SELECT count(*) FROM e WHERE dst = p_partkey) AS in_degree, (SELECT count(*) FROM e WHERE src = p_partkey) AS out_degree FROM part")
def degrees(t):
    return graph.degrees(_nodes(t), _edges(t))


@query(f"WITH {_EDGES} SELECT dst AS node, count(*) AS in_degree FROM e GROUP BY dst ORDER BY in_degree DESC, node LIMIT 10")
def hubs(t):
    return graph.hubs(_edges(t))


@query(f"WITH {_EDGES} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM e)")
def entry_points(t):
    return graph.entry_points(_nodes(t), _edges(t))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM part) AS nodes, count(*) AS edges, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS mean_in_degree FROM e")
def graph_stats(t):
    return _nodes(t).agg(count("nodes")).crossJoin(_edges(t).agg(count("edges"))).select("nodes", "edges", F.round(F.try_divide("edges", "nodes"), 6).alias("mean_in_degree"))  # two single rows


def _bfs(a: str, b: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node, 0 AS distance UNION SELECT e.{b}, distance + 1 FROM r JOIN e ON e.{a} = r.node WHERE distance < {depth}),
m AS (SELECT node, min(distance)::INT AS distance FROM r GROUP BY node)"""


def _start(t):
    return t("part").where("p_partkey = 1").select(F.col("p_partkey").alias("node"))


@query(_bfs("dst", "src", 3) + " SELECT node, distance FROM m WHERE distance > 0")
def callers_bfs(t):
    return graph.reach(_edges(t), _start(t), 3, backwards=True)


@query(_bfs("src", "dst", 2) + " SELECT node, distance FROM m WHERE distance > 0")
def callees_bfs(t):
    return graph.reach(_edges(t), _start(t), 2)


@query(_bfs("dst", "src", 4) + " SELECT node, distance, CASE distance WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, (SELECT count(*) FROM e WHERE dst = node) AS dependents FROM m WHERE distance > 0")
def impact_risk(t):
    return graph.impact(_edges(t), _start(t))


@query(_bfs("dst", "src", 3) + " SELECT node, distance, round(greatest(0.0, 1 - 0.2 * (distance - 1)), 6)::DOUBLE AS score FROM m WHERE distance > 0")
def distance_scores(t):
    d = F.col("distance")
    return graph.reach(_edges(t), _start(t), 3, backwards=True).withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - 0.2 * (d - 1)), 6))


@query(_bfs("dst", "src", 3) + " SELECT node, distance, CASE WHEN distance = 1 THEN 'direct_caller' ELSE 'indirect_caller' END AS relationship, CASE WHEN distance = 1 THEN 'high' WHEN distance <= 3 THEN 'medium' ELSE 'low' END AS level FROM m WHERE distance > 0")
def labelled_callers(t):
    d = F.col("distance")
    return graph.reach(_edges(t), _start(t), 3, backwards=True).select("node", "distance", impact.directness(d).alias("relationship"), impact.other_scale(d).alias("level"))


@query(_bfs("dst", "src", 5) + " SELECT node, distance FROM m WHERE distance > 0")
def blast_radius(t):
    return graph.reach(_edges(t), _start(t), 5, backwards=True)


@query(_bfs("src", "dst", 3) + ' SELECT node, distance, row_number() OVER (PARTITION BY distance ORDER BY node)::INT AS place, count(*) OVER (PARTITION BY distance) AS "of" FROM m WHERE distance > 0')
def hop_rings(t):
    return impact.rings(graph.reach(_edges(t), _start(t), 3))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT 1::BIGINT AS node, 0 AS distance UNION SELECT e.src, distance + 1 FROM b JOIN e ON e.dst = b.node WHERE distance < 3),
f AS (SELECT 1::BIGINT AS node, 0 AS distance UNION SELECT e.dst, distance + 1 FROM f JOIN e ON e.src = f.node WHERE distance < 2)
SELECT node, min(distance)::INT AS distance, round(greatest(0.0, 1 - 0.2 * (min(distance) - 1)), 6)::DOUBLE AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM f) WHERE node <> 1 GROUP BY node""")
def merged_traversals(t):
    e, s = _edges(t), _start(t)
    both = graph.reach(e, s, 3, backwards=True).unionByName(graph.reach(e, s, 2))
    return impact.nearest(both).withColumn("score", F.round(retrieval.distance_score(F.col("distance")), 6))


@query(f"WITH {_EDGES}, n AS (SELECT count(*) - 1 AS n FROM part), i AS (SELECT dst, count(*) AS i FROM e GROUP BY dst), o AS (SELECT src, count(*) AS o FROM e GROUP BY src) SELECT p_partkey AS node, round(coalesce(i, 0) / n::DOUBLE, 6) AS in_centrality, round(coalesce(o, 0) / n::DOUBLE, 6) AS out_centrality FROM part CROSS JOIN n LEFT JOIN i ON dst = p_partkey LEFT JOIN o ON src = p_partkey")
def degree_centrality(t):
    return impact.degree_centrality(_nodes(t), _edges(t))


@query(f"WITH {_EDGES}, i AS (SELECT dst, count(*) AS i FROM e GROUP BY dst) SELECT p_partkey AS node, coalesce(i, 0) >= 5 OR coalesce(p_size, 0) >= 10 AS high_risk FROM part LEFT JOIN i ON dst = p_partkey")
def high_risk(t):
    callers = _edges(t).groupBy(F.col("dst").alias("d")).agg(count("i"))
    return t("part").join(callers, F.col("p_partkey") == F.col("d"), "left").select(F.col("p_partkey").alias("node"), impact.is_high_risk(F.col("i"), F.col("p_size")).alias("high_risk"))


@query(f"""WITH {_EDGES}, n AS (SELECT p_partkey AS node, p_brand AS file_path, p_size < 20 AS is_test FROM part),
m AS (SELECT s.node AS seed, 'direct_caller' AS relationship, o.node, o.is_test, o.file_path <> s.file_path AS far FROM n s JOIN e ON e.dst = s.node JOIN n o ON o.node = e.src WHERE s.node <= 3
  UNION ALL SELECT s.node, 'direct_callee', o.node, o.is_test, o.file_path <> s.file_path FROM n s JOIN e ON e.src = s.node JOIN n o ON o.node = e.dst WHERE s.node <= 3)
SELECT * FROM (SELECT seed, node, relationship, row_number() OVER (PARTITION BY seed, relationship ORDER BY is_test, far, node)::INT AS place FROM m) WHERE place <= 4""")
def seed_neighbours(t):
    nodes = t("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("file_path"), (F.col("p_size") < 20).alias("is_test"))
    return retrieval.neighbours(_edges(t), nodes, nodes.where("node <= 3").select("node"), True)


@query()
def pagerank(t):
    """To convergence, which no fixed number of unrolled rounds expresses; tests/test_call_graph.py holds it against plain Python."""
    return graph.pagerank(_nodes(t), _edges(t)).select("node", F.round("rank", 7).alias("rank"))


@query("WITH " + _EDGES + """, n AS (SELECT p_partkey::VARCHAR AS node, lower(p_name) AS name FROM part), b AS (SELECT node, CASE WHEN node = '77' THEN 1 WHEN name = '77' THEN 3 WHEN starts_with(name, '77') THEN 4 WHEN contains(node, '77') THEN 5 END AS bucket FROM n)
SELECT node, bucket FROM b WHERE bucket IS NOT NULL AND node <> '77' ORDER BY bucket, (SELECT count(*) FROM e WHERE dst::VARCHAR = node) DESC, node LIMIT 1""")
def node_resolution(t):
    e = _edges(t).select(*[F.col(c).cast("string").alias(c) for c in ("src", "dst")])
    n = t("part").select(F.col("p_partkey").cast("string").alias("node"), F.col("p_name").alias("name"))
    return graph.resolve_node(n.where("node <> '77'"), e, "77")


# --- vectors ----------------------------------------------------------------------------------------------------------


def _query_vector(t, low: int = 0, high: int = 64):
    row = t("embeddings").where("vec_id = 0").select("embedding").first()
    return row[0][low:high] if row and row[0] else [0.0] * (high - low)  # without a query, nothing is near


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q WHERE label < 8 AND vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 30")
def semantic_topk(t):
    return vectors.search(t("embeddings"), _query_vector(t), 30, None, (F.col("label") < 8) & (F.col("vec_id") != 0))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> 0) SELECT vec_id, score FROM s WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 30")
def threshold_topk(t):
    return vectors.search(t("embeddings"), _query_vector(t), 30, 0.2, F.col("vec_id") != 0)


def _half(low: int, high: int, name: str) -> str:
    return f"{name} AS (SELECT vec_id, round(list_cosine_similarity(embedding[{low}:{high}]::DOUBLE[], q[{low}:{high}]::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 40)"


@query(f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), {_half(1, 32, 'a')}, {_half(33, 64, 'b')} SELECT vec_id, round(0.7e0 * coalesce(a.score, 0) + (1 - 0.7e0) * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b USING (vec_id) ORDER BY score DESC, vec_id LIMIT 20")
def hybrid_fusion(t):
    e = t("embeddings")
    halves = [vectors.search(e.select("vec_id", F.slice("embedding", a + 1, 32).alias("embedding")), _query_vector(t, a, a + 32), 40, None) for a in (0, 32)]
    return vectors.fuse(*halves, 20)


@query(f"WITH {_EDGES}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 30), d AS (SELECT dst AS vec_id, count(*) AS d FROM e GROUP BY dst), c AS (SELECT vec_id, score, least(coalesce(d, 0) / 10.0e0, 1.0e0) AS st FROM s LEFT JOIN d USING (vec_id)) SELECT vec_id, score, round(st, 6) AS structural, round(0.7e0 * score + (1 - 0.7e0) * round(st, 6), 6) AS hybrid FROM c")
def centrality_hybrid(t):
    callers = _edges(t).groupBy(F.col("dst").alias("vec_id")).agg(count("in_degree"))
    return vectors.with_centrality(vectors.search(t("embeddings"), _query_vector(t), 30, None), callers)


@query("""WITH m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), d AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], c) AS d FROM embeddings JOIN c USING (label)),
s AS (SELECT label, CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(stddev_pop(d), 1e-8) END AS s FROM d GROUP BY label) SELECT vec_id, label, round(d / s, 4) AS z FROM d JOIN s USING (label) WHERE round(d / s, 4) > 2""")
def outliers(t):
    return vectors.outliers(t("embeddings"))


@query("""WITH m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), d AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], c) AS d FROM embeddings JOIN c USING (label)),
s AS (SELECT label, CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(stddev_pop(d), 1e-8) END AS s FROM d GROUP BY label), z AS (SELECT vec_id, label, round(d / s, 4) AS z FROM d JOIN s USING (label))
SELECT vec_id, label AS cluster, z, CASE WHEN z >= 4 THEN 'severe' WHEN z >= 3 THEN 'moderate' ELSE 'minor' END AS severity, round(0.7e0 * 0.5 + 0.3e0 * least(1.0, z / 5), 6) AS score FROM z WHERE z > 2""")
def outlier_severity(t):
    placed = clusters.with_distance(t("embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    return clusters.outliers(placed, "vec_id").withColumn("score", F.round(clusters.analytical_score(F.lit(0.5), F.col("z")), 6))


@query("WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1) SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM g)")
def dominant_language(t):
    top = t("documents").groupBy("lang").agg(count()).orderBy(F.desc("n"), "lang").limit(1)
    return t("documents").join(top, "lang", "left_semi").select("doc_id", "lang")


# --- ranking, budgets -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, n_chars, spent FROM (SELECT *, (sum(n_chars) OVER w)::BIGINT AS spent, row_number() OVER w AS k FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE spent <= 6000 OR k = 1")
def snippet_budget(t):
    return tables.within_budget(t("documents").select("doc_id", "source", "n_chars"), ["source"], F.col("n_chars"), 6000, F.col("doc_id"))


@query("SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, (sum(length(text) // 4) OVER w)::BIGINT AS spent, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE spent <= 300 OR k = 1")
def token_budget(t):
    d = t("conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).cast("long").alias("c"))
    return tables.within_budget(d, ["conv_id"], F.col("c"), 300, F.col("turn")).drop("c")


@query("SELECT vec_id, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.65 THEN 'medium' ELSE 'low' END AS band FROM (SELECT vec_id, greatest(0.0, least(1.0, embedding[1]::DOUBLE * 4)) AS s FROM embeddings)")
def confidence_bands(t):
    return t("embeddings").select("vec_id", tx.band(F.get("embedding", F.lit(0)).cast("double") * 4).alias("band"))


@query("""WITH RECURSIVE r AS (SELECT n_regionkey AS file, n_nationkey AS rank, n_nationkey % 5 * 10 AS a, n_nationkey % 5 * 10 + 5 + n_nationkey % 7 * 4 AS b FROM nation),
h AS (SELECT o.rank AS o, i.rank AS i FROM r o JOIN r i ON o.file = i.file AND o.a <= i.a AND i.b <= o.b AND (o.a <> i.a OR o.b <> i.b)),
c AS (SELECT rank AS o, rank AS i, 0 AS n FROM r UNION SELECT c.o, h.i, n + 1 FROM c JOIN h ON c.i = h.o)
SELECT file, rank, a AS "start", b AS "end", max(c.i + 0.5e0 * n) AS position FROM r JOIN c ON c.o = r.rank GROUP BY ALL""")
def containment_order(t):
    k = F.col("n_nationkey")
    return tables.container_order(t("nation").select(F.col("n_regionkey").alias("file"), k.alias("rank"), (k % 5 * 10).alias("start"), (k % 5 * 10 + 5 + k % 7 * 4).alias("end")))


@query(f"WITH {_EDGES}, x AS (SELECT src AS seed, dst AS node, row_number() OVER (PARTITION BY src ORDER BY dst % 2, dst) AS k FROM e WHERE src IN (1, 2, 3)) SELECT seed, node, k::INT AS k, round(0.9e0 / seed, 6) AS score FROM x WHERE k <= 4")
def neighbour_expansion(t):
    seeds = _edges(t).where(F.col("src").isin(1, 2, 3)).select(F.col("src").alias("seed"), F.col("dst").alias("node"))
    k = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("node") % 2, "node"))
    return seeds.withColumn("k", k).where("k <= 4").withColumn("score", F.round(F.lit(0.9) / F.col("seed"), 6))


# --- service, evaluation ----------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS position FROM events) WHERE position <= 50")
def history_ring(t):
    return tables.ring(t("events").select("user_id", "event_id", "ts"), ["user_id"], 50, F.desc("ts"), F.desc("event_id")).drop("ts")


@query("SELECT event_id, user_id, n_in_window, n_in_window <= 2 AS allowed FROM (SELECT *, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_in_window FROM events)")
def rate_limit(t):
    return tables.rate_limited(t("events").select("event_id", "user_id", "ts"), 2, "day").drop("ts")


@query("SELECT source, count(*) AS total_chunks, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents GROUP BY source")
def repositories(t):
    return t("documents").groupBy("source").agg(count("total_chunks"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_good, round(avg(value), 4) AS mean, round(count(*) FILTER (WHERE value > 50) / count(*)::DOUBLE, 4) AS rate FROM events GROUP BY GROUPING SETS ((), (event_type))")
def eval_aggregate(t):
    return t("events").rollup("event_type").agg(count(), F.count_if(F.col("value") > 50).alias("n_good"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.count_if(F.col("value") > 50) / F.count(F.lit(1)), 4).alias("rate"))


@query("""WITH l AS (SELECT l_orderkey AS q, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
g AS (SELECT q, arg_max('Part_' || p || '.py', (x, p, s)) AS file, arg_max('Supplier.run' || s, (x, p, s)) AS fn, CASE WHEN q % 3 = 0 THEN 'summarization' ELSE 'lookup' END AS kind FROM l GROUP BY q),
h AS (SELECT g.q, kind, coalesce(max(CASE WHEN k <= 5 AND contains('src/part_' || p || '.py', lower(file)) AND (kind = 'summarization' OR contains('run' || s, lower(fn)) OR contains(lower(fn), 'run' || s) OR contains('run' || s, 'run' || split_part(lower(fn), 'run', 2))) THEN 1 ELSE 0 END), 0) AS hit FROM g JOIN l ON g.q = l.q GROUP BY g.q, kind)
SELECT kind, count(*) AS n, sum(hit)::BIGINT AS hits FROM h GROUP BY kind""")
def hit_rate(t):
    """Orders stand in for questions, their lines for ranked sources, the dearest line for the expected place."""
    s = F.col("s")
    line = t("lineitem").select(F.col("l_orderkey").alias("q"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.concat(F.lit("src/part_"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("file_path"), F.concat(F.lit("run"), F.col("l_suppkey").cast("string")).alias("function_name"), F.struct("l_extendedprice", "l_partkey", "l_suppkey").alias("w"))
    by = line.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("o", "file_path", "function_name"))).alias("s"), F.max("w").alias("w"))
    kind = F.when(F.col("q") % 3 == 0, "summarization").otherwise("lookup")
    hit = tx.hit_at(s, F.concat(F.lit("Part_"), F.col("w.l_partkey").cast("string"), F.lit(".py")), F.concat(F.lit("Supplier.run"), F.col("w.l_suppkey").cast("string")), F.col("kind"))
    return by.withColumn("kind", kind).withColumn("hit", hit).groupBy("kind").agg(count(), F.count_if("hit").alias("hits"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = round_even((0.5e0 * (n - 1))::DOUBLE, 0)::BIGINT THEN round(value, 3) END) AS p50, max(CASE WHEN i = round_even((0.9e0 * (n - 1))::DOUBLE, 0)::BIGINT THEN round(value, 3) END) AS p90,
 max(CASE WHEN i = round_even((0.99e0 * (n - 1))::DOUBLE, 0)::BIGINT THEN round(value, 3) END) AS p99, round(avg(value), 3) AS mean, round(max(value), 3) AS max, count(*) AS n FROM r GROUP BY event_type""")
def latency_percentiles(t):
    return tables.percentile_rows(t("events"), ["event_type"], "value", (50, 90, 99))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS sessions FROM s GROUP BY user_id")
def sessions(t):
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(count()).groupBy("user_id").agg(count("sessions"))
