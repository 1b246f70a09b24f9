"""Column expressions against the cases they must match, as values."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import tables


def of(spark, rows, *columns):
    """Values of column functions over rows of one text."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, t string")
    return [tuple(r)[1:] for r in df.select("i", *[f(F.col("t")).alias(f"c{k}") for k, f in enumerate(columns)]).orderBy("i").collect()]


CITED = [
    "[src/flask/app.py:Flask.wsgi_app:L1569-L1619]", "[src/flask/app.py:Flask.wsgi_app:1569-1619]", "【src/flask/app.py:Flask.wsgi_app:1569-1619】",
    "`src/flask/app.py:Flask.wsgi_app:1569-1619`", "(src/flask/app.py:Flask.wsgi_app:1569–1619)", "[ src/flask/app.py:Flask.wsgi_app:L1569 - L1619 ]",
]
NOT_CITED = ["Flask.wsgi_app calls it in src/flask/app.py.", "[src/flask/app.py:L3-L9]", "", None]


def test_citations(spark):
    paths = F.array(F.lit("src/flask/app.py"), F.lit("tests/test_basic.py"), F.lit("examples/app.py"))
    two = "See 【src/flask/app.py:A.b:1-2】 and 【src/flask/app.py:A.c:3-4】, plus [tests/test_basic.py:t:L2-L3]."
    got = of(spark, [f"it calls {c}." for c in CITED] + [two] + NOT_CITED, lambda t: tx.sources_used(t, paths))
    assert [g[0] for g in got] == [1] * len(CITED) + [2] + [0] * len(NOT_CITED)


def test_decisions(spark):
    texts = ["for for for", "if x else if y elif", "a && b || c &&& d", "iffy forest", "x and y or z", "", None, "éif if"]
    got = of(spark, texts, tx.decision_count, lambda t: tx.decision_count(t, F.lit("python")))
    assert [g[0] for g in got] == [3, 4, 3, 0, 0, 0, None, 1]
    assert [g[1] for g in got] == [3, 4, 3, 0, 2, 0, None, 1]


def test_calls(spark):
    texts = ["def f(a): return g (h(1), lambda (x): x)", "func (r *T) Run(x int) { go1() }", "function* gen(a) { yield (b) }", "class A(B): def __call__(self): run()", "xdef f(1)", "", None]
    got = of(spark, texts, tx.call_names)
    assert [sorted(g[0]) if g[0] is not None else None for g in got] == [["g", "h"], ["go1"], [], ["run"], ["f"], [], None]


def test_targets_and_routes(spark):
    cases = {
        "What calls authenticate()?": ("authenticate", "callers"),
        "what breaks if I change the update function in cache.py?": ("update", "impact"),
        "is it risky to touch load_state": ("load_state", "impact"),
        "what does AdaptiveCache depend on": ("AdaptiveCache", "callees"),
        "chain from parse_file to build_graph": ("build_graph", "path"),
        "who is used by cache.py": ("used", "callers"),
        "tell me about hash_token": ("hash_token", "callers_and_callees"),
        "the of": ("the of", "callers_and_callees"),
    }
    got = of(spark, list(cases), tx.target, tx.route)
    assert dict(zip(cases, got, strict=True)) == cases


def plain_target(text):
    names = re.findall(r"\b([A-Za-z_][A-Za-z0-9_]*)\b", text)
    stems = {x.lower() for x in re.findall(r"\b([A-Za-z_][A-Za-z0-9_]*)\.[a-z]{1,4}\b", text)}
    words = [x for x in names if len(x) > 2 and x.lower() not in tx.STOPWORDS and x.lower() not in stems]
    for found in (re.findall(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(\)", text), re.findall(r"\b([A-Za-z_][A-Za-z0-9_]*)\s+(?:function|method|class)\b", text), [x for x in words if "_" in x or (x[0].isupper() and x.upper() != x)], words):
        if found:
            return found[-1]
    return text


def test_targets_against_plain_python(spark):
    draw = random.Random(7)
    parts = ["Cache", "cache", "cache.py", "CACHE.go", "load_x", "load_x.ts", "Load_X", "the", "What", "function", "run", "run()", "run ()", "ab", "HTTP", "Http.java", "Http", "9lives", "é_x", "."]
    texts = [" ".join(draw.choices(parts[: draw.randint(2, len(parts))], k=draw.randint(0, 8))) for _ in range(400)] + [None]
    assert [g for (g,) in of(spark, texts, tx.target)] == [t if t is None else plain_target(t) for t in texts]


def test_target_of_a_long_text_takes_no_longer_than_its_words(spark):
    text = " ".join(f"Word{i} w{i} lib{i}.py" for i in range(8000)) + " lib1"
    began = time.monotonic()
    assert of(spark, [text], tx.target) == [("Word7999",)]
    assert time.monotonic() - began < 30  # the words' regular expressions run once a text, not once a word


def test_excluded(spark):
    got = of(spark, ["a/migrations/x.py", "a/.venv/x.py", "a/x.d.ts", "a/x.min.js", "src/builds/x.py", "htmlcov", "x.ts"], tx.excluded_path)
    assert [g[0] for g in got] == [True, True, True, True, False, True, False]


@pytest.mark.parametrize("rows, want", [
    ([("f", 1, 9, 0), ("f", 2, 8, 1), ("f", 3, 4, 5)], [6.0, 5.5, 5.0]),
    ([("f", 1, 9, 0), ("f", 1, 9, 1), ("g", 2, 3, 2)], [0.0, 1.0, 2.0]),
    ([("f", 1, 9, 0), ("f", 1, 9, 0), ("f", 2, 3, 4)], [4.5, 4.5, 4.0]),
    ([(None, 1, 9, 0), (None, 2, 3, 4)], [0.0, 4.0]),
    ([], []),
])
def test_container_order(spark, rows, want):
    df = spark.createDataFrame(rows, "file string, start int, `end` int, rank int")
    got = sorted(tuple(r) for r in tables.container_order(df).select("rank", "position").collect())
    assert got == sorted(zip([r[3] for r in rows], want, strict=True))


def test_hits(spark):
    source = "array(struct('src/App/main.py' AS file_path, f AS function_name))"
    cases = [("App.run", "src/app/main.py", "App.run", "lookup", True), ("run", "main.py", "App.run", "lookup", True), ("other", "main.py", "App.run", "lookup", False), ("other", "main.py", "App.run", "summarization", True), ("run", "lib.py", "run", "lookup", False)]
    df = spark.createDataFrame(cases, "f string, gf string, gn string, kind string, want boolean").withColumn("s", F.expr(source))
    assert all(r["got"] == r["want"] for r in df.withColumn("got", tx.hit_at(F.col("s"), F.col("gf"), F.col("gn"), F.col("kind"))).collect())


def test_renames(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("x", "2"), ("y", "9")], "path string, sha256 string")
    assert [tuple(r) for r in tables.renames(old, new).collect()] == [("b", "x")]
    assert tables.renames(old, old).count() == 0 and tables.renames(old.limit(0), new).count() == 0
