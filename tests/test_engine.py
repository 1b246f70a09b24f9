"""A small tree from scan to answers."""

from __future__ import annotations

import pytest

from quarry.engine import Engine
from quarry.operators import chunks
from quarry.sources import files

APP = '''"""The application."""
import os


class Pool:
    """Holds connections."""

    def close(self):
        """Closes the pool of connections."""
        return release_connection(self)


class Session:
    def close(self):
        return commit_changes(self)


def release_connection(pool):
    """Releases one connection to the pool."""
    if pool and pool.size:
        return 1
    return 0


def commit_changes(session):
    """Commits pending changes of the session."""
    return write_log(session)


def write_log(session):
    """Writes the log record of a commit."""
    return 0
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {"app.py": APP, "web/cart.js": "function total(items) { return sum(items) }\nfunction sum(x) { return 1 }\n", "tests/test_app.py": "def test_close():\n    write_log(1)\n", "node_modules/x.js": "function no() {}\n", "notes.txt": "no", "broken.py": "def bad(:\n  pass\n\ndef fine():\n    return write_log(2)\n"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    (root / "bin.py").write_bytes(b"\x10\x01\x00abc")
    (root / "odd.py").write_bytes(b"# \x10\x01 abc\n")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    assert e.state() is None and e.ingest(tree)["status"] == "indexed"
    return e


def test_scan(spark, tree):
    got = {r["rel_path"]: r["skip_reason"] for r in files.scan(spark, tree).collect()}
    assert got == {"app.py": None, "web/cart.js": None, "tests/test_app.py": None, "broken.py": None, "odd.py": None, "bin.py": "binary", "notes.txt": "extension", "node_modules/x.js": "directory"}
    kept = files.kept(files.scan(spark, tree), "python", tests=False)
    assert {r[0] for r in kept.select("rel_path").collect()} == {"app.py", "broken.py", "odd.py"}
    with pytest.raises(ValueError):
        files.kept(files.scan(spark, tree), "cobol")
    assert files.repository("https://host/own/repo.git") == ("own", "repo") and files.within_limits(60_000) and files.within_limits(3) is None


def test_ingest(engine, tree):
    state = engine.ingest(tree)
    assert state["status"] == "up_to_date" and state["files"] == 5 and state["languages"] == ["javascript", "python"]
    assert engine.ingest(tree, force=True)["status"] == "indexed"
    nodes = {r["node"] for r in engine.table("nodes").collect()}
    assert {"app.py::Pool.close", "app.py::Session.close", "broken.py::fine", "web/cart.js::total"} <= nodes
    edges = {(r["src"], r["dst"]) for r in engine.table("edges").collect()}
    assert {("app.py::Pool.close", "app.py::release_connection"), ("app.py::commit_changes", "app.py::write_log"), ("tests/test_app.py::test_close", "app.py::write_log"), ("web/cart.js::total", "web/cart.js::sum")} <= edges
    made = {r["qualified_name"]: r for r in engine.table("chunks").where("file_path = 'app.py'").collect()}
    assert made["release_connection"]["complexity"] == 3 and made["Pool"]["complexity"] is None and made["app"]["chunk_type"] == "module" and made["app"]["imports"] == ["os"] and made["Pool.close"]["chunk_type"] == "method"
    one = chunks.summary(engine.table("chunks")).first()
    assert one["total"] == state["chunks"] and one["by_type"]["class"] == 2
    assert chunks.summary(engine.table("chunks").limit(0)).first()["total"] == 0


def test_questions(engine):
    got = engine.query("where is one connection released to the pool")
    assert not got["refused"] and got["type"] == "lookup" and any(s["function_name"] == "release_connection" for s in got["sources"]) and got["sources_used"] == len(got["sources"])
    got = engine.query("what calls write_log()?")
    assert got["type"] == "relational" and {s["function_name"] for s in got["sources"]} >= {"commit_changes", "fine"}
    assert engine.query("zzz qqq xxx", path="nowhere")["refused"]
    assert engine.query("quantum zebra yacht")["refused"]
    many = engine.query_batch(["what calls write_log()?", None])
    assert not many[0]["refused"] and "error" in many[1]
    with pytest.raises(ValueError):
        engine.query_batch(["x"] * 21)


def test_impact_and_summary(engine):
    got = engine.impact("write_log")
    assert got["node"] == "app.py::write_log" and {r["node"]: r["distance"] for r in got["affected"].collect()} == {"app.py::commit_changes": 1, "broken.py::fine": 1, "tests/test_app.py::test_close": 1, "app.py::Session.close": 2}
    assert engine.impact("nothing_like_it")["node"] is None
    one = engine.summarize("app.py")
    assert one["files"] == 1 and not one["sampled"] and one["components"][0] == "app.py::write_log" and "app.py::write_log" in one["entry_points"]
    with pytest.raises(LookupError):
        engine.summarize("no/such/file.py")
