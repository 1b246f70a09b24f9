"""Entities of each language, and of texts with faults."""

from __future__ import annotations

from quarry.sources import scanner

PYTHON = '''"""Module words."""
import os, sys
from . import q
from .m import z


class Base:
    """Base."""

    def run(self):
        return 1


@final
class Child(Base, metaclass=M):
    class Inner:
        def deep(self): pass

    async def run(self, x: int = 1) -> int:
        if x and x > 1:
            for i in range(x):
                if i:
                    return i
        return 0


def plain():
    def nested():
        pass
'''
SCRIPT = """import React, { useState as state } from './react';
// Adds.
function add(a, b) { return a + b; } // }
const twice = async (x) => { return add(x, x) };
const wrapped = forwardRef((props) => props.x);
class Cart extends Shop.Base {
  constructor(a) { super(a); }
  static async total(items) { if (items) { return 1 } return "}" }
}
"""
TYPED = "interface Shape<T> extends Thing<T>, Other {\n  area(): number;\n  name?: string;\n}\nexport class Sq implements Shape<number> { area(): number { return 1 } }\n"
JAVA = """package a.b;
import java.util.List;
/**
 * A store.
 */
public class Store<T> extends Base<T> implements Closeable, Runnable {
    public Store(int n) { this.n = n; }
    /** Runs. */
    @Override
    public void run() { if (n > 0 && x) { go(); } }
    interface Inner { List<String> names(int k); }
}
enum Color { RED, GREEN; int code() { return 1; } }
record Point(int x, int y) { double norm() { return 0; } }
"""
GO = """package main

import (
	"fmt"
	_ "net/http/pprof"
	str "strings"
)

// Server serves.
// Well.
type Server struct {
	*Base
	name string
}

type Reader interface {
	Read(p []byte) (int, error)
}

func New[T any](n int) *Server { return &Server{} }

func (s *Server) Run(a, b int) error {
	for a < b { fmt.Println("}") }
	return nil
}
"""


def of(language, text):
    found, faults = scanner.entities(language, text)
    return {(e.kind, e.class_name, e.name): e for e in found}, faults


def test_python():
    e, faults = of("python", PYTHON)
    assert not faults
    assert set(e) == {("import", None, "os"), ("import", None, "."), ("import", None, ".m"), ("class", None, "Base"), ("method", "Base", "run"), ("class", None, "Child"), ("class", "Child", "Inner"), ("method", "Inner", "deep"), ("method", "Child", "run"), ("function", None, "plain")}
    child, run = e["class", None, "Child"], e["method", "Child", "run"]
    assert child.bases == ["Base", "metaclass=M"] and child.methods == ["run"] and child.decorators == ["final"] and e["class", None, "Base"].docstring == "Base."
    assert run.is_async and run.signature == "def run(self, x: int=1) -> int:" and run.complexity == 5 and run.cognitive == 1 + 1 + 2 + 3
    assert scanner.module_docstring("python", PYTHON) == "Module words." and scanner.module_docstring("python", "def (") is None


def test_python_with_faults():
    text = "import os\n\ndef broken(a, b:\n    return a\n\n\nclass K:\n    def ok(self):\n        return 1\n\n\ndef hash_token(t):\n    '''Hashes.'''\n    return t\n"
    e, faults = of("python", text)
    assert faults and {("function", None, "broken"), ("class", None, "K"), ("method", "K", "ok"), ("function", None, "hash_token"), ("import", None, "os")} <= set(e)
    h = e["function", None, "hash_token"]
    assert (h.start, h.end, h.docstring) == (12, 14, "Hashes.")


def test_javascript_and_typescript():
    e, faults = of("javascript", SCRIPT)
    assert not faults
    assert {("import", None, "./react"), ("function", None, "add"), ("function", None, "twice"), ("function", None, "wrapped"), ("class", None, "Cart"), ("method", "Cart", "constructor"), ("method", "Cart", "total")} == set(e)
    assert e["import", None, "./react"].bases == ["React", "useState", "state"] and e["class", None, "Cart"].bases == ["Shop.Base"]
    assert e["function", None, "add"].docstring == "Adds." and e["function", None, "add"].signature == "function add(a, b)" and e["function", None, "twice"].is_async
    assert e["method", "Cart", "total"].is_async and e["method", "Cart", "total"].complexity == 2 and e["class", None, "Cart"].methods == ["constructor", "total"]
    e, _ = of("typescript", TYPED)
    assert e["class", None, "Shape"].is_interface and e["class", None, "Shape"].bases == ["Thing", "Other"] and e["class", None, "Shape"].methods == ["area"]
    assert e["class", None, "Sq"].bases == ["Shape"] and ("method", "Sq", "area") in e
    assert of("javascript", "function ok() { return 1 }\nfunction bad( {\n")[1]


def test_java():
    e, _ = of("java", JAVA)
    assert {("import", None, "java.util.List"), ("class", None, "Store"), ("method", "Store", "Store"), ("method", "Store", "run"), ("class", None, "Inner"), ("method", "Inner", "names"), ("class", None, "Color"), ("method", "Color", "code"), ("class", None, "Point"), ("method", "Point", "norm")} == set(e)
    store = e["class", None, "Store"]
    assert store.bases == ["Base", "Closeable", "Runnable"] and store.docstring == "A store." and store.methods == ["Store", "run"]
    assert e["class", None, "Inner"].is_interface and e["method", "Store", "run"].signature == "void Store.run()" and e["method", "Store", "run"].complexity == 3


def test_go():
    e, _ = of("go", GO)
    assert {("import", None, "fmt"), ("import", None, "net/http/pprof"), ("import", None, "strings"), ("class", None, "Server"), ("class", None, "Reader"), ("function", None, "New"), ("method", "Server", "Run")} == set(e)
    s = e["class", None, "Server"]
    assert s.bases == ["Base"] and s.methods == ["Run"] and s.docstring == "Server serves.\nWell." and e["class", None, "Reader"].methods == ["Read"]
    assert e["import", None, "strings"].bases == ["str"] and e["import", None, "net/http/pprof"].bases == ["pprof"]


def test_unknown_and_empty():
    assert scanner.entities("cobol", "x") == ([], False)
    assert all(scanner.entities(k, "") == ([], False) for k in scanner.READERS)


def test_outline():
    text = scanner.outline("class A:\n    def push(self) -> None:\n        pass\n\n    def pop(self): return 1\n", "python", 260, 525)
    assert text.split("\n")[0] == "class A:" and "    L261: def push(self) -> None:" in text and "L264: def pop(self):" in text
    assert scanner.outline("x = 1", "python", 1, 1) is None and scanner.outline("x", "cobol", 1, 1) is None
