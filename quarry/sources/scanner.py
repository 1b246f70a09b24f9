"""Entities of one source text: functions, methods, classes, interfaces, imports. Plain Python, called per file inside Arrow batches.

Python is parsed; a file that doesn't parse is read by its indents, so what stands before and after the fault is still found.
The other languages are read by declarations and braces over a text whose strings and comments are blanked. Lines count from 1.
"""

from __future__ import annotations

import ast
import re
import textwrap
from dataclasses import dataclass, field


@dataclass
class Entity:
    kind: str
    name: str
    start: int
    end: int
    class_name: str | None = None
    signature: str | None = None
    docstring: str | None = None
    body: str | None = None
    is_async: bool = False
    is_interface: bool = False
    bases: list[str] = field(default_factory=list)
    methods: list[str] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    complexity: int | None = None
    cognitive: int | None = None


# --- Python ---

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def _cyclomatic(node: ast.AST) -> int:
    return 1 + sum(isinstance(x, _BRANCH) or (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(node))


def _cognitive(node: ast.AST, depth: int = 0) -> int:
    """A decision costs one and its depth of nesting; an elif is no deeper than its if."""
    total = 0
    for child in ast.iter_child_nodes(node):
        if isinstance(child, _NESTS):
            chained = isinstance(node, ast.If) and isinstance(child, ast.If) and node.orelse == [child]
            total += 1 + (depth - 1 if chained else depth) + _cognitive(child, depth if chained else depth + 1)
        else:
            total += (len(child.values) - 1 if isinstance(child, ast.BoolOp) else 0) + _cognitive(child, depth)
    return total


def _python(text: str) -> list[Entity]:
    tree, lines, out = ast.parse(text), text.split("\n"), []

    def add(node: ast.stmt, owner: str | None) -> None:
        end = node.end_lineno or node.lineno
        body = "\n".join(lines[node.lineno - 1 : end])
        made = [ast.unparse(d) for d in getattr(node, "decorator_list", [])]
        if isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases] + [f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords]
            out.append(Entity("class", node.name, node.lineno, end, owner, f"class {node.name}", ast.get_docstring(node), body, bases=bases, methods=[x.name for x in node.body if isinstance(x, _DEF)], decorators=made))
            for x in node.body:
                if isinstance(x, (*_DEF, ast.ClassDef)):
                    add(x, node.name)
        elif isinstance(node, _DEF):
            returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            out.append(Entity("method" if owner else "function", node.name, node.lineno, end, owner, f"def {node.name}({ast.unparse(node.args)}){returns}:", ast.get_docstring(node), body, isinstance(node, ast.AsyncFunctionDef), decorators=made, complexity=_cyclomatic(node), cognitive=_cognitive(node)))
        elif isinstance(node, ast.Import):
            out.append(Entity("import", node.names[0].name, node.lineno, end, signature=ast.unparse(node), bases=[node.names[0].name]))
        elif isinstance(node, ast.ImportFrom):
            out.append(Entity("import", "." * node.level + (node.module or ""), node.lineno, end, signature=ast.unparse(node), bases=[a.name for a in node.names]))

    for node in tree.body:
        add(node, None)
    return out


_PY_HEAD = re.compile(r"^(?P<indent>[ \t]*)(?P<async>async\s+)?(?P<kind>def|class)\s+(?P<name>\w+)")


def _python_by_indent(text: str) -> list[Entity]:
    """What can be told of a file that doesn't parse: each definition up to the next line that isn't deeper; parsed alone if it can be."""
    lines, out, owners = text.split("\n"), [], []
    for i, line in enumerate(lines):
        if m := re.match(r"(?:from\s+(\.*[\w.]*)\s+import|import\s+([\w.]+))", line):
            out.append(Entity("import", m[1] or m[2], i + 1, i + 1, signature=line.strip()))
        if not (m := _PY_HEAD.match(line)):
            continue
        depth, end = len(m["indent"].expandtabs(4)), i + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end].expandtabs(4)) - len(lines[end].expandtabs(4).lstrip()) > depth):
            end += 1
        while end > i + 1 and not lines[end - 1].strip():
            end -= 1
        owners = [o for o in owners if o[0] < depth]
        if any(kind == "def" for _, kind, _ in owners):
            continue  # nested functions are no entities
        owner = owners[-1][2] if owners else None
        owners.append((depth, m["kind"], m["name"]))
        body = "\n".join(lines[i:end])
        try:
            own = next(e for e in _python(textwrap.dedent(body)) if e.name == m["name"])
            own.start, own.end, own.class_name, own.body = i + 1, end, owner, body
            own.kind = "method" if owner and own.kind == "function" else own.kind
        except (SyntaxError, ValueError, StopIteration):
            kind = "class" if m["kind"] == "class" else "method" if owner else "function"
            own = Entity(kind, m["name"], i + 1, end, owner, line.strip(), body=body, is_async=bool(m["async"]))
        out.append(own)
    return out


# --- languages with braces ---

_HIDDEN = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_FLOW = ("if", "for", "while", "switch", "catch", "function", "return", "new", "super", "else", "do", "try", "throw", "await", "typeof", "constructor_")
_DECIDES = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])")


def blanked(text: str) -> str:
    """Strings and comments as spaces; line ends stay."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int, signs: str = "{}") -> int:
    """Place after the sign that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == signs[0]) - (text[i] == signs[1])
        if depth == 0 and text[i] == signs[1]:
            return i + 1
    return len(text)


class Braced:
    """A text with what all languages with braces share."""

    def __init__(self, text: str):
        self.text, self.plain = text, blanked(text)
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.out: list[Entity] = []
        depth, self.depth = 0, []
        for c in self.plain:
            depth -= c == "}"
            self.depth.append(depth)
            depth += c == "{"

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_left(self.breaks, at) + 1

    def doc(self, at: int) -> str | None:
        """The comment that ends on the line just above: a block, or neighbouring lines of //."""
        lines = self.text[:at].rsplit("\n", 1)[0].split("\n") if "\n" in self.text[:at] else []
        found: list[str] = []
        if lines and lines[-1].strip().endswith("*/"):
            while lines:
                found.insert(0, lines.pop())
                if "/*" in found[0]:
                    break
        else:
            while lines and lines[-1].strip().startswith("//"):
                found.insert(0, lines.pop())
        text = "\n".join(re.sub(r"^\s*(?:/\*+|\*+/|\*|//+)?\s?|\s*\*+/\s*$", "", x) for x in found).strip()
        return text or None

    def add(self, kind: str, name: str, start: int, stop: int, **more) -> Entity:
        body = self.text[start:stop]
        e = Entity(kind, name, self.line(start), self.line(stop - 1), body=body, docstring=self.doc(start), **more)
        if kind in ("function", "method"):
            inner = blanked(body)
            at, e.cognitive, depth = 0, 0, -1
            for m in re.finditer(_DECIDES.pattern + r"|[{}]", inner):
                depth += (m[0] == "{") - (m[0] == "}")
                e.cognitive += 0 if m[0] in "{}" else 1 if m[0] in ("&&", "||") else 1 + max(depth, 0)
                at += m[0] not in "{}"
            e.complexity = 1 + at
        self.out.append(e)
        return e

    def within(self, pattern: re.Pattern, start: int, stop: int, depth: int):
        """Matches between two places that begin at this depth of braces."""
        for m in pattern.finditer(self.plain, start, stop):
            if self.depth[m.start("name")] == depth:
                yield m


def flat(text: str) -> str:
    return " ".join(text.split())


def names(text: str) -> list[str]:
    """Names in a list of types, without their arguments."""
    while (bare := re.sub(r"<[^<>]*>", "", text)) != text:
        text = bare
    return [x.strip() for x in text.split(",") if x.strip()]


_JS_FUNCTION = re.compile(r"(?P<async>\basync\s+)?\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\(")
_JS_CLASS = re.compile(r"\bclass\s+(?P<name>[A-Za-z_$][\w$]*)(?P<head>[^{]*)\{")
_JS_VALUE = re.compile(r"\b(?P<word>const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:[\w$.]+\s*(?:<[^>]*>)?\(\s*)?(?P<async>async\s+)?(?:function\s*\*?\s*[\w$]*\s*\((?P<a>[^)]*)\)|\((?P<b>[^)]*)\)\s*(?::[^=>{]+)?=>|(?P<c>[A-Za-z_$][\w$]*)\s*=>)")
_JS_METHOD = re.compile(r"(?:^|[\n;{}])\s*(?P<words>(?:(?:public|private|protected|static|async|get|set|override|abstract)\s+)*)\*?\s*(?P<name>[#A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\((?P<params>[^)]*)\)\s*(?::[^{;]+)?\{")
_JS_IMPORT = re.compile(r"""^[ \t]*import\s+(?:type\s+)?(?P<clause>[^;'"]*?)\s*(?:from\s*)?["'](?P<name>[^"']+)["']""", re.M)
_TS_INTERFACE = re.compile(r"\binterface\s+(?P<name>[A-Za-z_$][\w$]*)(?:<[^{]*?>)?(?P<head>[^{]*)\{")


def _heritage(head: str) -> list[str]:
    return [n for part in re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\b(?:extends|implements)\b|$)", head, re.S) for n in names(part)]


def _javascript(text: str, typed: bool = False) -> list[Entity]:
    b = Braced(text)
    for m in _JS_IMPORT.finditer(text):
        named = [x for x in re.findall(r"[A-Za-z_$][\w$]*", m["clause"] or "") if x not in ("as", "type")]
        b.add("import", m["name"], m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), signature=flat(m[0]), bases=named)
    for m in _JS_FUNCTION.finditer(b.plain):
        shut = closing(b.plain, m.end() - 1, "()")
        opened = b.plain.find("{", shut)
        if opened >= 0:
            b.add("function", m["name"], m.start(), closing(b.plain, opened), is_async=bool(m["async"]), signature=f"{'async ' if m['async'] else ''}function {m['name']}{flat(text[m.end() - 1 : shut])}")
    for m in _JS_VALUE.finditer(b.plain):
        rest = re.compile(r"\s*\{").match(b.plain, m.end())
        line_end = b.plain.find("\n", m.end())
        stop = closing(b.plain, rest.end() - 1) if rest else line_end if line_end >= 0 else len(text)
        params = flat(m["a"] or m["b"] or m["c"] or "")
        b.add("function", m["name"], m.start("name"), stop, is_async=bool(m["async"]), signature=f"const {m['name']} = ({params}) => ...")
    for m in _JS_CLASS.finditer(b.plain):
        stop = closing(b.plain, m.end() - 1)
        own = b.add("class", m["name"], m.start(), stop, signature=flat(text[m.start() : m.end() - 1]), bases=_heritage(m["head"]))
        for x in b.within(_JS_METHOD, m.end() - 1, stop, b.depth[m.end() - 1] + 1):
            if x["name"] not in _FLOW:
                start = x.start("words") if x["words"] else x.start("name")
                own.methods.append(x["name"])
                b.add("method", x["name"], start, closing(b.plain, x.end() - 1), class_name=m["name"], is_async="async" in x["words"], signature=f"{flat(x['words'])} {x['name']}({flat(x['params'])})".strip())
    if typed:
        for m in _TS_INTERFACE.finditer(b.plain):
            stop = closing(b.plain, m.end() - 1)
            own = b.add("class", m["name"], m.start(), stop, is_interface=True, signature=flat(text[m.start() : m.end() - 1]), bases=_heritage(m["head"]))
            own.methods = re.findall(r"(?:^|[;,\n])\s*([A-Za-z_$][\w$]*)\??\s*\(", b.plain[m.end() : stop])
    return b.out


_JAVA_TYPE = re.compile(r"(?P<words>(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*)\b(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)(?P<head>[^{;]*)\{")
_JAVA_METHOD = re.compile(r"(?:^|[\n;{}])\s*(?:@\w+(?:\([^)]*\))?\s*)*(?P<words>(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*)(?:<[^>]+>\s+)?(?P<ret>[\w.]+(?:<[^;(){}]*>)?(?:\[\])*\s+)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws\s+[\w., ]+)?\s*(?P<end>[{;])")
_JAVA_IMPORT = re.compile(r"^[ \t]*import\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)\s*;", re.M)


def _java(text: str) -> list[Entity]:
    b = Braced(text)
    for m in _JAVA_IMPORT.finditer(b.plain):
        b.add("import", m["name"], m.start(), m.end(), signature=flat(m[0]), bases=[m["name"].rsplit(".", 1)[-1]])
    for m in _JAVA_TYPE.finditer(b.plain):
        stop = closing(b.plain, m.end() - 1)
        own = b.add("class", m["name"], m.start(), stop, is_interface=m["kind"] == "interface", signature=flat(text[m.start() : m.end() - 1]), bases=_heritage(m["head"]))
        start = m.end() - 1
        if m["kind"] == "enum":  # members stand after the constants
            start = max(b.plain.find(";", m.end(), stop), start)
        for x in b.within(_JAVA_METHOD, start, stop, b.depth[m.end() - 1] + 1):
            if x["name"] in _FLOW or (x["ret"] or "").strip() in ("new", "return", "else", "throw") or (not x["ret"] and x["name"] != m["name"]):
                continue
            at = x.start("words") if x["words"] else x.start("ret") if x["ret"] else x.start("name")
            own.methods.append(x["name"])
            b.add("method", x["name"], at, closing(b.plain, x.end() - 1) if x["end"] == "{" else x.end(), class_name=m["name"], signature=f"{flat(x['ret'] or '')} {m['name']}.{x['name']}({flat(x['params'])})".strip())
    return b.out


_GO_TYPE = re.compile(r"^(?P<word>type\s+|[ \t]+)(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\s*\{", re.M)
_GO_FUNC = re.compile(r"^func\s*(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*\(", re.M)
_GO_IMPORT = re.compile(r"""^(?:import\s+|[ \t]+)(?:(?P<alias>[\w.]+)\s+)?"(?P<name>[^"\n]+)"[ \t]*(?://[^\n]*)?$""", re.M)


def _go(text: str) -> list[Entity]:
    b = Braced(text)
    head = re.search(r"^(?:func|type|var|const)\b", b.plain, re.M)
    for m in _GO_IMPORT.finditer(text, 0, head.start() if head else len(text)):
        alias = None if m["alias"] in (None, "_") else m["alias"]
        b.add("import", m["name"], m.start("name") - 1, m.end("name") + 1, signature=flat(m[0]), bases=[alias or m["name"].rsplit("/", 1)[-1]])
    types = {}
    for m in _GO_TYPE.finditer(b.plain):
        if b.depth[m.start("name")]:
            continue
        stop = closing(b.plain, m.end() - 1)
        body = [x.strip() for x in b.plain[m.end() : stop - 1].split("\n")]
        embedded = [re.sub(r"\[.*\]", "", x.lstrip("*")).rsplit(".", 1)[-1] for x in body if re.fullmatch(r"\*?[\w.]+(?:\[[^\]]*\])?", x)]
        types[m["name"]] = b.add("class", m["name"], m.start(), stop, is_interface=m["kind"] == "interface", signature=f"type {m['name']} {m['kind']}", bases=embedded)
        if m["kind"] == "interface":
            types[m["name"]].methods = [x[1] for x in (re.match(r"(\w+)\s*\(", y) for y in body) if x]
    for m in _GO_FUNC.finditer(b.plain):
        shut = closing(b.plain, m.end() - 1, "()")
        opened = b.plain.find("{", shut)
        if opened < 0:
            continue
        owner = None
        if m["recv"]:
            owner = re.sub(r"\[.*\]", "", m["recv"].split()[-1].lstrip("*"))
            if owner in types:
                types[owner].methods.append(m["name"])
        b.add("method" if owner else "function", m["name"], m.start(), closing(b.plain, opened), class_name=owner, signature=flat(text[m.start() : opened]))
    return b.out


READERS = {"python": _python, "javascript": _javascript, "typescript": lambda t: _javascript(t, True), "java": _java, "go": _go}


def entities(language: str, text: str) -> tuple[list[Entity], bool]:
    """(entities in order of line, whether the text had faults); of a language that isn't known none."""
    reader = READERS.get(language)
    if reader is None:
        return [], False
    faults = False
    try:
        found = reader(text)
    except (SyntaxError, ValueError, RecursionError):
        found, faults = _python_by_indent(text), True
    if language != "python":
        plain = blanked(text)
        faults = any(plain.count(a) != plain.count(z) for a, z in ("{}", "()"))
    return sorted(found, key=lambda e: (e.start, e.end)), faults


def module_docstring(language: str, text: str) -> str | None:
    if language != "python":
        return None
    try:
        return ast.get_docstring(ast.parse(text))
    except (SyntaxError, ValueError):
        return None


def outline(text: str, language: str, first_line: int, last_line: int, width: int = 200) -> str | None:
    """The first line and the signature of each nested definition with its line in the file; None if there is none."""
    inner = [e for e in entities(language, textwrap.dedent(text) if language == "python" else text)[0] if e.kind != "import" and e.start > 1]
    if not inner:
        return None
    lines = text.split("\n")
    rows = []
    for e in inner:
        own = lines[e.start - 1]
        indent = len(own) - len(own.lstrip())
        rows.append(f"{' ' * indent}L{first_line + e.start - 1}: {flat(e.signature or own)[:width]}")
    note = f"    # [chunk too large for the prompt — outline only, bodies omitted. Full source spans L{first_line}-L{last_line}.]"
    return "\n".join([lines[0], note, *rows])
