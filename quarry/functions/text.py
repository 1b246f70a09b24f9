"""Column expressions over source text: identifiers, complexity, embeddable text, routing, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the system whose results are matched.
DECISIONS = ("if", "elif", "for", "while", "except", "case", "catch")
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "print", "super", "new", "async", "await", "yield", "with", "except", "elif", "func", "function", "def", "lambda")
STOPWORDS = (
    "what", "who", "which", "does", "do", "calls", "call", "calling", "the", "a", "an", "is", "are", "in", "of", "to", "on", "from",
    "function", "method", "module", "class", "would", "break", "if", "changed", "change", "depend", "depends", "and", "or", "how",
)
IMPACT_WORDS = ("break", "impact", "blast radius", "risky", "risk of changing")
PATH_WORDS = ("chain", "path", "reach")
CALLEE_WORDS = ("what does", "depend on", "depends on", "does it call", "calls what")
CALL_WORDS = ("call", "invoke", "uses", "used by")
EXCLUDED_DIRS = ("venv", ".venv", "env", "__pycache__", "node_modules", ".git", "dist", "build", ".mypy_cache", ".pytest_cache", "htmlcov", "migrations")
EXCLUDED_SUFFIXES = (".min.js", ".min.ts", ".d.ts")

_NAME = "[A-Za-z_][A-Za-z0-9_]*"


def chunk_id(url: Column, path: Column, name: Column, line: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the four parts joined by '::'."""
    return F.substring(F.sha2(F.concat_ws("::", url, path, name, line.cast("string")), 256), 1, 16)


def _times(body: Column, what: str) -> Column:
    return F.floor((F.length(body) - F.length(F.replace(body, F.lit(what), F.lit("")))) / len(what)).cast("int")


def decision_count(body: Column, language: Column | None = None) -> Column:
    """Occurrences of decision words, of && and ||, and in Python of and/or, without regard to strings and comments; 'else if' counts as itself and as 'if'."""
    words = "|".join(DECISIONS)
    plain, python = (F.regexp_count(body, F.lit(rf"(?U)\b(?:{w})\b")) for w in (words, words + "|and|or"))
    counted = plain if language is None else F.when(language == "python", python).otherwise(plain)
    return counted + F.regexp_count(body, F.lit(r"(?U)\belse if\b")) + _times(body, "&&") + _times(body, "||")


def rating(complexity: Column) -> Column:
    return F.when(complexity <= 5, "low").when(complexity <= 10, "moderate").when(complexity <= 20, "high").otherwise("very_high")


def lines_of_code(body: Column) -> Column:
    """Lines that are neither blank nor start with a comment sign."""
    return F.size(F.filter(F.split(body, "\n", -1), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(#|//|\*|/\*)")))


def embeddable(title: Column, doc: Column, body: Column, head: int = 1500, tail: int = 150) -> Column:
    """Title, doc string and the start of the body; a longer body keeps its end too."""
    cut = F.when(F.length(body) > head, F.concat(F.substring(body, 1, head), F.lit(" ... "), F.right(body, F.lit(tail)))).otherwise(body)
    return F.concat_ws("\n", title, F.nullif(F.trim(doc), F.lit("")), cut)


def without_definitions(body: Column) -> Column:
    """A space in place of def, class and function with their name, and of func with its receiver and name."""
    return F.regexp_replace(body, rf"(?U)\b(?:def|class|function\*?)\s+{_NAME}|\bfunc\s*(?:\([^)]*\)\s*)?{_NAME}", " ")


def call_names(body: Column, own: Column | None = None) -> Column:
    """Distinct identifiers followed by '(', without keywords, without definitions, without the function's own name."""
    names = F.array_distinct(F.regexp_extract_all(without_definitions(body), F.lit(rf"(?U)\b({_NAME})\s*\("), F.lit(1)))
    names = F.array_except(names, F.array(*map(F.lit, CALL_KEYWORDS)))
    return names if own is None else F.array_remove(names, own)


def excluded_path(path: Column, dirs: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    ends = reduce(Column.__or__, [path.endswith(x) for x in EXCLUDED_SUFFIXES])
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dirs))) | ends


def test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests"))) | F.element_at(parts, -1).startswith("test_")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def ends_of_path(question: Column) -> tuple[Column, Column]:
    """The targets before and after the first ' to '."""
    at = F.locate(" to ", question)
    return target(F.substring(question, F.lit(1), F.greatest(at - 1, F.lit(0)))), target(F.substring(question, at + 4, F.length(question)))


def route(question: Column) -> Column:
    """impact (depth 4), path, callees (2), callers (3) or callers_and_callees: the first rule that the question meets, by substrings. A path needs two different ends."""
    q = F.lower(question)
    first, last = ends_of_path(question)
    return (
        F.when(_holds(q, IMPACT_WORDS), "impact")
        .when(_holds(q, PATH_WORDS) & q.contains(" to ") & (F.locate(" to ", question) > 0) & (first != "") & (last != "") & (first != last), "path")
        .when(_holds(q, CALLEE_WORDS), "callees")
        .when(_holds(q, CALL_WORDS), "callers")
        .otherwise("callers_and_callees")
    )


def _last_beside(words: Column, left_out: Column) -> Column:
    """The last word that, in small letters, isn't left out; null if there is none. In proportion to both arrays: no array is made or searched again for each word."""
    back = F.reverse(words)
    small = F.transform(back, F.lower)
    return F.get(back, F.array_position(small, F.get(F.array_except(small, left_out), F.lit(0))).cast("int") - 1)


def target(question: Column) -> Column:
    """The code name a question is about: the last name(), else the last 'name function|method|class', else the last code-like word, else the last word that is no stop word, file-name stem or shorter than three letters, else the question."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    found = lambda pattern: F.regexp_extract_all(question, F.lit("(?U)" + pattern), F.lit(1))
    stems = F.transform(found(rf"\b({_NAME})\.[a-z]{{1,4}}\b"), F.lower)
    tokens = F.filter(found(rf"\b({_NAME})\b"), lambda t: (F.length(t) > 2) & ~F.lower(t).isin(*STOPWORDS))
    codelike = lambda words: F.filter(words, lambda t: t.contains("_") | (t.rlike("^[A-Z]") & (F.upper(t) != t)))
    # a lambda's variable holds both arrays, so each is made once; named inside another lambda they would be made for each word
    words = F.transform(F.array(F.struct(tokens.alias("tokens"), stems.alias("stems"))), lambda w: F.coalesce(_last_beside(codelike(w["tokens"]), w["stems"]), _last_beside(w["tokens"], w["stems"])))
    return F.coalesce(last(found(rf"\b({_NAME})\s*\(\)")), last(found(rf"\b({_NAME})\s+(?:function|method|class)\b")), F.get(words, F.lit(0)), question)


def band(similarity: Column, high: float = 0.8, medium: float = 0.65) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))
    return F.when(s >= high, "high").when(s >= medium, "medium").otherwise("low")


#: path:name:first-last in square, full-width or round brackets or backticks; L before numbers, either dash, spaces inside. Fixed format.
CITATION = r"[\[【`(]\s*([^\[\]【】`()\s:]+):[^\[\]【】`():]+:L?\d+\s*[-–]\s*L?\d+\s*[\]】`)]"


def cited(answer: Column) -> Column:
    """Distinct paths that the answer cites; of a null answer none."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1)))


def sources_used(answer: Column, paths: Column) -> Column:
    """How many of the sources (an array of paths, repeats counted) have their path cited."""
    found = cited(answer)
    return F.size(F.filter(paths, lambda p: F.array_contains(found, p)))


def hit_at(sources: Column, file: Column, function: Column, kind: Column, k: int = 5) -> Column:
    """Whether one of the first k sources (structs file_path, function_name) has the expected file, and the function too unless the question is a summarization.

    Without regard to case. Files match if either path holds the other; functions if either name holds the other, or the source's holds the last part of the expected one.
    """
    gf, gn = F.lower(file), F.lower(function)
    base = F.element_at(F.split(gn, r"\."), -1)

    def fits(s: Column) -> Column:
        sf, sn = F.lower(F.coalesce(s["file_path"], F.lit(""))), F.lower(F.coalesce(s["function_name"], F.lit("")))
        return (sf.contains(gf) | gf.contains(sf)) & ((kind == "summarization") | sn.contains(gn) | gn.contains(sn) | sn.contains(base))

    return F.exists(F.slice(sources, 1, k), fits)
