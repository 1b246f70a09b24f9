"""The operators written down plainly, without regard to speed."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def base_counts(text: str | None) -> tuple:
    t = text or ""
    w = words(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def removals(rows: list[tuple], width: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows of (doc_id, text); null ids come first."""
    order = lambda k: (k is not None, k or 0)
    first: dict[bytes, tuple] = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            first[s] = min(first.get(s, order(k)), order(k))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < order(k):
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def fingerprint(text: str | None) -> int:
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(t)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys: list, prints: list[int], near: int = 4) -> list:
    """The smallest key reachable from each row."""
    n = len(keys)
    label = list(range(n))

    def top(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= near:
                label[top(i)] = top(j)
    best: dict[int, int] = {}
    for i in range(n):
        if keys[i] is not None:
            best[top(i)] = min(best.get(top(i), keys[i]), keys[i])
    return [best.get(top(i)) for i in range(n)]


def edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def kept_lines(rows: list[tuple]) -> dict[tuple, str | None]:
    """(doc_id, text) -> the text without lines that repeat an earlier one; rows share no id unless they are equal."""
    docs = sorted({(k is not None, k or 0, t): (k, t) for k, t in rows if t is not None}.values(), key=lambda x: (x[0] is not None, x[0] or 0))
    seen: dict[str, None] = {}
    out: dict[tuple, str | None] = {}
    limit = lambda n: 0 if n < 16 else 1 if n < 32 else 2
    for k, t in docs:
        keep = []
        for line in t.split("\n"):
            if not words(line):
                keep.append(line)
                continue
            again = line in seen or any(abs(len(s) - len(line)) <= 2 and (m := limit(min(len(s), len(line)))) and edit(s, line) <= m for s in seen)
            seen.setdefault(line)
            if not again:
                keep.append(line)
        out[k, t] = "\n".join(keep)
    return out


def top_k(rows: list[tuple], k: int = 5, every: int = 50) -> list[tuple]:
    import math

    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (a, q) in enumerate(good):
        if a % every == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), b) for j, (b, v) in enumerate(good) if j != i)[:k]
            out += [(a, r, b, -s) for r, (s, b) in enumerate(best, 1)]
    return out
