"""Secret scan: fixed patterns, and a battery of randomness tests over whatever else looks like an encoded key.

Candidates are unbroken runs of 20 or more letters, digits and the signs of base 64. Their encoding (hexadecimal, letters,
base 32, base 36, base 52, base 62, base 64) is inferred from the characters; a run that no encoding fits, as of a key in a URL
path, is cut at its slashes or at its dashes and underscores, whichever gives the piece that looks least like running text. To report a run is to claim
that it is random, so the battery tests for equivalence: each test's null is structure, and rejects it only if the run is
shown to be closer to random than a margin.

 - Chi-squared uniformity over the symbols of the alphabet. The statistic is a function of the number of equal pairs among the
   symbols; in words and names a pair is equal, but for case, with a chance of at least COLLIDE, and the p-value is that of so
   few pairs. Runs that are far less even than chance, or far more (as an alphabet, each symbol once), aren't
   random either, nor are those with far too many or few capitals, small letters or digits for their alphabet.
 - Runs of symbols in the upper and lower half of the alphabet: structure changes sides with a chance under CHANGE, or over its
   complement.
 - Serial correlation at lag one: structure has one over SERIAL in size.

A run's p-value is the largest of the three, since all have to reject; the Benjamini-Hochberg procedure over the candidates of
the document then keeps the share of structured runs among the reported ones under FDR. The nulls depend on the length: a
short run has to be far closer to the ideal than a long one, and below some length none can pass.

Null and empty texts: no spans. Repeated rows: a row each. Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.bpe import batched, texts_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
FDR, EVEN, CLASS, DIGITS = 0.05, 1e-4, 5e-4, 5.5e-3
#: Margins of structure: the chance of equal pairs (in hexadecimal, whose own is 1/16, HEX_COLLIDE), of a change of sides, and a correlation.
COLLIDE, HEX_COLLIDE, CHANGE, SERIAL = 0.066, 0.12, 0.1, 0.8
#: About how often a letter stands in running text, which tells where to cut a run.
LOWER = dict(zip("etaoinsrhldcumfpgwybvkxjqz", (0.12, 0.09, 0.08, 0.075, 0.07, 0.067, 0.063, 0.06, 0.055, 0.04, 0.04, 0.03, 0.028, 0.025, 0.023, 0.02, 0.02, 0.02, 0.02, 0.015, 0.01, 0.008, 0.0015, 0.0015, 0.001, 0.0007), strict=True))
TEXT = {c: math.log(0.8 * p) for c, p in LOWER.items()} | {c.upper(): math.log(0.08 * p) for c, p in LOWER.items()}
TEXT |= {c: math.log(0.007) for c in "0123456789"} | {c: math.log(0.05 / 4) for c in "+/-_"}
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE32, BASE36 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: The first that fits is taken: an alphabet stands before those that hold it.
ALPHABETS = (
    (re.compile(r"[0-9]+"), "", False),  # a number is no key
    (re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef", True),
    (re.compile(r"[A-Z]+"), BASE36[:26], False),
    (re.compile(r"[a-z]+"), BASE36[:26].lower(), False),
    (re.compile(r"[A-Z2-7]+"), BASE32, False),
    (re.compile(r"[a-z2-7]+"), BASE32.lower(), False),
    (re.compile(r"[A-Z0-9]+"), BASE36, False),
    (re.compile(r"[a-z0-9]+"), BASE36.lower(), False),
    (re.compile(r"[A-Za-z]+"), B64[:52], False),
    (re.compile(r"[A-Za-z0-9]+"), B64, False),
    (re.compile(r"[A-Za-z0-9+/]+"), B64 + "+/", False),
    (re.compile(r"[A-Za-z0-9_-]+"), B64 + "-_", False),
)
SHORTEST, PARTS = 20, (re.compile(r"[^/]+"), re.compile(r"[^_-]+"))


def below(z: float) -> float:
    """P(a standard normal < z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def poisson_at_most(k: int, mean: float) -> float:
    if mean > 200:
        return below((k + 0.5 - mean) / math.sqrt(mean))
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return min(1.0, total)


def binomial_at_least(k: int, n: int, p: float) -> float:
    if n > 200:
        return below((n * p - k + 0.5) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1)))


def equal_pairs(symbols) -> int:
    return sum(c * (c - 1) // 2 for c in Counter(symbols).values())


def uneven_classes(values: list[int], alphabet: str) -> bool:
    """Whether capitals, small letters or digits are far more or fewer than their share of the alphabet, as in a name with one digit."""
    n = len(values)
    for of, least in ((str.isupper, CLASS), (str.islower, CLASS), (str.isdigit, DIGITS)):
        places = {i for i, c in enumerate(alphabet) if of(c)}
        k, share = sum(v in places for v in values), len(places) / len(alphabet)
        if 0 < share < 1 and min(binomial_at_least(k, n, share), binomial_at_least(n - k, n, 1 - share)) < least:
            return True
    return False


def battery(token: str, values: list[int], alphabet: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation against structure, for a token whose symbols stand at these places of the alphabet."""
    n, size = len(values), len(alphabet)
    pairs, possible = equal_pairs(token.lower()), n * (n - 1) // 2
    uniform = poisson_at_most(pairs, possible * (HEX_COLLIDE if size <= 16 else COLLIDE))
    own, chance = equal_pairs(values), possible / size
    if min(poisson_at_most(own, chance), 1 - poisson_at_most(own - 1, chance) if own else 1.0) < EVEN or uneven_classes(values, alphabet):
        uniform = 1.0
    high = [2 * v >= size for v in values]
    changes = sum(a != b for a, b in pairwise(high))
    runs = max(binomial_at_least(changes, n - 1, CHANGE), binomial_at_least(n - 1 - changes, n - 1, CHANGE))
    m = sum(values) / n
    spread = sum((v - m) ** 2 for v in values)
    r = sum((a - m) * (b - m) for a, b in pairwise(values)) / spread if spread else 1.0
    z = math.atanh(max(-0.999999, min(0.999999, r + 1 / n)))
    serial = below((abs(z) - math.atanh(SERIAL)) * math.sqrt(n - 3))
    return uniform, runs, serial


def evidence(token: str) -> tuple[float, float] | None:
    """(the largest of the battery's p-values under the inferred encoding, log of how much likelier the token is there than in running text); None if the characters fit none."""
    token = token.rstrip("=")
    for fits, alphabet, fold in ALPHABETS:
        if fits.fullmatch(token):
            if not alphabet:
                return 1.0, 0.0
            place = {c: i for i, c in enumerate(alphabet)}
            values = [place[c] for c in (token.lower() if fold else token)]
            return max(battery(token, values, alphabet)), sum(-math.log(len(alphabet)) - TEXT[c] for c in token)
    return None


def candidates(token: str, at: int) -> list[tuple[float, float, int, int]]:
    """(p-value, likelihood, start, end) of the run, or of its pieces where no encoding fits the whole: the likelihoods choose where to cut, never what is reported."""
    if (x := evidence(token)) is not None:
        return [(*x, at, at + len(token))]
    best: list[tuple[float, float, int, int]] = []
    for part in PARTS:
        pieces = [m for m in part.finditer(token) if len(m[0].rstrip("=")) >= SHORTEST and m[0] != token]
        found = [x for m in pieces for x in candidates(m[0], at + m.start())]
        if found and (not best or max(x[1] for x in found) > max(x[1] for x in best)):
            best = found
    return best


def random_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of candidates outside `taken` that the false-discovery procedure selects by their p-values."""
    found = []
    for m in RUN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            found += candidates(m[0], m.start())
    found.sort()
    passed = max((k for k, x in enumerate(found, 1) if x[0] <= FDR * k / len(found)), default=0)
    return [(a, b) for _, _, a, b in found[:passed]]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of all spans, in that order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(a, 3, b) for a, b in random_spans(text, [(a, b) for a, _, b in spans])]
    return sorted(spans)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row."""
    out = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])

    def run(batches):
        def rows():
            for key, text in texts_of(batches):
                spans = scan(text)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                base = spelled([s for s in spans if s[1] < 3])
                yield key, *n[:3], hashlib.sha256(base.encode()).hexdigest(), spelled(spans), n[3]

        yield from batched(rows(), out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def mask(text: str, sign: str = "*") -> str:
    """The text with every span overwritten, its length kept."""
    out = list(text)
    for a, _, b in scan(text):
        out[a:b] = sign * (b - a)
    return "".join(out)
