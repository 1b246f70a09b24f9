"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21. The perfect Golay code of length 23 has one codeword within
three bits of any word, and a word's keys here are the 12-bit numbers of all codewords within four bits of the (padded)
segment: one, or six where the nearest is three bits away. Two segments that differ in at most two bits always share a key: the
midpoint between them has a codeword within three bits.

With at most four differing bits in all, pigeonhole leaves two cases.
 - A segment is equal. The other two hold at most four errors, so one of them at most two: the key is the equal segment's
   bits and a codeword number of another.
 - None is equal. Then two segments have exactly one error each, the third at most two. Each of those two has an equal half:
   the key is a half of each of the two and a codeword number of the third.
So any linked pair shares one of the keys, 33 bits each and at most 108 a fingerprint. Only different fingerprints get keys,
copies are joined before. Rows are dealt by key; equal keys are compared in blocks, and a key sends out a spanning forest of
its links, never all pairs. Components are then found with links between fingerprints, and the smallest doc_id of each.

Null and wordless texts have fingerprint zero, linked like any other. Repeated rows and ids: a row each. Rows with a null id
have the component of their fingerprint, and join what is on both sides of it; a component without any id is null. No rows: no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import batched, texts_of
from quarry.storage import materialize
from quarry.llm.components import components

SHINGLE, SEED, NEAR = 4, 42, 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b101011100011
#: Fingerprints of one key that are compared at once.
ROWS = 2048


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


@functools.lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word; for each syndrome its error patterns of weight four or less, padded with the first; how many there are."""

    def syndrome(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    single = [syndrome(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    from itertools import combinations

    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s, e = s ^ single[b], e | 1 << b
            found[s].append(e)
    most = max(map(len, found))
    patterns = np.array([x + x[:1] * (most - len(x)) for x in found], np.uint32)
    low = np.array([functools.reduce(lambda s, b: s ^ single[b] if w >> b & 1 else s, range(12), 0) for w in range(4096)], np.uint32)
    high = np.array([functools.reduce(lambda s, b: s ^ single[12 + b] if w >> b & 1 else s, range(11), 0) for w in range(2048)], np.uint32)
    return low, high, patterns


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codewords within four bits of each word (n, 6), and which are not padding."""
    low, high, patterns = golay()
    words = words.astype(np.uint32)
    e = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return (words[:, None] ^ e) >> 11, np.concatenate([np.ones((len(words), 1), bool), e[:, 1:] != e[:, :1]], 1)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for all keys of all fingerprints."""
    x = prints.astype(np.uint64)
    segments = [(x >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    codes = [codewords(s) for s in segments]
    halves = [(s >> np.uint64(11), s & np.uint64(2047)) for s in segments]
    places, out, kind = [], [], 0

    def add(exact: np.ndarray, third: int) -> None:
        nonlocal kind
        c, real = codes[third]
        value = (np.uint64(kind) << np.uint64(40)) | (exact[:, None] << np.uint64(12)) | c.astype(np.uint64)
        at, column = np.nonzero(real)
        places.append(at)
        out.append(value[at, column])
        kind += 1

    for i in range(3):
        for j in range(3):
            if i != j:
                add(segments[i], j)
    for third in range(3):
        i, j = (k for k in range(3) if k != third)
        for a in halves[i]:
            for b in halves[j]:
                add(a << np.uint64(11) | b, third)
    return np.concatenate(places), np.concatenate(out)


def forest(prints: np.ndarray, near: int = NEAR) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints that differ in at most `near` bits, found block by block."""
    root = np.arange(len(prints))
    links = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, len(prints), ROWS):
        for b in range(a, len(prints), ROWS):
            close = np.bitwise_count(prints[a : a + ROWS, None] ^ prints[None, b : b + ROWS]) <= near
            # a first link to each column's first near row, the rest only where the roots still differ
            while True:
                root = np.fromiter(map(top, range(len(root))), np.int64, len(root))
                differ = close & (root[a : a + ROWS, None] != root[None, b : b + ROWS])
                some = differ.any(0)
                if not some.any():
                    break
                for j in np.nonzero(some)[0].tolist():
                    i = int(differ[:, j].argmax())
                    p, q = top(a + i), top(b + j)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        links.append((a + i, b + j))
    return links


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, f (the fingerprint as a signed long) for each row."""
    out = pa.schema([("doc_id", pa.int64()), ("f", pa.int64())])

    def run(batches):
        rows = ((k, (f := fingerprint(t)) - (f >> 63 << 64)) for k, t in texts_of(batches))
        yield from batched(rows, out, 10_000)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, f long")


def links(prints: DataFrame) -> DataFrame:
    """a, b: links between the representatives of different fingerprints. prints has f (distinct) and first."""
    out = pa.schema([("key", pa.int64()), ("f", pa.int64()), ("first", pa.int64())])

    def spread(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                f, first = batch.column(0)[i : i + 10_000].to_numpy(), batch.column(1)[i : i + 10_000].to_numpy()
                if len(f):
                    at, key = keys(f.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(f[at]), pa.array(first[at])], schema=out)

    def match(batches):
        edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def groups(key, f, first):
            """Links within the runs of equal keys."""
            cut = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            n = np.diff(cut)
            a, b = [], []
            two = cut[:-1][n == 2]
            near = np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= NEAR
            a.append(first[two[near]])
            b.append(first[two[near] + 1])
            for s, m in zip(cut[:-1][n > 2].tolist(), n[n > 2].tolist(), strict=True):
                pairs = np.array(forest(f[s : s + m].view(np.uint64)), np.int64).reshape(-1, 2)
                a.append(first[s + pairs[:, 0]])
                b.append(first[s + pairs[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=edge)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy() for c in range(3)))
            if held[0][0][0] == held[-1][0][-1]:
                continue  # one key so far
            key, f, first = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            yield from groups(key[:last], f[:last], first[:last])
            held = [(key[last:], f[last:], first[last:])]
        if held:
            yield from groups(*(np.concatenate(c) for c in zip(*held, strict=True)))

    keyed = prints.select("f", "first").mapInArrow(spread, "key long, f long, first long")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(match, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most NEAR bits) for each row."""
    rows = materialize(fingerprints(docs, doc_id, text), "prints")
    # a fingerprint stands for itself in links and components, whether or not its rows have an id
    prints = materialize(rows.groupBy("f").agg(F.min("doc_id").alias("least")), "firsts")
    found = components(links(prints.select("f", F.col("f").alias("first")))).select(F.col("node").alias("g"), "component")
    label = prints.join(found, F.col("f") == F.col("g"), "left").select("f", "least", F.coalesce("component", "f").alias("label"))
    smallest = label.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("component_id"))
    of_print = label.join(smallest, F.col("label") == F.col("l")).select(F.col("f").alias("g"), "component_id")
    hexed = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return rows.join(of_print, F.col("f") == F.col("g")).select("doc_id", hexed.alias("fingerprint"), "component_id")

