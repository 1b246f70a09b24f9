"""Near copies by their texts: documents whose sets of five-word shingles have a Jaccard similarity of 4/5 or more.

SimHash fingerprints of the five-word shingles come first: those within four bits of each other are linked by their Golay keys
(quarry/llm/simhash.py), and each link is verified on the sets. Sets at a similarity near 4/5 often differ in more bits than any
affordable number of keys covers, so links that fingerprints can't see are completed exactly: in any one order of all shingles,
two sets of that similarity share one of the first n // 5 + 1 of each; those are the keys. Shingles that a sample sees often
stand last in the order, so that common passages are seldom keys; the sample is a share of the rows, so that candidates grow
with the rows and not with their square. It decides how many candidates there are, never what is linked. Each set first meets two of those that its fingerprint links it to and two of those of its keys (a head and a
neighbour by size), so that large groups of near copies are joined by few pairs; then all those of its keys that are still apart.

What leaves for verification is small first: parities of the hashes of a set, a bit or two for each element, so that they tell
large sets apart as well as small ones; they are made with the fingerprints. Two sets differ in at least as many elements as
their parities do, so pairs whose parities differ in more than (n + m) / 9 are no links. Only the sets of the others are made,
from their texts.

Texts are large and ids small, so texts are dealt out for a join by id only if a bounded filter of the ids says that they may
match: of copies, of what verification asks for, and of what goes in the end. The joins behind the filters are exact.

Equal sets are joined before. Wordless texts are equal; null ids link nothing. Repeated ids are linked as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import batched, texts_of
from quarry.llm.components import components
from quarry.llm.simhash import fingerprint, links
from quarry.storage import discard, materialize

WORDS, OFTEN = 5, 3
#: The sample that tells which shingles are common: at least so many rows, and one in so many; how many shingles it names at most.
SAMPLE, ONE_IN, NAMED = 4000, 16, 500_000
#: Parities that a set has at least.
LEAST = 64
#: Classes of hashes in a filter of ids, 64 in a row: 524,288 rows at most.
CLASSES = 1 << 25


def shingles(text: str) -> np.ndarray:
    """The different hashes of the runs of five words, ascending; a shorter text is one run, a wordless one has none."""
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64).view(np.int64))


def common_shingles(docs: DataFrame) -> np.ndarray:
    every = min(ONE_IN, max(1, docs.count() // SAMPLE))

    def run(batches):
        for batch in batches:
            for _, t in texts_of([batch]):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t))], names=["s"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id", "text").mapInArrow(run, "s long")
    often = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(NAMED)
    return np.sort(often.select("s").toArrow().column(0).to_numpy())


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, g (a digest of the set), f (the fingerprint), n (the size of the set), x (its parities) for each row."""
    out = pa.schema([("doc_id", pa.int64()), ("g", pa.binary()), ("f", pa.int64()), ("n", pa.int64()), ("x", pa.binary())])

    def run(batches):
        made = ((k, shingles(t), fingerprint(t, WORDS)) for k, t in texts_of(batches))
        yield from batched(((k, xxhash.xxh128_digest(s.tobytes()), f - (f >> 63 << 64), len(s), parity(s)) for k, s, f in made), out, 5000, 4_000_000)

    return docs.mapInArrow(run, "doc_id long, g binary, f long, n long, x binary")


def screened(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id may be in ids (left_semi), or those whose doc_id can't (left_anti). ids has doc_id. No row of docs leaves its task: a table of the classes of ids is broadcast, of bounded size whatever their number."""

    def place(k):
        h = F.pmod(F.xxhash64(k.cast("long")), F.lit(CLASSES))
        return F.call_function("shiftright", h, F.lit(6)), h.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place(ids["doc_id"])
    held = ids.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    word, bit = place(docs["doc_id"])
    return docs.join(F.broadcast(held), (word == F.col("__word")) & (F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1)) == 1), how)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids. Null ids stay."""
    rest = screened(docs, ids, "left_semi")
    return screened(docs, ids, "left_anti").union(rest.join(ids.select(F.col("doc_id").alias("__id")), rest["doc_id"] == F.col("__id"), "left_anti"))


def shared_keys(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """key, first, n: the keys of each set (first: its document; n: its size) that another set has too."""
    out = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("n", pa.int32())])

    def spread(batches):
        for batch in batches:
            for first, t in texts_of([batch]):
                s = shingles(t)
                if len(s):
                    hot = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                    key = np.concatenate([s[~hot], s[hot]])[: len(s) // 5 + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), first)), pa.array(np.full(len(key), len(s), np.int32))], schema=out)

    keyed = texts.mapInArrow(spread, "key long, first long, n int")
    same = Window.partitionBy("key")
    keyed = keyed.select("*", F.min("first").over(same).alias("low"), F.max("first").over(same).alias("high"))
    return keyed.where("low <> high").select("key", "first", "n").distinct()


def parity(s: np.ndarray) -> bytes:
    """A bit for each class of hashes that agree in their low bits: whether their number is odd. There are at least as many classes as hashes."""
    size = max(LEAST, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (size - 1), minlength=size) & 1 == 1).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Parities that differ; the longer row is folded to the length of the shorter, as its sums are those of fewer classes."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, size)) for v in (x, y))
    return int.from_bytes((x ^ y).tobytes(), "little").bit_count()


def sets(texts: DataFrame) -> DataFrame:
    """doc_id, n, x (the set, as bytes)."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("x", pa.binary())])

    def run(batches):
        rows = ((k, len(s), s.tobytes()) for k, s in ((k, shingles(t)) for k, t in texts_of(batches)))
        yield from batched(rows, out, 1000, 4_000_000)

    return texts.mapInArrow(run, "doc_id long, n long, x binary")


def checked(pairs: DataFrame, held: DataFrame, near) -> DataFrame:
    """The pairs (a, b) for which near(n of a, n of b, x of a, x of b) holds. held has doc_id, n and x of all that stand in pairs."""
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for c in "ab":
        pairs = pairs.join(held.select(F.col("doc_id").alias(c), F.col("n").alias("n" + c), F.col("x").alias("x" + c)), c)

    def run(batches):
        rows = ((a.as_py(), b.as_py()) for batch in batches for a, b, *x in zip(*batch.columns, strict=True) if near(*(v.as_py() for v in x)))
        yield from batched(rows, edge, 10_000)

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def may_be_near(na: int, nb: int, x: bytes, y: bytes) -> bool:
    return 9 * differing(x, y) <= na + nb


def near(na: int, nb: int, x: bytes, y: bytes) -> bool:
    shared = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
    return 9 * shared >= 4 * (na + nb)


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def verified(pairs: DataFrame, held: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, as a table. held has the parities of all that stand in pairs; what they leave fetches its sets."""
    close = materialize(checked(pairs.where("a <> b").distinct(), held, may_be_near), "close")
    ids = ids_of(close)
    whole = materialize(sets(screened(docs, ids, "left_semi").join(ids, "doc_id", "left_semi")), "sets")
    found = materialize(checked(close, whole, near), "near")
    discard(close, whole)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over links) for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = common_shingles(docs)
    rows = materialize(digests(docs), "digests")
    firsts = materialize(rows.groupBy("g").agg(F.min("doc_id").alias("first"), F.first("f").alias("f")).where("first IS NOT NULL"), "firsts")
    copies = materialize(rows.select("doc_id").where("doc_id IS NOT NULL").distinct().join(firsts.select(F.col("first").alias("doc_id")), "doc_id", "left_anti"), "copies")
    keys = materialize(shared_keys(without(docs.where("doc_id IS NOT NULL"), copies), common), "keys")
    discard(copies)
    seen = links(firsts.groupBy("f").agg(F.min("first").alias("first"))).groupBy("b").agg(F.min("a").alias("x"), F.max("a").alias("y"))
    seen = materialize(seen.select(F.explode(F.array("x", "y")).alias("a"), "b").distinct(), "seen")
    held = rows.select("doc_id", "n", "x")
    # a set meets two others at most in this step, whatever the number of its keys: what is still apart then is met in full below
    order = Window.partitionBy("key").orderBy("n", "first")
    fits = lambda x: F.when(4 * F.col("n") <= 5 * x["n"], x["first"])
    by = keys.select("first", "n", F.first(F.struct("first", "n")).over(order).alias("head"), F.lag(F.struct("first", "n")).over(order).alias("next"))
    by = by.groupBy("first").agg(F.min(fits(F.col("head"))).alias("x"), F.max(fits(F.col("next"))).alias("y"))
    met = by.select("first", F.explode(F.array("x", "y")).alias("z")).where("z <> first").select(F.least("first", "z").alias("a"), F.greatest("first", "z").alias("b"))
    joined = verified(seen.unionByName(met), held, docs)
    found = components(joined).select(F.col("node").alias("first"), "component")
    apart = keys.join(found, "first", "left").select("key", "first", "n", F.coalesce("component", "first").alias("label"))
    same = Window.partitionBy("key")
    apart = apart.select("*", F.min("label").over(same).alias("low"), F.max("label").over(same).alias("high")).where("low <> high")
    x, y = (apart.select("key", F.col("first").alias(c), F.col("n").alias("n" + c), F.col("label").alias("l" + c)) for c in "ab")
    more = x.join(y, "key").where("a < b AND la <> lb AND 4 * na <= 5 * nb AND 4 * nb <= 5 * na").select("a", "b")
    more = verified(more, held, docs)
    found = materialize(components(joined.unionByName(more)).select(F.col("node").alias("first"), "component"), "found")
    discard(keys, seen, joined, more)
    of_set = firsts.join(found, "first", "left").select(F.col("g").alias("h"), F.coalesce("component", "first").alias("component_id"))
    return rows.select("doc_id", "g").join(of_set, F.col("g") == F.col("h"), "left").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: the one with the smallest id (rows that repeat an id stay together). Null ids stay."""
    found = near_duplicates(docs)
    gone = materialize(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    discard(found)
    return without(docs, gone)
