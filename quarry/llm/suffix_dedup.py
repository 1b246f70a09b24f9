"""Removal of repeated byte strings by a suffix sort.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller id. Every window of 50 bytes
has an anchor, the K-gram of least hash in it (a minimizer), and equal windows have equal anchors at equal places. So

 0. a document equal to one with a smaller id (by a hash of 128 bits) goes whole, and takes no further part;
 1. documents send the hashes of their anchors, each once a batch, to buckets by hash; hashes that two documents have go back;
 2. for those anchors alone, documents send the bytes around them (all windows that hold the anchor) to buckets;
 3. in a bucket equal surroundings are one class; where an anchor has several classes, the suffixes that start at each of
    their windows are sorted, all segments in step, by their bytes in words of eight; neighbours that agree in all 50 bytes
    repeat each other;
 4. what is covered goes back to the documents.

Documents stand in packs by hash of id and text; messages are compressed arrays, one row for a bucket or pack, so nothing is
a row per byte. An anchor or a passage that very many documents share is reduced in each batch and pack before it is sent.

Null and empty texts: nothing to remove. Null ids come before all others. Rows that share an id don't repeat each other;
equal rows are treated alike. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import batched

WINDOW, K = 50, 20
SIDE = WINDOW - K
SPAN = WINDOW + SIDE
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Anchors that a task holds before it sends them, and entries of a bucket that are sorted together.
HELD, PIECE = 1_500_000, 40_000
#: Suffixes that are sorted at once.
SORTED = 500_000
#: In place of an anchor's hash (48 bits): the document is a copy of one with a smaller id.
COPY = 2**64 - 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i under n."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, b in enumerate((BASE, INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE ** place: the hash of any stretch is a difference, shifted to place 0."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 48-bit hashes of the K-grams that are least in some window."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = prefix(data)
    h = (s[K:] - s[:-K]) * powers(len(data))[1][: len(s) - K]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(16)
    w = SIDE + 1
    low = sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    at = np.nonzero(sliding(np.concatenate([pad, low, pad]), w, np.maximum) == h)[0]
    return at, h[at]


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed message, bytes of like weight next to each other."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        b = np.ascontiguousarray(a)
        kind = b.dtype.str.encode()
        raw = b.view(np.uint8).reshape(-1, b.dtype.itemsize).T.tobytes()
        out += [struct.pack("<IQ", len(kind), len(raw)), kind, raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def expand(message: bytes) -> list[np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(message))
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", raw)[0]):
        k, n = struct.unpack_from("<IQ", raw, at)
        kind = np.dtype(bytes(raw[at + 12 : at + 12 + k]).decode())
        at += 12 + k
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n, at).reshape(kind.itemsize, -1).T).view(kind).reshape(-1))
        at += n
    return out


def gathered(messages: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [expand(m) for m in messages]
    return [np.concatenate([p[i] for p in parts]) for i in range(columns)] if parts else []


def by_key(key: np.ndarray):
    """(value, places) of each value."""
    order = np.argsort(key, kind="stable")
    cut = np.concatenate([[0], np.nonzero(np.diff(key[order]))[0] + 1, [len(key)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a:
            yield int(key[order[a]]), order[a:b]


class Suffixes:
    """Sorts suffixes of a buffer by their first WINDOW bytes within segments; hashes of stretches."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, prefix(data)
        self.back = powers(len(data) + 1)[1]

    def hash(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.back[at]

    def words(self, at: np.ndarray) -> np.ndarray:
        """The first WINDOW bytes of each suffix as big-endian words, so that words compare as the bytes do."""
        out = np.zeros((len(at), -(-WINDOW // 8) * 8), np.uint8)
        out[:, :WINDOW] = self.data[at[:, None] + np.arange(WINDOW)]
        return out.view(">u8").astype(np.uint64)

    def sort(self, at: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes `at` within their segments (0, 1, ..., ascending), by their bytes; whether each begins with the WINDOW bytes of the one before it in its segment. Whole segments are sorted together, about SORTED suffixes at a time."""
        order, same = np.arange(len(at)), np.zeros(len(at), bool)
        ends = np.cumsum(np.bincount(segment)) if len(at) else np.zeros(0, np.int64)
        done = 0
        while done < len(at):
            stop = int(ends[min(np.searchsorted(ends, done + SORTED), len(ends) - 1)])
            w, own = self.words(at[done:stop]), segment[done:stop]
            k = np.lexsort((*w.T[::-1], own))
            order[done:stop] = done + k
            w, own = w[k], own[k]
            same[done + 1 : stop] = (own[1:] == own[:-1]) & (w[1:] == w[:-1]).all(1)
            done = stop
        return order, same


def classes(key: np.ndarray, context: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the class of equal (anchor, surroundings) of each entry, ascending by anchor, and an entry of each class.

    Rows are sorted by anchor and a hash of the surroundings, and neighbours of equal hash are compared byte by byte; should
    two of them differ, the rows themselves are sorted.
    """
    n = len(key)
    rows = np.zeros((n, -(-(context.shape[1] + 2) // 8) * 8), np.uint8)
    rows[:, 0], rows[:, 1], rows[:, 2 : 2 + context.shape[1]] = low, high, context
    wide = rows.view(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(wide.shape[1]):
        x = (wide[:, j] ^ (wide[:, j] >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        h = (h ^ x ^ (x >> np.uint64(28))) * np.uint64(BASE)
    order = np.lexsort((h, key))
    k, h = key[order], h[order]
    new = np.concatenate([np.ones(min(n, 1), bool), (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    again = np.nonzero(~new)[0]
    if (wide[order[again]] != wide[order[again - 1]]).any():
        rows = np.ascontiguousarray(np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), rows], 1))
        _, one, c = np.unique(rows.view(f"V{rows.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
        return c.reshape(-1), one
    c = np.empty(n, np.int64)
    c[order] = np.cumsum(new) - 1
    return c, order[new]


def least(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of each group, for groups 0, 1, ..."""
    out = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, group, value)
    return out


def covered(key, context, low, high, doc, pos):
    """(entry, start, end) of the stretches of each entry's document that windows around its anchor cover.

    context: SPAN bytes of each entry, of which [SIDE - low, SIDE + high) belong to the document; pos: place of the anchor.
    """
    c, one = classes(key, context, low, high)
    first = least(c, doc)
    late = np.nonzero((doc > first[c]) & (low + high >= WINDOW))[0]
    found = [(late, pos[late] - low[late], pos[late] + high[late])]
    # one entry for each class; anchors with two classes or more
    k = key[one]
    many = np.nonzero(np.concatenate([[False], k[1:] == k[:-1]]) | np.concatenate([k[1:] == k[:-1], [False]]))[0]
    if len(many):
        at, kind, offset = [], [], []
        for o in range(SIDE + 1):  # the window that starts o bytes before the anchor
            ok = many[(low[one[many]] >= o) & (high[one[many]] >= WINDOW - o)]
            at.append(ok * SPAN + SIDE - o)
            kind.append(ok)
            offset.append(np.full(len(ok), o))
        at, kind, offset = (np.concatenate(x) for x in (at, kind, offset))
        # segments: same anchor and same offset
        anchor = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
        segment = anchor[kind] * (SIDE + 1) + offset
        s = Suffixes(context[one].reshape(-1))
        # a window whose hash no other in its segment has repeats nothing; the others are sorted
        h = s.hash(at, np.full(len(at), WINDOW))
        order = np.lexsort((h, segment))
        same = (segment[order][1:] == segment[order][:-1]) & (h[order][1:] == h[order][:-1])
        order = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
        order = order[np.argsort(segment[order], kind="stable")]
        at, kind, offset = at[order], kind[order], offset[order]
        segment = np.unique(segment[order], return_inverse=True)[1].reshape(-1)
        order, same = s.sort(at, segment)
        at, kind, offset = at[order], kind[order], offset[order]
        run = np.cumsum(~same) - 1
        hit = first[kind] > least(run, first[kind])[run]
        if hit.any():  # the windows of a class that an earlier document has, for the entries of its first document
            entries = np.nonzero(doc == first[c])[0]
            entries = entries[np.argsort(c[entries], kind="stable")]
            begin = np.searchsorted(c[entries], kind[hit])
            times = np.searchsorted(c[entries], kind[hit], "right") - begin
            e = entries[np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            p = pos[e] - np.repeat(offset[hit], times)
            found.append((e, p, p + WINDOW))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def joined(rid, a, b):
    """Stretches with those that touch or overlap in one document made one: windows a byte apart are one stretch."""
    order = np.lexsort((a, rid))
    rid, a, b = rid[order], a[order], b[order]
    if not len(rid):
        return rid, a, b
    # ends so far within a document; documents are told apart by a stride over all ends
    own = np.cumsum(np.concatenate([[False], rid[1:] != rid[:-1]])) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + own)
    new = np.concatenate([[True], (a + own)[1:] > reach[:-1]])
    last = np.concatenate([np.nonzero(new)[0][1:] - 1, [len(a) - 1]])
    return rid[new], a[new], (reach - own)[last]


def _texts(table: pa.Table):
    """(doc_id, rid, bytes) of each row."""
    texts = table.column("text")
    ids, rids = table.column("doc_id").to_pylist(), table.column("rid").to_pylist()
    for i in range(table.num_rows):
        yield ids[i], rids[i], np.frombuffer(texts[i].as_py().encode(), np.uint8)


MESSAGE = "part long, data binary"
_SENT = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
_BACK = pa.schema([("part", pa.int64()), ("data", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = 2 * n
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("rid", F.xxhash64("doc_id", "unnamed", "text")).withColumn("part", F.pmod("rid", F.lit(packs).cast("long")))

    def announce(batches):
        """Each different anchor of a batch once, by bucket; those that several of its documents have at once to their packs."""

        def send(hashes, rids):
            size = [len(h) for h in hashes]
            h, row, rid = np.concatenate(hashes), np.repeat(np.arange(len(size)), size), np.array(rids, np.int64)
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            head = np.concatenate([[True], h[1:] != h[:-1]])
            run = np.cumsum(head) - 1
            shared = np.bincount(run)[run] > 1
            for part, at in by_key(rid[row[shared]] % packs):
                yield part, part, squeeze(rid[row[shared]][at], h[shared][at])
            h, row = h[head], row[head]
            for bucket, at in by_key((h % np.uint64(packs)).astype(np.int64)):
                names, short = np.unique(row[at], return_inverse=True)
                yield bucket, -1, squeeze(rid[names], short.astype(np.uint32), np.diff(h[at], prepend=np.uint64(0)))

        def rows():
            hashes, rids, held = [], [], 0
            for batch in batches:
                for _, rid, data in _texts(pa.Table.from_batches([batch])):
                    h = np.unique(anchors(data)[1])
                    if len(h):
                        hashes.append(h)
                        rids.append(rid)
                        held += len(h)
                    if held >= HELD:
                        yield from send(hashes, rids)
                        hashes, rids, held = [], [], 0
            if hashes:
                yield from send(hashes, rids)

        yield from batched(rows(), _SENT, 256, 4_000_000)

    def repeated(table: pa.Table) -> pa.Table:
        """Anchors of a bucket that came more than once, back to the packs."""
        out, rids, hashes = [], [], []
        for part, message in zip(table.column("part").to_pylist(), table.column("data"), strict=True):
            if part >= 0:
                out.append((part, message.as_py()))
                continue
            names, short, delta = expand(message.as_py())
            rids.append(names[short])
            hashes.append(np.cumsum(delta, dtype=np.uint64))
        if rids:
            rid, h = np.concatenate(rids), np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            rid, h = rid[order], h[order]
            twice = np.zeros(len(h), bool)
            same = h[1:] == h[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            rid, h = rid[twice], h[twice]
            out += [(part, squeeze(rid[at], h[at])) for part, at in by_key(rid % packs)]
        return _table(out, _BACK)

    def surroundings(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes around a pack's repeated anchors; within the pack all but the first document are settled here."""
        messages = [m.as_py() for m in right.column("data")] if right.num_rows else []
        if not messages or not left.num_rows:
            return _table([], _SENT)
        part = left.column("part")[0].as_py()
        wanted = {rid: None for rid in left.column("rid").to_pylist()}
        rid, h = gathered(messages, 2)
        for r, at in by_key(rid):
            wanted[r] = np.unique(h[at])
        columns: list[list] = [[] for _ in range(7)]
        done, copies = set(), []
        for doc, r, data in _texts(left):
            if (w := wanted.get(r)) is None or r in done:
                continue
            done.add(r)
            if len(w) and w[-1] == COPY:
                copies.append((r, len(data)))
                continue
            at, h = anchors(data)
            keep = np.isin(h, w)
            at, h = at[keep], h[keep]
            low, high = np.minimum(at, SIDE), np.minimum(len(data) - at, WINDOW)
            wide = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(WINDOW, np.uint8)])
            context = wide[at[:, None] + np.arange(SPAN)]
            for c, x in zip(columns, (h, context, low, high, np.full(len(at), doc, np.int64), np.full(len(at), r, np.int64), at), strict=True):
                c.append(x)
        rows = [(part, part, squeeze(np.array([r for r, _ in copies], np.int64), np.zeros(len(copies), np.int64), np.array([m for _, m in copies], np.int64)))] if (copies := [c for c in copies if c[1] >= WINDOW]) else []
        if not columns[0]:
            return _table(rows, _SENT)
        h, context, low, high, doc, rid, at = (np.concatenate(c) for c in columns)
        c, _ = classes(h, context, low, high)
        late = doc > least(c, doc)[c]
        whole = late & (low + high >= WINDOW)
        out = rows + ([(part, part, squeeze(rid[whole], at[whole] - low[whole], at[whole] + high[whole]))] if whole.any() else [])
        first = np.nonzero(~late & (low + high >= WINDOW))[0]
        for bucket, k in by_key((h[first] % np.uint64(packs)).astype(np.int64)):
            k = first[k]
            out.append((bucket, -1, squeeze(h[k], np.ascontiguousarray(context[k]).reshape(-1), low[k].astype(np.uint8), high[k].astype(np.uint8), doc[k], rid[k], at[k])))
        return _table(out, _SENT)

    def settle(table: pa.Table) -> pa.Table:
        out, messages = [], []
        for part, message in zip(table.column("part").to_pylist(), table.column("data"), strict=True):
            out.append((part, message.as_py())) if part >= 0 else messages.append(message.as_py())
        if messages:
            h, context, low, high, doc, rid, at = gathered(messages, 7)
            context = context.reshape(-1, SPAN)
            order = np.argsort(h, kind="stable")
            ends = np.concatenate([np.nonzero(np.diff(h[order]))[0] + 1, [len(h)]])  # of anchors, which stay whole
            done, found = 0, []
            while done < len(h):
                stop = int(ends[min(np.searchsorted(ends, done + PIECE), len(ends) - 1)])
                k, done = order[done:stop], stop
                e, a, b = covered(h[k], context[k], low[k].astype(np.int64), high[k].astype(np.int64), doc[k], at[k])
                found.append(joined(rid[k][e], a, b))
            # a message for a pack, not for a pack and a piece: their number is that of buckets and packs multiplied
            gone = joined(*(np.concatenate(x) for x in zip(*found, strict=True)))
            out += [(part, squeeze(*(x[i] for x in gone))) for part, i in by_key(gone[0] % packs)]
        return _table(out, _BACK)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        messages = [m.as_py() for m in right.column("data")] if right.num_rows else []
        gone = {}
        if messages:
            rid, a, b = gathered(messages, 3)
            gone = {r: (a[k], b[k]) for r, k in by_key(rid)}
        out, unnamed = [], left.column("unnamed").to_pylist()
        for i, (doc, r, data) in enumerate(_texts(left)):
            change = np.zeros(len(data) + 1, np.int64)
            if r in gone:
                np.add.at(change, gone[r][0], 1)
                np.add.at(change, gone[r][1], -1)
            off = np.cumsum(change[:-1]) > 0
            spans = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum())
            out.append((None if unnamed[i] else doc, len(data), int(off.sum()), spans, hashlib.sha256(data[~off].tobytes()).hexdigest()))
        return _table(out, result)

    sent = "bucket long, part long, data binary"
    digest = d.select("doc_id", "rid", "part", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    again = digest.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("t1", "t2", "first")
    copies = digest.join(again, ["t1", "t2"]).where("doc_id > first").select("part", "rid")

    def flagged(batches):
        for batch in batches:
            part, rid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = [(p, squeeze(rid[k], np.full(len(k), COPY, np.uint64))) for p, k in by_key(part)] if len(part) else []
            yield from _table(rows, _BACK).to_batches()

    calls = d.select("doc_id", "rid", "text").mapInArrow(announce, sent).groupBy("bucket").applyInArrow(repeated, MESSAGE).unionByName(copies.mapInArrow(flagged, MESSAGE))
    packed = d.select("doc_id", "unnamed", "text", "rid", "part")
    around = packed.groupBy("part").cogroup(calls.groupBy("part")).applyInArrow(surroundings, sent)
    gone = around.groupBy("bucket").applyInArrow(settle, MESSAGE)
    return packed.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    return removals(docs.select("doc_id", "text"))
