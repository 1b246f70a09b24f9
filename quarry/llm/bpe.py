"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

The leaves of the tree are the ranks of the pairs that start at each symbol; every inner node holds the smaller of its two
children, leaves on equal ranks the left one, so the root is the leftmost pair of lowest rank. A merge changes at most three
leaves, each updated up to the root in logarithmic time, until the root holds no pair. Words repeat, so the ids of a text's
chunks (a word with the space before it, which holds one pre-token or a few) are kept in a bounded table per worker.

Null and empty texts: no ids, and the digest of nothing. Repeated rows and ids: a row each. Very long texts and very long
words: n log n. A special token's spelling within a text becomes its id, as the tokenizers library has it by default.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.vocab import BYTE_BPE, CHUNKS, Vocabulary, vocabulary

#: Words, and chunks, that a worker keeps, about 200 bytes each.
KEPT = 400_000
#: Longer ones aren't kept.
KEPT_LENGTH = 64
NONE = 1 << 40


def keep(known: dict, key: str, value):
    """Puts the value into a table of bounded size."""
    if len(key) <= KEPT_LENGTH:
        if len(known) >= KEPT:
            known.clear()
        known[key] = value
    return value


def merge_word(symbols: list[int], merge: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges, in the order rank, then place."""
    n = len(symbols)
    if n < 2:
        return symbols
    get, base = merge.get, 1 << (n - 1).bit_length()
    # a node is rank << 24 | place while places fit, so that min() picks the leftmost of equal ranks
    shift = max(24, n.bit_length())
    none = NONE << shift
    tree = [none] * (2 * base)
    for i in range(n - 1):
        if (m := get((symbols[i], symbols[i + 1]))) is not None:
            tree[base + i] = m[0] << shift | i
    for i in range(base - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    if tree[1] == none:
        return symbols
    after, before, mask = [*range(1, n + 1)], [*range(-1, n - 1)], (1 << shift) - 1
    while (top := tree[1]) != none:
        i = top & mask
        j = after[i]
        symbols[i], symbols[j] = get((symbols[i], symbols[j]))[1], -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        h = before[i]
        for leaf in (h, i, j):
            if leaf < 0:
                continue
            value = none
            if leaf != j and after[leaf] < n and (m := get((symbols[leaf], symbols[after[leaf]]))) is not None:
                value = m[0] << shift | leaf
            p = base + leaf
            if tree[p] == value:
                continue
            tree[p] = value
            while p > 1:
                p >>= 1
                a, b = tree[2 * p], tree[2 * p + 1]
                low = a if a <= b else b
                if tree[p] == low:
                    break
                tree[p] = low
    return [s for s in symbols if s >= 0]


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.words, self.chunks = vocab, {}, {}

    def word(self, word: str) -> list[int]:
        """ids of one pre-token."""
        ids = self.words.get(word)
        if ids is None:
            of = self.vocab.of_byte
            ids = keep(self.words, word, merge_word([of[b] for b in word.encode()], self.vocab.merge))
        return ids

    def chunk(self, chunk: str) -> bytes:
        """ids of a chunk's pre-tokens, as little-endian unsigned 32-bit integers."""
        return keep(self.chunks, chunk, array("I", [i for w in self.vocab.pieces.findall(chunk) for i in self.word(w)]).tobytes())

    def encode(self, text: str) -> bytes:
        out, known, chunk = [], self.chunks.get, self.chunk
        for part, special in self.vocab.split(text):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
            elif part:
                out += [known(c) or chunk(c) for c in CHUNKS.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Bytes that aren't UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.vocab.spelled.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, which so learn a word once."""
    return Encoder(vocabulary(path))


def texts_of(batches: Iterable[pa.RecordBatch], id_at: int = 0, text_at: int = 1) -> Iterator[tuple[object, str]]:
    """(id, text) of each row, one text at a time; null texts are empty."""
    for batch in batches:
        ids, texts = batch.column(id_at), batch.column(text_at)
        for i in range(batch.num_rows):
            yield ids[i].as_py(), texts[i].as_py() or ""


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000, width: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `size` rows, fewer if their strings and bytes pass `width`."""
    held, wide = [], 0
    for row in rows:
        held.append(row)
        wide += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= size or wide >= width:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, wide = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def encode(docs: DataFrame, path: str = BYTE_BPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers), decoded (string) for each row."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        coder = encoder(path)
        rows = ((k, len(ids) // 4, ids, coder.decode(ids)) for k, ids in ((k, coder.encode(t)) for k, t in texts_of(batches)))
        yield from batched(rows, out)

    return docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip_table(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        coder = encoder(path)

        def rows():
            for k, text in texts_of(batches):
                ids = coder.encode(text)
                yield k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()

        yield from batched(rows(), out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
