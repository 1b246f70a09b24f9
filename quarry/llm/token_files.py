"""Token ids in files: fixed-width bit packing in blocks.

A block holds whole documents, about BLOCK ids: the header (magic, bits an id, number of documents, how many of them, the
first ones, have no doc_id, number of ids), the doc_ids, the end of each document in ids, then all ids in `bits` bits each, where bits is the least number that holds the
vocabulary. A document's ids start at bit `bits * previous end`, so any document is read alone, and numpy unpacks any run of
ids at once. Blocks are rows of a Parquet table (file, block, start, n_ids, data): Spark's writers put it wherever the cluster
keeps its files and commit each file once, whatever executors are lost. `file` numbers ranges of ascending doc_id, `block`
counts within it, `start` is the number of ids before the block in its file.

Null and empty texts: the end id alone. Null ids: before all others. Repeated ids: a document each, next to each other, in
order of a hash of their text. No rows: an empty table.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import KEPT, KEPT_LENGTH, batched
from quarry.storage import materialize
from quarry.llm.vocab import BYTE_BPE, CHUNKS, place

BLOCK = 1 << 16
#: Characters of texts whose unknown chunks go to the library in one call.
TOGETHER = 2_000_000
HEADER = struct.Struct("<4sIQQQ")
MAGIC = b"QTB2"
END = 0
TABLE = "file int, block long, start long, n_ids long, data binary"


def bits_for(size: int) -> int:
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Big-endian bit order: id i takes bits [i * bits, (i + 1) * bits)."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack(data: bytes | memoryview, bits: int, first: int, n: int) -> np.ndarray:
    """ids [first, first + n) of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n, first * bits // 8).astype("<u4")
    low, high = first * bits, (first + n) * bits
    raw = np.unpackbits(np.frombuffer(data, np.uint8, -(-high // 8) - low // 8, low // 8))
    raw = raw[low % 8 : low % 8 + n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = raw
    return np.packbits(wide, axis=1).view(">u4").reshape(n).astype("<u4")


def write_block(doc_ids: list[int | None], parts: list[np.ndarray], bits: int) -> bytes:
    ends = np.cumsum([len(p) for p in parts]).astype("<u8")
    ids = np.concatenate(parts)
    nameless = sum(k is None for k in doc_ids)
    doc_ids = [0] * nameless + doc_ids[nameless:]
    return HEADER.pack(MAGIC, bits, len(parts), nameless, len(ids)) + np.array(doc_ids, "<i8").tobytes() + ends.tobytes() + pack(ids, bits)


def open_block(data: bytes):
    """doc_ids (None where there is none), ends, and a function from the place of a document in the block to its ids."""
    magic, bits, docs, nameless, _ = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    doc_ids = [None] * nameless + np.frombuffer(data, "<i8", docs, HEADER.size)[nameless:].tolist()
    ends = np.frombuffer(data, "<u8", docs, HEADER.size + 8 * docs).astype(np.int64)
    body = memoryview(data)[HEADER.size + 16 * docs :]

    def read(i: int) -> np.ndarray:
        first = int(ends[i - 1]) if i else 0
        return unpack(body, bits, first, int(ends[i]) - first)

    return doc_ids, ends, read


class LibraryEncoder:
    """ids of texts as the tokenizers library has them.

    The library encodes the chunks of the texts (a word with the space before it, or white space), which no pre-token crosses,
    all those that aren't in the bounded tables in one call. So a word costs the library's time once while it recurs, and no text
    is too long. A full table becomes the old one, from which words come back when they are met; the old one before it goes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(place(path))
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        if self.special is None:
            return CHUNKS.findall(text)
        # every other part is a special token's spelling, which the library cuts out first
        return [c for i, part in enumerate(self.special.split(text)) for c in ([part] if i % 2 else CHUNKS.findall(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        new = []
        for c in set().union(*cut) - self.known.keys():
            ids = self.old.get(c)
            if ids is None:
                new.append(c)
            else:
                self.known[c] = ids
        found = self.library.encode_batch_fast(new, add_special_tokens=False)
        self.known.update(zip(new, (array("I", e.ids).tobytes() for e in found), strict=True))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.uint32) for chunks in cut]
        for c in new:
            if len(c) > KEPT_LENGTH:
                del self.known[c]
        if len(self.known) > KEPT:
            self.old, self.known = self.known, {}
        return out


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One for all tasks of a worker. Tasks are the parallel units; threads within one would take others' cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)


def write(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """Encodes docs (doc_id, text) into a table of blocks in the shared folder, ascending by doc_id over files, blocks and places."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("file", F.spark_partition_id())
    out = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(batches):
        coder = library_encoder(path)
        encode, bits = coder.encode, bits_for(coder.size)

        def encoded():
            """file, doc_id and ids of each document; about TOGETHER characters are encoded at once."""
            for batch in batches:
                held, size = [], 0
                for file, key, text in zip(batch.column(2), batch.column(0), batch.column(1), strict=True):
                    held.append((file.as_py(), key.as_py(), text.as_py()))
                    size += len(held[-1][2])
                    if size >= TOGETHER:
                        yield from zip(held, encode([t for _, _, t in held]), strict=True)
                        held, size = [], 0
                yield from zip(held, encode([t for _, _, t in held]), strict=True)

        def blocks():
            file, block, start, n_ids, keys, parts = 0, 0, 0, 0, [], []
            for (file, key, _), ids in encoded():
                keys.append(key)
                parts.append(np.append(ids, np.uint32(END)))
                n_ids += len(parts[-1])
                if n_ids >= BLOCK:
                    yield file, block, start, n_ids, write_block(keys, parts, bits)
                    block, start, n_ids, keys, parts = block + 1, start + n_ids, 0, [], []
            if parts:
                yield file, block, start, n_ids, write_block(keys, parts, bits)

        yield from batched(blocks(), out, 64)

    return materialize(rows.mapInArrow(run, TABLE), "tokens", compression="zstd")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a table of blocks."""
    out = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    file, start = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    doc_ids, ends, ids_of = open_block(batch.column(2)[i].as_py())
                    for j in range(len(ends)):
                        ids = ids_of(j)
                        yield doc_ids[j], file, start + int(ends[j]) - len(ids), len(ids), zlib.crc32(ids.tobytes())

        yield from batched(rows(), out, 10_000)

    rows = blocks.select("file", "start", "data").mapInArrow(run, "doc_id long, file int, at long, n_tokens long, ids_crc32 long")
    # a row for each file
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("file")) - F.col("n"))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_table(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """Writes the ids of docs and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return read(write(docs, path))
