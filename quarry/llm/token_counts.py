"""Token counts by rank-synchronous array merging, equal to sentencepiece's for a BPE model with byte fallback.

No piece of such a model has a space sign after another character, so a text falls apart before each run of spaces, and the
chunks are merged apart; a long run of spaces falls into blocks of its own, where the model ranks all its pieces of spaces last.
New chunks of a batch of documents lie in one ragged numpy array, whatever their length. Each round
finds every row's pair of lowest rank and applies it at all its places in that row at once, left to right where they overlap,
until no row has a pair. Where a merge makes, with a neighbour, a pair of a rank not behind its own, the row's places to the
right of it wait, since that pair is next. A round costs the symbols that are left; a row has at most a round for each
different pair that it merges (far fewer for a long run of one character).
What is left is counted: a known piece is one token, another character one token per UTF-8 byte.

Null and empty texts: 0. Repeated rows: a row each. Counts of chunks are kept in a bounded table per worker.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.bpe import batched, texts_of
from quarry.llm.vocab import PIECE_BPE, place

LIMIT = 4096
#: Longer chunks aren't kept.
KEPT_LENGTH = 64
KEPT_CHUNKS = 400_000
#: New chunks that are merged together.
TOGETHER = 20_000
NONE = np.int32(2**31 - 1)
SIGN = "▁"


class Pieces:
    """Symbols are numbered; merge tables are sorted arrays of left << 32 | right with the score's rank and the joined symbol."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or not model.trainer_spec.byte_fallback:
            raise ValueError("only models without normalisation and with byte fallback")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        score = {p.piece: p.score for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED)}
        if any(SIGN in p.lstrip(SIGN) for p in score):
            raise ValueError("a piece has a space sign after another character")
        ranks = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.number = {p: i for i, p in enumerate(score)}
        self.pieces = list(score)
        self.known = len(score)
        rank = [ranks[score[p]] for p in self.pieces]
        pairs = [(self.number[p[:i]], self.number[p[i:]], rank[k], k) for k, p in enumerate(self.pieces) for i in range(1, len(p)) if p[:i] in self.number and p[i:] in self.number]
        # single characters outside the vocabulary can still be half of a pair
        self.loose: dict[str, int] = {}
        for k, p in enumerate(self.pieces):
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                for c in (a, b):
                    if len(c) == 1 and c not in self.number and c not in self.loose:
                        self.loose[c] = self.known + 4 * (len(self.loose) + 1) + len(c.encode()) - 1
                if (a in self.number or len(a) == 1) and (b in self.number or len(b) == 1) and not (a in self.number and b in self.number):
                    pairs.append((self.symbol(a), self.symbol(b), rank[k], k))
        pairs.sort()
        self.keys = np.array([a << 32 | b for a, b, _, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, _, r, _ in pairs], np.int32)
        self.joined = np.array([k for _, _, _, k in pairs], np.int32)
        # joined symbols that are half of a pair whose rank isn't behind their own
        least = np.full(self.known, NONE, np.int32)
        for half in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            some = half < self.known
            np.minimum.at(least, half[some], self.pair_rank[some])
        self.early = least <= np.array(rank, np.int32)
        # pieces of signs alone come after all others in rank, if this model has it so; then a long run falls into blocks from its
        # left, which a trial on runs up to three blocks confirms
        runs = [p for p in self.pieces if p == SIGN * len(p)]
        block = max(map(len, runs), default=1)
        last = {ranks[score[p]] for p in runs if len(p) > 1} <= {int(self.pair_rank.max())}
        n = [0, *merge_rows(self, [[self.symbol(SIGN)] * k for k in range(1, 3 * block + 1)]).tolist()]
        even = block > 1 and last and all(c == k // block + n[k % block] for k, c in enumerate(n))
        cut = f"{SIGN}{{{block}}}(?={SIGN})|" if even else ""
        self.chunk = re.compile(f"{cut}{SIGN}+[^{SIGN}]*|[^{SIGN}]+")

    def symbol(self, c: str) -> int:
        """Number of a character: its piece's, or from `known` on one that tells its UTF-8 length (its own, if it is half of a pair)."""
        k = self.number.get(c)
        return k if k is not None else self.loose.get(c, self.known + len(c.encode()) - 1)

    def costs(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.known, 1, (symbols - self.known) % 4 + 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without a pair) and joined symbol of each pair."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.joined[at]


@functools.lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(place(name))


def merge_rows(p: Pieces, rows: list[list[int]]) -> np.ndarray:
    """Number of tokens of each row (a list of symbols, none empty), all rows merged in step in one ragged array."""
    n = np.array([len(r) for r in rows])
    out = np.empty(len(rows), np.int64)
    a = np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum()))
    rank, join = np.full(len(a), NONE, np.int32), np.zeros(len(a), np.int32)
    row = np.arange(len(rows))  # rows that are left
    if len(a) > 1:
        rank[:-1], join[:-1] = p.find(a[:-1], a[1:])
    rank[np.cumsum(n) - 1] = NONE
    while True:
        start = np.cumsum(n) - n
        low = np.minimum.reduceat(rank, start)
        if (done := low == NONE).any():
            cost = np.add.reduceat(p.costs(a), start)
            out[row[done]] = cost[done]
            if done.all():
                return out
            stay = np.repeat(~done, n)
            a, rank, join = a[stay], rank[stay], join[stay]
            row, n, low = row[~done], n[~done], low[~done]
            start = np.cumsum(n) - n
        at = np.flatnonzero(rank == np.repeat(low, n))
        # places next to each other overlap: of a run, the first, the third, ... merge
        first = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        of = np.repeat(np.arange(len(n)), n)[at]
        # what a merge makes with its neighbours may come before the row's later places, which then wait
        new, k = join[at].astype(np.int64), np.flatnonzero(p.early[join[at]])
        if len(k):
            left, right = at[k] - 1, at[k] + 2
            met = (k > 0) & (at[k - 1] == left - 1)  # the symbol before comes of the merge before
            before = np.where(met, new[k - 1], a[np.maximum(left, 0)])
            begin, stop = start[of[k]], start[of[k]] + n[of[k]]
            ahead = (left >= begin) & (p.find(before, new[k])[0] <= low[of[k]])
            ahead |= (right < stop) & (p.find(new[k], a[np.minimum(right, len(a) - 1)])[0] <= low[of[k]])
            if ahead.any():
                last = np.full(len(n), len(a))
                np.minimum.at(last, of[k[ahead]], at[k[ahead]])
                ok = at <= last[of]
                at, of = at[ok], of[ok]
        a[at] = join[at]
        stay = np.ones(len(a), bool)
        stay[at + 1] = False
        n = n - np.bincount(of, minlength=len(n))
        end = np.cumsum(n) - 1
        now = at - np.arange(len(at))  # places after the gaps are closed
        a, rank, join = a[stay], rank[stay], join[stay]
        touched = np.unique(np.concatenate([now, now[now > 0] - 1]))
        right = np.minimum(touched + 1, len(a) - 1)
        rank[touched], join[touched] = p.find(a[touched], a[right])
        rank[end] = NONE


class Counter:
    def __init__(self, p: Pieces):
        self.p, self.known = p, {}

    def learn(self, chunks: list[str]) -> None:
        """Counts chunks that aren't known yet; rows of like length share an array, since the longest sets the number of rounds."""
        p, groups = self.p, {}
        number, symbol = p.number, p.symbol
        for c in chunks:
            names, rows = groups.setdefault(len(c).bit_length(), ([], []))
            names.append(c)
            rows.append([number[x] if x in number else symbol(x) for x in c])
        for names, rows in groups.values():
            self.known.update(zip(names, merge_rows(p, rows).tolist(), strict=True))

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SIGN if self.p.prefix else "") + text.replace(" ", SIGN)
        return self.p.chunk.findall(text)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.chunks(t) for t in texts]
        new = list({c for chunks in cut for c in chunks if c not in self.known})
        for i in range(0, len(new), TOGETHER):
            self.learn(new[i : i + TOGETHER])
        get = self.known.__getitem__
        out = [sum(map(get, chunks)) for chunks in cut]
        if len(self.known) > KEPT_CHUNKS:
            self.known.clear()
        else:
            for c in new:
                if len(c) > KEPT_LENGTH:
                    self.known.pop(c, None)
        return out


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One for all tasks of a worker."""
    return Counter(pieces(path))


def token_count_table(docs: DataFrame, path: str = PIECE_BPE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        counter = counter_of(path)

        def rows():
            held, size = [], 0
            for row in texts_of(batches):
                held.append(row)
                size += len(row[1])
                if size > 1_000_000:
                    yield from done(held)
                    held, size = [], 0
            yield from done(held)

        def done(held):
            for (k, t), n in zip(held, counter.count([t for _, t in held]), strict=True):
                yield k, len(t.encode()), n, n > limit

        yield from batched(rows(), out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
