"""Byte-level BPE vocabularies in the tokenizers JSON format, as plain tables. The file is read once per Python worker."""

from __future__ import annotations

import functools
import json
import re

#: Default vocabulary files, by name in the installed public_tokenizers package; every operator takes another path.
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def place(name: str) -> str:
    """Path of a public vocabulary file on this machine (resolved where it is used, so on each executor)."""
    import os

    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte value in such vocabularies: bytes that print stand for themselves, the rest follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


#: A text's chunks: a word with the one space before it, or white space as the pre-tokens have it. No pre-token crosses their ends.
#: The class is Unicode's White_Space, which the pre-tokens' \s is; Python's own \s holds four control characters more.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


class Vocabulary:
    """ids and ranks of a byte-level BPE: `of_byte`, `merge[(left, right)] = (rank, joined)`, `spelled[id]` in bytes, `special`."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back, ids = byte_alphabet(), spec["model"]["vocab"]
        raw = {token: bytes(back[c] for c in token) for token in ids}
        self.spelled = {i: raw[t] for t, i in ids.items()}
        self.of_byte = [ids[c] for c, _ in sorted(back.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.spelled |= {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.spelled) + 1
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def split(self, text: str):
        """(ordinary text, None) and (its spelling, special id) in order of the text."""
        at = 0
        for m in self.cuts.finditer(text) if self.cuts else ():
            yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        yield text[at:], None


@functools.lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(place(name))
