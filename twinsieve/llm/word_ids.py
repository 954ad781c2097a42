"""Ids of whole texts by the tokenizers library, remembered by chunk.

The vocabulary of word_bpe_49k.json drops white space and never merges across it, so the
ids of a text are those of its chunks between white space, one after the other.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
from tokenizers import Tokenizer

from .chunks import TAIL, Memo, groups, windows

#: Text with these is given to the library whole: the separators that str.split() takes and the vocabulary's pattern does not, and letters whose lower case looks at its neighbours or ends in a mark.
_WHOLE = re.compile("[\x1c-\x1fΣİ]")
#: Fixed value: how the special tokens of the vocabulary begin.
_SPECIAL = "<|"


def split(chunk: str) -> list[str]:
    """Letters, in lower case, and the marks after them: two matches of the vocabulary's pattern."""
    head = chunk.rstrip(TAIL)
    if not head.isalpha():
        return [chunk]
    return [head.lower(), chunk[len(head) :]] if len(head) < len(chunk) else [head.lower()]


class WordIds:
    """With `plain`, special tokens in a text are text like other; without, each is one id, as by the library's default."""

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.memo = Memo(split, self.parts, b"".join)
        self.whole = lambda t: _WHOLE.search(t) or (not plain and _SPECIAL in t)

    def ask(self, texts: list[str]) -> list[bytes]:
        return [pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False))]

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without white space. Those of ASCII letters are one match each and are given as one text."""
        letters = [p for p in parts if p.isascii() and p.isalpha()]
        other = [p for p in parts if not (p.isascii() and p.isalpha())]
        got = dict(zip(other, self.ask(other), strict=True)) if other else {}
        if letters:
            whole = self.tokenizer.encode(" ".join(letters), add_special_tokens=False)
            ids = np.array(whole.ids, dtype="<u4").tobytes()
            ends = 4 * np.flatnonzero(np.diff(np.array(whole.word_ids, dtype=np.int64), append=-1)) + 4
            starts = [0, *ends[:-1].tolist()]
            got |= {p: ids[a:b] for p, a, b in zip(letters, starts, ends.tolist(), strict=True)}
        return [got[p] for p in parts]

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers; null: none."""
        texts = [t or "" for t in texts]
        for own in groups(texts):
            if len(own) == 1:
                yield self(texts[own[0]])
                continue
            chunks = [[] if self.whole(texts[k]) else texts[k].split() for k in own]
            got = self.memo.fetch([c for cs in chunks for c in cs])
            at = 0
            for k, cs in zip(own, chunks, strict=True):
                yield b"".join(got[at : at + len(cs)]) if cs else self(texts[k])
                at += len(cs)

    def __call__(self, text: str) -> bytes:
        if self.whole(text):
            return self.ask([text])[0]
        return b"".join(b"".join(self.memo.fetch(w.split())) for w in windows(text))


@functools.lru_cache(maxsize=2)
def word_ids(path: str, plain: bool = False) -> WordIds:
    """The worker's own, loaded once."""
    return WordIds(path, plain)
