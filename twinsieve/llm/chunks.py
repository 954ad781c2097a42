"""Answers of the tokenizers library for chunks of text, remembered by a worker.

Chunks are short strings that encode alone; a chunk may be made of parts that do, too.
What a group of texts lacks is asked for in one batch. Two generations of answers are
kept: a full one becomes the old one, and what is met again moves on to the new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Answers in a generation, of chunks and of parts each.
MEMO = 500_000
#: Longer chunks are not remembered.
LONGEST = 64
#: Characters of text taken together.
WINDOW = 1 << 20
#: Fixed value: marks that follow a word and are no part of it in either vocabulary's pattern.
TAIL = ".,;:!?"


class Generations:
    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}

    def lacking(self, keys: set[str]) -> list[str]:
        out = []
        for k in keys:
            if k not in self.young:
                got = self.old.get(k)
                if got is None:
                    out.append(k)
                else:
                    self.young[k] = got
        return out


class Memo:
    """split(chunk) -> parts; ask(parts) -> their answers; join(answers of parts) -> the chunk's."""

    def __init__(self, split: Callable[[str], list[str]], ask: Callable[[list[str]], list], join: Callable[[list], object]):
        self.split, self.ask, self.join = split, ask, join
        self.chunks, self.parts = Generations(), Generations()

    def fetch(self, chunks: list[str]) -> list:
        self.chunks.turn()
        self.parts.turn()
        known = self.chunks.young
        lacking = {c: self.split(c) for c in self.chunks.lacking(set(chunks))}
        new = self.parts.lacking({p for parts in lacking.values() for p in parts})
        part = self.parts.young
        part.update(zip(new, self.ask(new), strict=True) if new else ())
        for c, parts in lacking.items():
            known[c] = part[parts[0]] if len(parts) == 1 else self.join([part[p] for p in parts])
        out = list(map(known.__getitem__, chunks))
        for store in (known, part):
            for k in [k for k in (lacking if store is known else new) if len(k) > LONGEST]:
                store.pop(k, None)
        return out


def windows(text: str) -> Iterator[str]:
    """A text in pieces of about WINDOW characters, each but the first starting at a space after a non-space."""
    at, n = 0, len(text)
    while n - at > WINDOW:
        cut = at + WINDOW
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or not text[cut - 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def groups(texts: list[str]) -> Iterator[list[int]]:
    """Indices of texts that are taken together: up to about WINDOW characters, or one longer text."""
    own, size = [], 0
    for k, t in enumerate(texts):
        if own and size + len(t) > WINDOW:
            yield own
            own, size = [], 0
        own.append(k)
        size += len(t)
    if own:
        yield own
