"""Byte-level BPE with the tokenizers library, over Arrow batches.

A file of ranks becomes a vocabulary over the 256 characters that stand for bytes, and
every way to make a token of two others becomes a merge in the order of ranks. The
pattern splits a text; matches are encoded apart. A match never runs from a non-space
into a space, so a text is cut at single spaces into chunks that encode alone, and a
worker remembers the answers for chunks, up to a fixed number. Decoding reads each id's
bytes from the reversed table; a character whose bytes are split over ids is whole again
once they are joined.

Null text encodes as empty. Ids of no text: none. Bytes that are no UTF-8, as a part of
the ids can give, decode to the replacement character in `decoded_text`.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .chunks import TAIL, Memo, groups, windows
from .common import tune


def byte_characters() -> list[str]:
    """The character for each byte: itself where it prints, else the next free one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    table = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def build(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    chars = byte_characters()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        merges += [(name[token[:k]], name[token[k:]]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


Answer = tuple[bytes, str, bytes, int]


def split(chunk: str) -> list[str]:
    """Parts of a chunk that are matches of their own: a line feed between non-spaces, letters, and marks after letters."""
    head, line, tail = chunk.partition("\n")
    if head and line and tail and not head[-1].isspace() and not tail[0].isspace():
        return [*split(head), "\n", *split(tail)]
    head = chunk.rstrip(TAIL)
    return [head, chunk[len(head) :]] if len(head) < len(chunk) and head.removeprefix(" ").isalpha() else [chunk]


def join(parts: list[Answer]) -> Answer:
    at, offsets = 0, []
    for p in parts:
        offsets.append((np.frombuffer(p[2], "<u4") + np.uint32(at)).tobytes())
        at += p[3]
    return b"".join([p[0] for p in parts]), ",".join([p[1] for p in parts]), b"".join(offsets), at


def chunks(text: str) -> list[str]:
    """A text cut before the spaces that follow a non-space; no match reaches over such a place."""
    if "  " not in text:
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
    out = []
    held, *rest = text.split(" ")
    for piece in rest:
        if held and not held[-1].isspace():
            out.append(held)
            held = " " + piece
        else:
            held = held + " " + piece
    return [*out, held]


class ByteBpe:
    """Answers for chunks: ids as little-endian unsigned 32-bit numbers, the same in decimal, the character at which
    each starts, and the number of characters."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.tokenizer = build(ranks, pattern)
        self.memo = Memo(split, self.ask, join)
        self.bytes_of = {r: t for t, r in ranks.items()}

    def ask(self, texts: list[str]) -> list[Answer]:
        out = []
        for t, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = e.ids
            out.append((pack(f"<{len(ids)}I", *ids), ",".join(map(str, ids)), pack(f"<{len(ids)}I", *[a for a, _ in e.offsets]), len(t)))
        return out

    def batch(self, texts: list[str | None]) -> Iterator[Iterator[list[Answer]]]:
        """For each text the answers for its chunks, in one list or, where it is long, in several."""
        texts = [t or "" for t in texts]
        for own in groups(texts):
            if len(own) == 1:
                yield (self.memo.fetch(chunks(w)) for w in windows(texts[own[0]]) if w)
                continue
            cut = [chunks(texts[k]) if texts[k] else [] for k in own]
            got = self.memo.fetch([c for cs in cut for c in cs])
            at = 0
            for cs in cut:
                yield iter([got[at : at + len(cs)]] if cs else [])
                at += len(cs)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, ids array<int>, offsets array<int>): the character at which each id starts.

    An id that starts inside a character has that character's offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            ids, offsets = [], []
            for lists in bpe.batch(batch.column(1).to_pylist()):
                answers = [a for own in lists for a in own]
                whole = join(answers)
                ids.append(np.frombuffer(whole[0], "<i4"))
                offsets.append(np.frombuffer(whole[2], "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], names=[id_col, "ids", "offsets"])

    tune(docs.sparkSession)
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """encoded -> (id_col, decoded binary, decoded_text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            got = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in got], pa.string())], names=[id_col, "decoded", "decoded_text"])

    return encoded.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, decoded binary, decoded_text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for lists in bpe.batch(batch.column(1).to_pylist()):
                total, ids_digest, decoded = 0, sha(), sha()
                for own in lists:
                    ids = np.frombuffer(b"".join([a[0] for a in own]), "<u4")
                    ids_digest.update((("," if total else "") + ",".join([a[1] for a in own])).encode())
                    decoded.update(bpe.decode(ids.tolist()))
                    total += len(ids)
                n.append(total)
                ids_sha.append(ids_digest.hexdigest())
                decoded_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(docs.sparkSession)
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
