import hashlib
import random
import zlib
from struct import pack as bits

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from twinsieve.llm import byte_bpe, packing, token_files
from twinsieve.llm.common import Scratch
from twinsieve.llm.word_ids import WordIds

WORD = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "a", "Don't  stop!!\n\n  it's  ", "x\x1cy z", "ΑΣ ΟΔΟΣ. Σ", "é Å İI", "  lead", "tail  ", "a\n b \n c\t d", "a\r\n\r\nb", "<|endoftext|> x <|startoftext|>", "a<|endoftext|>b", "fİ; İ", "<| x",
    "　wide space x", "naïve café — “quoted” … 12,345.67", "日本語 テキスト 한국어 שלום", "😀😃 👩‍👩‍👧‍👦", "foo.\nBar\nBaz", "\x00\x01", "a" * 5000, "1 22 333 4444", "we're they'LL I'd", "\n\n\na\n", " \n x", "a   b    c", "x \n\n y",
]


def texts(seed=1, n=150):
    rng = random.Random(seed)
    parts = ["the", "The", "of,", "über", "ß", "çà", "1", "23", "!!", "'s", "\n", "\n\n", "  ", "\t", "ñandú.", "don't", "—", "ab" * 9, "Σ", " "]
    return ODD + ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(n)]


LIBRARY = Tokenizer.from_file(WORD)


def direct(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library():
    own = WordIds(WORD)
    for text in texts():
        want = direct(text)
        assert own(text or "") == bits(f"<{len(want)}I", *want), text


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts())], "doc_id long, text string, offset long")


def test_byte_bpe_round_trip(docs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts()):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_byte_bpe_offsets(docs):
    coded = byte_bpe.encode(docs, RANKS, P.PATTERN)
    back = {r.doc_id: r.decoded_text for r in byte_bpe.decode(coded, RANKS, P.PATTERN).collect()}
    table = {r: t for t, r in byte_bpe.read_ranks(RANKS).items()}
    for r in coded.collect():
        text = texts()[r.doc_id] or ""
        assert back[r.doc_id] == text
        starts = np.cumsum([0] + [len(c.encode()) for c in text])
        at = 0
        for k, o in zip(r.ids, r.offsets, strict=True):
            assert starts[o] <= at < starts[o + 1]
            at += len(table[k])


def test_packing(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900 + k, "b c d") for k in range(60)] + [(7, None), (7, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for capacity, chunk in ((64, 10), (4096, 250_000)):
        got = packing.pack(table, WORD, capacity=capacity, chunk=chunk).collect()
        want = []
        for i, t in rows:
            ids = [*direct(t), 1]
            want += [(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(bits(f"<{len(ids[k : k + capacity])}I", *ids[k : k + capacity]))) for k in range(0, len(ids), capacity)]
        assert sorted(tuple(r)[:5] for r in got) == sorted(want)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in by.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(by) <= 1.02 * sum(w[3] for w in want) / capacity + 1


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.choice([10, 37, 128])
        counts = {k: rng.randrange(1, 9) for k in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity))}
        room = []
        for length in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
            fit = [(r, k) for k, r in enumerate(room) if r >= length]
            if fit:
                room[min(fit)[1]] -= length
            else:
                room.append(capacity - length)
        runs = packing.plan(counts, capacity)
        used = {first + k for _, _, n, each, first, _ in runs for k in range(-(-n // each))}
        assert used == set(range(len(room)))


def test_token_counts(spark, docs):
    """A separator that stands in a text is text: its ids are those without special tokens."""
    plain = Tokenizer.from_file(WORD)
    plain.encode_special_tokens = True
    want = [(i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts())]
    for block, group in ((8, 3), (1 << 16, 1 << 12)):
        got = token_files.document_token_counts(docs.repartition(3), WORD, 49407, block=block, group=group).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == want


def test_raw_token_files(spark, tmp_path):
    rng = random.Random(2)
    want = set()
    for f in range(3):
        ids = [rng.choice([5, 6, 9]) for _ in range(200)] + ([9] if f else [4])
        np.array(ids, dtype="<u4").tofile(tmp_path / f"{f}.bin")
        start, nth = 0, 0
        for k, x in enumerate(ids):
            if x == 9:
                want.add((f"{f}.bin", nth, start, k - start, True))
                start, nth = k + 1, nth + 1
        if start < len(ids):
            want.add((f"{f}.bin", nth, start, len(ids) - start, False))
    blocks = token_files.read_token_files(spark, str(tmp_path), 4, 7)
    got = token_files.count_tokens(blocks, Scratch(spark), 9, 4, 4).collect()
    assert {(r.file.rpartition("/")[2], r.nth, r.start, r.n_tokens, r.terminated) for r in got} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, WORD).collect() == []
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).collect() == []
    assert token_files.document_token_counts(none, WORD, 49407).collect() == []
