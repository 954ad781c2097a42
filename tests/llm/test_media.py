import hashlib
import random
import zlib

import numpy as np
import pytest

from twinsieve.llm import jpeg, media


def slow_encode(blocks_of, components, quant, width, height, restart, dc_codes, ac_codes):
    """A plain writer, symbol by symbol: blocks_of(mcu) gives (component, 64 coefficients) in order."""
    dc, ac = jpeg.canonical(dc_codes), jpeg.canonical(ac_codes)
    scan, acc = bytearray(), ""

    def flush():
        nonlocal acc
        acc += "1" * (-len(acc) % 8)
        for k in range(0, len(acc), 8):
            b = int(acc[k : k + 8], 2)
            scan.append(b)
            if b == 255:
                scan.append(0)
        acc = ""

    def put(code, value, size):
        nonlocal acc
        acc += f"{code[1]:0{code[0]}b}"
        if size:
            acc += f"{value if value > 0 else value + (1 << size) - 1:0{size}b}"

    hm, vm = max(c[1] for c in components), max(c[2] for c in components)
    if len(components) == 1:
        hm = vm = 1
    mcus = -(-width // (8 * hm)) * -(-height // (8 * vm))
    pred = {}
    for m in range(mcus):
        if restart and m and m % restart == 0:
            flush()
            scan.extend(bytes([255, 0xD0 + (m // restart - 1) % 8]))
            pred = {}
        for c, coefs in blocks_of(m):
            d = coefs[0] - pred.get(c, 0)
            pred[c] = coefs[0]
            put(dc[abs(d).bit_length()], d, abs(d).bit_length())
            run, last = 0, max([k for k in range(64) if coefs[k]], default=0)
            for k in range(1, last + 1):
                if coefs[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    put(ac[0xF0], 0, 0)
                    run -= 16
                size = abs(coefs[k]).bit_length()
                put(ac[run << 4 | size], coefs[k], size)
                run = 0
            if last < 63:
                put(ac[0], 0, 0)
    flush()
    head = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0") + jpeg.segment(0xDB, bytes([0]) + bytes(quant))
    head += jpeg.segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(components)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in components))
    head += jpeg.table_segment(0, dc_codes) + jpeg.table_segment(1, ac_codes)
    if restart:
        head += jpeg.segment(0xDD, restart.to_bytes(2, "big"))
    return head + jpeg.segment(0xDA, bytes([len(components)]) + b"".join(bytes([i, 0]) for i, _, _ in components) + bytes([0, 63, 0])) + bytes(scan) + b"\xff\xd9"


PAYLOADS = [b"", b"a", bytes(range(256)) * 3, b"\xff" * 1000, b"\0" * 64, b"x" * 64, b"y" * 65, "é 日本".encode() * 50, random.Random(1).randbytes(5000)]


def test_round_trip_of_bytes():
    files = jpeg.encode(PAYLOADS)
    images = [jpeg.parse(f) for f in files]
    for p, f, image, coefs in zip(PAYLOADS, files, images, jpeg.coefficients(images, files), strict=True):
        n, stored = jpeg.payload(image, coefs)
        assert n == len(p) and stored == p + bytes(max(64, -(-len(p) // 64) * 64) - len(p))
        assert f == jpeg.encode([p])[0]


@pytest.mark.parametrize("components", [[(1, 1, 1)], [(1, 2, 2), (2, 1, 1), (3, 1, 1)], [(1, 1, 1), (2, 1, 1), (3, 1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_general_scans(components, restart):
    rng = random.Random(restart)
    width, height = 45, 37
    quant = [rng.randint(1, 20) for _ in range(64)]
    ac_codes = [(4, list(range(1, 9))), (10, [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11) if r or s > 8])]
    made = []

    def blocks(m):
        own = []
        for c, (_, h, v) in enumerate(components):
            for _ in range(1 if len(components) == 1 else h * v):
                coefs = [rng.randint(-200, 200)] + [rng.choice([0] * rng.choice([1, 30]) + [rng.randint(-900, 900)]) for _ in range(63)]
                own.append((c, coefs))
        made.extend(own)
        return own

    f = slow_encode(blocks, components, quant, width, height, restart, jpeg.DC_CODES, ac_codes)
    image = jpeg.parse(f)
    coefs = jpeg.coefficients([image], [f])[0]
    assert coefs.tolist() == [c for _, c in made]
    grey = jpeg.thumbnail(image, coefs)
    assert (image.width, image.height) == (width, height)
    assert grey.shape == (5, 6)
    first = made[0][1][0] * quant[0]
    assert grey[0, 0] == min(255, max(0, (first + 4) // 8 + 128))


def test_columns(spark):
    texts = [None, "", "abc", "é" * 70, "x" * 4000, "abc"]
    docs = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    stored = media.store(docs)
    got = {r.doc_id: r for r in media.read_back(stored).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        f = jpeg.encode([data])[0]
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(f), hashlib.sha256(f).hexdigest())
    assert got[2][1:] == got[5][1:] and got[0][1:] == got[1][1:]


def test_broken_media(spark):
    good = jpeg.encode([b"hello" * 100])[0]
    rows = [(0, good), (1, None), (2, b""), (3, b"\xff\xd8\xff"), (4, good[:-300]), (5, b"GIF89a"), (6, good.replace(b"\xff\xc0", b"\xff\xc2", 1)), (7, good)]
    got = {r.id: r for r in media.describe(spark.createDataFrame(rows, "id long, m binary"), "id", "m").collect()}
    assert got[0].error is None and got[0].width == got[7].width == 24 and got[0].thumb_hash == got[7].thumb_hash
    assert np.frombuffer(got[0].thumbnail, np.uint8).size == got[0].thumb_width * got[0].thumb_height
    assert got[1].error is None and got[1].width is None
    assert all(got[k].error and got[k].width is None for k in (2, 3, 4, 5, 6))
