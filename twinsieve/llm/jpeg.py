"""Baseline JPEG in numpy: markers, Huffman scans and DC-only luminance thumbnails.

Scans are decoded many at a time. Every restart interval of every image of a batch is a
segment that can be read alone; all segments step together, one Huffman symbol each, by
tables over the next 16 bits. Samples are never reconstructed: the mean of a block is its
DC coefficient, which gives a thumbnail of one pixel a block.

The writer stores bytes without loss as coefficients, the format's unit: a byte is one
coefficient that is never 0 (below 128: byte - 128, else byte - 127), 64 bytes a block in
zigzag order, one grey component, quantisers of 1, a restart after every block. The
number of bytes stands in a comment segment.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from math import isqrt

import numpy as np

#: Codes of the writer's tables, (bits, symbols): magnitudes of values without zeros before them get 4 bits, all others 9.
DC_CODES = [(4, list(range(12)))]
AC_CODES = [(4, list(range(1, 9))), (9, [0, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11) if run or size > 8])]
BLOCK = 64


def canonical(codes: list[tuple[int, list[int]]]) -> dict[int, tuple[int, int]]:
    """Symbol -> (bits, code) of the canonical Huffman code."""
    out, code, at = {}, 0, 0
    for bits, symbols in sorted(codes):
        code <<= bits - at
        at = bits
        for s in symbols:
            out[s] = (bits, code)
            code += 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def table_segment(kind: int, codes: list[tuple[int, list[int]]]) -> bytes:
    count = dict.fromkeys(range(1, 17), 0) | {b: len(s) for b, s in codes}
    return segment(0xC4, bytes([kind << 4, *count.values()]) + b"".join(bytes(s) for _, s in sorted(codes)))


_TABLES = segment(0xDB, bytes([0]) + bytes([1] * 64)), table_segment(0, DC_CODES) + table_segment(1, AC_CODES)


def _codes_of_bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a byte as DC or AC coefficient: code with its magnitude bits, and their number."""
    dc, ac = canonical(DC_CODES), canonical(AC_CODES)
    bits, code = np.zeros(256, np.int64), np.zeros((2, 256), np.int64)
    for byte in range(256):
        value = byte - 128 if byte < 128 else byte - 127
        size = abs(value).bit_length()
        low = value if value > 0 else value + (1 << size) - 1
        bits[byte] = 4 + size
        code[0, byte], code[1, byte] = dc[size][1] << size | low, ac[size][1] << size | low
    return bits, code[0], code[1]


_BITS, _DC, _AC = _codes_of_bytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose bytes it holds padded with zeros to full blocks of 64."""
    shapes = []
    for p in payloads:
        n = max(1, -(-len(p) // BLOCK))
        wide = min(8191, isqrt(n - 1) + 1)
        shapes.append((wide, -(-n // wide)))
    blocks = np.array([w * h for w, h in shapes], dtype=np.int64)
    data = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(blocks)])
    for k, p in enumerate(payloads):
        data[at[k] * BLOCK : at[k] * BLOCK + len(p)] = np.frombuffer(p, np.uint8)
    grid = data.reshape(-1, BLOCK)
    bits = np.empty((len(grid), BLOCK + 1), np.int64)
    code = np.empty_like(bits)
    bits[:, :BLOCK] = _BITS[grid]
    code[:, :BLOCK] = _AC[grid]
    code[:, 0] = _DC[grid[:, 0]]
    total = bits[:, :BLOCK].sum(axis=1)
    fill = -total % 8
    bits[:, BLOCK], code[:, BLOCK] = fill, (1 << fill) - 1  # a segment ends on a byte, filled with ones
    size = (total + fill) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    offset = np.cumsum(bits, axis=1) - bits + start[:-1, None] * 8
    shift = (code << (24 - (offset & 7) - bits)).ravel()
    byte = (offset >> 3).ravel()
    n = int(start[-1])
    packed = np.zeros(n + 2, np.int64)
    for k in range(3):
        part = np.bincount(byte, (shift >> (16 - 8 * k)) & 255, minlength=n)
        packed[k : k + len(part)] += part.astype(np.int64)[: n + 2 - k]
    packed = packed[:n].astype(np.uint8)
    # a zero after each FF, and a restart marker after each block but an image's last
    last = np.zeros(len(grid), bool)
    last[at[1:] - 1] = True
    nth = np.arange(len(grid)) - np.repeat(at[:-1], blocks)
    width = 1 + (packed == 255).astype(np.int64)
    ends = start[1:] - 1
    width[ends] += 2 * ~last
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[place] = packed
    marks = place[ends] + width[ends] - 2
    out[marks[~last]] = 255
    out[marks[~last] + 1] = 0xD0 + (nth[~last] & 7)
    cut = np.concatenate([[0], (place + width)[ends[at[1:] - 1]]])
    files = []
    for k, (p, (w, h)) in enumerate(zip(payloads, shapes, strict=True)):
        head = b"\xff\xd8" + segment(0xFE, b"bytes=%d" % len(p)) + _TABLES[0] + segment(0xC0, bytes([8]) + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])) + _TABLES[1]
        head += segment(0xDD, (1).to_bytes(2, "big")) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
        files.append(head + out[cut[k] : cut[k + 1]].tobytes() + b"\xff\xd9")
    return files


@dataclass
class Image:
    """What the markers of a baseline JPEG say."""

    width: int = 0
    height: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component index, DC table, AC table
    restart: int = 0
    comment: bytes = b""
    begin: int = 0

    @property
    def most(self) -> tuple[int, int]:
        return max(c[1] for c in self.components), max(c[2] for c in self.components)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = self.most if len(self.components) > 1 else (1, 1)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks(self) -> list[int]:
        """Component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [k for k, _, _ in self.scan for _ in range(self.components[k][1] * self.components[k][2])]


def parse(data: bytes) -> Image:
    """Markers up to the start of the scan. Raises ValueError for what is no baseline JPEG of one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                m = sum(body[1:17])
                out.codes[body[0]] = body[1 : 17 + m]
                body = body[17 + m :]
        elif marker == 0xC0 or marker == 0xC1:
            if body[0] != 8:
                raise ValueError("samples are not of 8 bits")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in out.components]
            out.scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, 16 | body[2 + 2 * k] & 15) for k in range(body[0])]
            if len(out.scan) != len(out.components) or not out.width or not out.height:
                raise ValueError("more than one scan, or no size")
            out.begin = at
            return out


def lookup(code: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Over the next 16 bits: bits of the code (0: none), and the symbol."""
    bits, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    value, at = 0, 16
    for k in range(16):
        for _ in range(code[k]):
            low, high = value << (15 - k), (value + 1) << (15 - k)
            bits[low:high], symbol[low:high] = k + 1, code[at]
            value, at = value + 1, at + 1
        value <<= 1
    return bits, symbol


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _entry(code: bytes) -> np.ndarray:
    """bits << 8 | symbol over the next 16 bits."""
    if code not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        bits, symbol = lookup(code)
        _LOOKUPS[code] = (bits << 8 | symbol).astype(np.int32)
    return _LOOKUPS[code]


def coefficients(images: list[Image], files: list[bytes]) -> list[np.ndarray]:
    """Quantised coefficients (blocks in scan order, 64 in zigzag order) of each image; DC as stored, differences added up."""
    tables, where, patterns = [], {}, []
    seg_begin, seg_blocks, seg_first, seg_image, parts = [], [], [], [], []
    first_block, base = 0, 0
    bases = []
    for k, (image, data) in enumerate(zip(images, files, strict=True)):
        scan = np.frombuffer(data, np.uint8, offset=image.begin)
        ff = np.flatnonzero(scan[:-1] == 255)
        marks = ff[scan[ff + 1] != 0]
        code = scan[marks + 1]
        stop = np.flatnonzero((code < 0xD0) | (code > 0xD7))
        end = int(marks[stop[0]]) if len(stop) else len(scan)
        marks = marks[: stop[0]] if len(stop) else marks
        keep = np.ones(end, bool)
        stuffed = ff[ff < end - 1] + 1 if end else ff[:0]
        keep[stuffed[scan[stuffed] == 0]] = False
        keep[marks] = False
        keep[marks + 1] = False
        before = np.cumsum(keep)
        parts.append(scan[:end][keep])
        per_mcu = len(image.blocks())
        mcus = image.mcus[0] * image.mcus[1]
        each = image.restart or mcus
        count = np.full(-(-mcus // each), each)
        count[-1] = mcus - each * (len(count) - 1)
        begin = np.concatenate([[0], before[marks[: len(count) - 1]]])
        if len(begin) < len(count):
            raise ValueError("a restart marker is missing")
        seg_begin.append(begin + base)
        seg_blocks.append(count * per_mcu)
        seg_first.append(first_block + np.concatenate([[0], np.cumsum(count * per_mcu)[:-1]]))
        seg_image.append(np.full(len(count), k))
        key = tuple((image.codes[d], image.codes[a]) for comp in image.blocks() for c, d, a in image.scan if c == comp)
        if key not in where:
            where[key] = len(patterns)
            patterns.append([(len(tables) + 2 * i, len(tables) + 2 * i + 1) for i in range(len(key))])
            tables += [_entry(x) for pair in key for x in pair]
        bases.append((first_block, mcus * per_mcu, where[key]))
        first_block += mcus * per_mcu
        base += len(parts[-1])
    flat = np.concatenate([*parts, np.full(8, 255, np.uint8)])
    window = np.zeros(len(flat) - 4, np.uint32)
    for i in range(4):
        window |= flat[i : len(flat) - 4 + i].astype(np.uint32) << np.uint32(24 - 8 * i)
    table = np.concatenate(tables)
    width = max(len(p) for p in patterns)
    dc_of, ac_of = np.zeros((len(patterns), width), np.int64), np.zeros((len(patterns), width), np.int64)
    for i, p in enumerate(patterns):
        dc_of[i, : len(p)], ac_of[i, : len(p)] = [d for d, _ in p], [a for _, a in p]
    per = np.array([len(p) for p in patterns])
    out = np.zeros(first_block * 64, np.int16)
    image_pattern = np.array([b[2] for b in bases])
    pos, left, target = np.concatenate(seg_begin) * 8, np.concatenate(seg_blocks), np.concatenate(seg_first) * 64
    pattern = image_pattern[np.concatenate(seg_image)]
    k, turn = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    limit = (len(window) - 1) * 8
    dc_table, ac_table = dc_of[pattern, 0] << 16, ac_of[pattern, 0] << 16
    single = width == 1
    while len(pos):
        entry = table[np.where(k == 0, dc_table, ac_table) + ((window[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & np.uint32(0xFFFF))]
        bits = entry >> 8
        if not bits.all():
            raise ValueError("no such code")
        size, run = entry & 15, (entry >> 4) & 15
        pos = pos + bits
        low = (window[pos >> 3].astype(np.int64) >> np.maximum(32 - (pos & 7) - size, 0)) & ((1 << size) - 1)
        value = np.where(low < (1 << size) >> 1, low - (1 << size) + 1, low)
        pos = pos + size
        is_ac = k > 0
        end = is_ac & (size == 0) & (run != 15)
        k = k + run * is_ac
        if (k > 63).any():
            raise ValueError("a run leaves its block")
        put = size > 0
        out[(target + k)[put]] = value[put]
        k = np.where(end, 64, k + 1)
        if pos.max() > limit:
            raise ValueError("the scan ends early")
        done = k == 64
        if done.any():
            k[done] = 0
            left[done] -= 1
            target[done] += 64
            if not single:
                turn[done] = (turn[done] + 1) % per[pattern[done]]
                dc_table[done], ac_table[done] = dc_of[pattern[done], turn[done]] << 16, ac_of[pattern[done], turn[done]] << 16
            if (left == 0).any():
                go = left > 0
                pos, left, target, pattern, k, turn, dc_table, ac_table = (x[go] for x in (pos, left, target, pattern, k, turn, dc_table, ac_table))
    out = out.reshape(-1, 64)
    result = []
    for image, (first, n, _) in zip(images, bases, strict=True):
        own = out[first : first + n]
        if image.restart != 1 or len(image.blocks()) > 1:
            own = own.copy()
            blocks = np.array(image.blocks())
            each = image.restart or n
            for c in set(blocks.tolist()):
                at = np.flatnonzero(np.resize(blocks, n) == c)
                interval = at // (each * len(blocks))
                total = np.cumsum(own[at, 0].astype(np.int64))
                start = np.searchsorted(interval, interval)
                own[at, 0] = total - total[start] + own[at[start], 0]
        result.append(own)
    return result


def thumbnail(image: Image, coefs: np.ndarray) -> np.ndarray:
    """Luminance, a pixel for each 8 x 8 block of the first component: its mean from the DC coefficient."""
    _, h, v, q = image.components[0]
    if len(image.components) == 1:
        h = v = 1
    wide, high = image.mcus
    blocks = np.array(image.blocks())
    dc = coefs[np.resize(blocks, len(coefs)) == 0, 0].astype(np.int64) * image.quant[q][0]
    grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    c = image.components[0]
    mh, mv = image.most
    rows, cols = -(-image.height * c[2] // (8 * mv)) if len(image.components) > 1 else high, -(-image.width * c[1] // (8 * mh)) if len(image.components) > 1 else wide
    return np.clip((grid[:rows, :cols] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(grey: np.ndarray) -> str:
    """64 bits in hex: cells of an 8 x 8 grid that are lighter than their mean."""
    rows, cols = (np.arange(9) * n // 8 for n in grey.shape)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)
    r0, c0 = np.minimum(rows[:-1], grey.shape[0] - 1), np.minimum(cols[:-1], grey.shape[1] - 1)
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    cell = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    cell /= np.outer(r1 - r0, c1 - c0)
    return f"{int(''.join('1' if x else '0' for x in (cell > cell.mean()).ravel()), 2):016x}"


def feature(image: Image, coefs: np.ndarray) -> str:
    """Size, average hash and checksum of the thumbnail."""
    grey = thumbnail(image, coefs)
    return f"{image.width}x{image.height}:{average_hash(grey)}:{zlib.crc32(grey.tobytes()):08x}"


def payload(image: Image, coefs: np.ndarray) -> tuple[int, bytes]:
    """Bytes that encode() stored: their number, and with the zeros that fill the last of at least one block."""
    n = int(image.comment.removeprefix(b"bytes="))
    flat = coefs.reshape(-1)[: max(BLOCK, -(-n // BLOCK) * BLOCK)]
    return n, np.where(flat < 0, flat + 128, flat + 127).astype(np.uint8).tobytes()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
