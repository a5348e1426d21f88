"""Baseline JPEG files: what ``frame_files`` writes and reads as jpg.

Transforms, quantisation and bit packing are numpy over all blocks of a picture; Huffman codes are made for
each picture from its own symbols.  Reading takes baseline files of any subsampling and with restarts.
"""

from __future__ import annotations

import heapq
import re
import struct

import numpy as np

#: The published example tables of quantisation for lightness and for colour, in rows.
LIGHT = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: Places of a block by diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))
_DCT = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16)
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def _table(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((np.array(base) * scale + 50) / 100), 1, 255)


def _code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits; one more symbol keeps the code of all ones free."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate([*sorted(counts.items()), (256, 0)])]
    length = dict.fromkeys([*counts, 256], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, k, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            length[s] += 1
        heapq.heappush(heap, (n + m, k, a + b))
    # too deep a tree is rebalanced by the sum of its leaves' shares, frequent symbols keeping short codes
    order = sorted(length, key=lambda s: (s == 256, length[s], -counts.get(s, 0), s))
    sizes = [min(max(length[s], 1), 16) for s in order]
    share = lambda: sum(1 << 16 - n for n in sizes)
    while share() > 1 << 16:
        k = max((i for i, n in enumerate(sizes) if n < 16), key=lambda i: sizes[i])
        sizes[k] += 1
    return dict(zip(order, sorted(sizes), strict=True))


def _canonical(sizes: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """(code, bits) of symbols listed with their bits, shorter ones first."""
    codes, code, last = {}, 0, 0
    for symbol, bits in sizes:
        code <<= bits - last
        codes[symbol], code, last = (code, bits), code + 1, bits
    return codes


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _bits_of(v: np.ndarray) -> np.ndarray:
    """Bits that the size of each whole number needs."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _symbols(blocks: np.ndarray, comp: int, of: int) -> np.ndarray:
    """Rows (order, table, symbol, extra value, extra bits) of a component's quantised blocks (n, 64) in zigzag order."""
    n = len(blocks)
    base = (np.arange(n) * of + comp) * 2048
    kind = 0 if comp == 0 else 1
    size = _bits_of(diff := np.diff(blocks[:, 0], prepend=0))
    extra = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    rows = [np.stack([base, np.full(n, kind), size, extra(diff, size), size], 1)]
    b, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    before = np.where(np.append(-1, b[:-1]) == b, np.append(0, k[:-1]), 0)
    run, v = k - before - 1, blocks[b, k]
    size = _bits_of(v)
    rows.append(np.stack([base[b] + k * 16 + 15, np.full(len(b), 2 + kind), (run % 16) * 16 + size, extra(v, size), size], 1))
    long = run // 16
    at = np.repeat(np.arange(len(b)), long)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(long) - long, long)
    rows.append(np.stack([base[b[at]] + k[at] * 16 + nth, np.full(len(at), 2 + kind), np.full(len(at), 0xF0), 0 * at, 0 * at], 1))
    last = np.zeros(n, np.int64)
    np.maximum.at(last, b, k)
    open_ = np.flatnonzero(last < 63)
    rows.append(np.stack([base[open_] + 2047, np.full(len(open_), 2 + kind), 0 * open_, 0 * open_, 0 * open_], 1))
    return np.concatenate(rows)


def encode(pixels: np.ndarray, quality: int = 95) -> bytes:
    """JPEG of an (h, w, c) uint8 array, c 1, 3 or 4; an alpha channel is laid over white."""
    x = pixels.astype(np.float64)
    if x.shape[2] == 4:
        x = np.rint(x[..., :3] * x[..., 3:] / 255 + 255 - x[..., 3:])
    h, w, c = x.shape
    planes = [x[..., 0] - 128] if c == 1 else list(np.moveaxis(x @ _TO_YCC.T - [128, 0, 0], -1, 0))
    tables = [_table(LIGHT, quality), _table(COLOUR, quality)][: 1 if c == 1 else 2]
    rows = []
    for k, p in enumerate(planes):
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge")
        blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        freq = (_DCT @ blocks @ _DCT.T).reshape(-1, 64) / tables[min(k, 1)]
        rows.append(_symbols(np.rint(freq).astype(np.int64)[:, ZIGZAG], k, len(planes)))
    rows = np.concatenate(rows)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(_segment(0xDB, bytes([k]) + t[ZIGZAG].astype(np.uint8).tobytes()) for k, t in enumerate(tables))
    out += _segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(len(planes))))
    code, bits = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for t in range(4):
        found, n = np.unique(rows[rows[:, 1] == t, 2], return_counts=True)
        if not len(found):
            continue
        sizes = [(s, b) for s, b in _code_lengths(dict(zip(found.tolist(), n.tolist(), strict=True))).items() if s != 256]
        for s, (v, b) in _canonical(sizes).items():
            code[t, s], bits[t, s] = v, b
        number = [sum(b == k for _, b in sizes) for k in range(1, 17)]
        out += _segment(0xC4, bytes([(t >> 1) << 4 | t & 1, *number, *[s for s, _ in sizes]]))
    out += _segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(len(planes))) + b"\0\x3f\0")
    value = code[rows[:, 1], rows[:, 2]] << rows[:, 4] | rows[:, 3]
    size = bits[rows[:, 1], rows[:, 2]] + rows[:, 4]
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1
    stream = (np.repeat(value, size) >> left & 1).astype(np.uint8)
    data = np.packbits(np.append(stream, np.ones(-len(stream) % 8, np.uint8))).tobytes()
    return out + data.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def _lookup(number: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Bits and symbol by the next 16 bits."""
    sizes = [(k, b + 1) for k, b in enumerate(np.repeat(np.arange(16), list(number)).tolist())]
    bits, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for k, (v, b) in _canonical(sizes).items():
        bits[v << 16 - b : v + 1 << 16 - b], symbol[v << 16 - b : v + 1 << 16 - b] = b, symbols[k]
    return bits.tolist(), symbol.tolist()


def _read_blocks(data: bytes, order: list[tuple[int, tuple, tuple]], units: int, out: list[list], total: int) -> None:
    """Coefficients of up to ``units`` units from one run of coded data; order lists (component, DC table, AC table) of a unit."""
    raw = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff") + b"\xff" * 4, np.uint8)).astype(np.int32)
    window = np.zeros(len(raw) - 16, np.int32)
    for k in range(16):
        window |= raw[k : k + len(window)] << 15 - k
    window, at = window.tolist(), 0
    last = [0] * len(out)

    def number(s: int) -> int:
        nonlocal at
        if not s:
            return 0
        v = window[at] >> 16 - s
        at += s
        return v if v >> s - 1 else v - (1 << s) + 1

    for _ in range(min(units, total)):
        for comp, (dc_bits, dc_symbol), (ac_bits, ac_symbol) in order:
            if at >= len(window) or not dc_bits[window[at]]:
                raise ValueError("damaged JPEG data")
            v = window[at]
            at += dc_bits[v]
            last[comp] += number(dc_symbol[v])
            block = [0] * 64
            block[0], k = last[comp], 1
            while k < 64:
                if at >= len(window) or not ac_bits[window[at]]:
                    raise ValueError("damaged JPEG data")
                v = window[at]
                at += ac_bits[v]
                s = ac_symbol[v]
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    if k > 63:
                        raise ValueError("damaged JPEG data")
                    block[k] = number(s & 15)
                k += 1
            out[comp].append(block)


def decode(data: bytes) -> np.ndarray:
    """(h, w, 3) uint8 array of a baseline JPEG; grey becomes three channels."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, tables, codes, interval, straight = 2, {}, {}, 0, False
    while True:
        mark, size = struct.unpack(">xBH", data[at : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif mark in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if depth != 8 or n not in (1, 3):
                raise ValueError("only 8-bit JPEG files of one or three components")
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG files")
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            straight = body[11] == 0
        elif mark == 0xDA:
            break
    uses = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, wide, high = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-w // (8 * wide)), -(-h // (8 * high))
    order = [(k, codes[uses[p[0]] >> 4], codes[0x10 | uses[p[0]] & 15]) for k, p in enumerate(parts) for _ in range(p[1] * p[2])]
    found: list[list] = [[] for _ in parts]
    coded = data[at : data.rindex(b"\xff\xd9")]
    left = across * down
    for run in re.split(rb"\xff[\xd0-\xd7]", coded) if interval else [coded]:
        _read_blocks(run, order, interval or left, found, left)
        left -= interval
    planes = []
    for (_, a, b, q), blocks in zip(parts, found, strict=True):
        freq = np.zeros((len(blocks), 64))
        freq[:, ZIGZAG] = np.array(blocks) * tables[q]
        x = (_DCT.T @ freq.reshape(-1, 8, 8) @ _DCT).reshape(down, across, b, a, 8, 8)
        x = x.transpose(0, 2, 4, 1, 3, 5).reshape(down * b * 8, across * a * 8) + 128
        planes.append(x.repeat(high // b, 0).repeat(wide // a, 1)[:h, :w])
    x = np.clip(np.stack(planes if len(planes) == 3 else planes * 3, -1), 0, 255)
    if len(planes) == 3 and not straight:
        x = (x - [0, 128, 128]) @ np.linalg.inv(_TO_YCC).T
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)
