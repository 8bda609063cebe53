"""Intra frames of motion-JPEG (ITU T.81): lossless (SOF3) and baseline (SOF0) files with their own Huffman tables.

Lossless frames have one component of 8-bit samples and any of the seven predictors; of baseline frames the first
component (luma) is decoded, at its own sampling, whatever the others are. A frame of another process, without its
tables, or with broken data raises ValueError and says why.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

SOF0, SOF3, DHT, DQT, DRI, SOS = 0xC0, 0xC3, 0xC4, 0xDB, 0xDD, 0xDA


@dataclass
class Frame:
    """Segments of a JPEG file up to its scan."""

    process: int = 0
    height: int = 0
    width: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # component: id, samples across, down, quantisation table
    huffman: dict[tuple[int, int], bytes] = field(default_factory=dict)  # (class, number): counts by length, then symbols
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    restart: int = 0
    scan: bytes = b""  # header of the scan
    data: bytes = b""  # its entropy-coded bytes, as they stand


def parse(file: bytes) -> Frame:
    if file[:2] != b"\xff\xd8" or file[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG file")
    out, at, kind = Frame(), 2, 0
    while kind != SOS:
        if at + 4 > len(file) or file[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        kind, size = file[at + 1], struct.unpack_from(">H", file, at + 2)[0]
        body = file[at + 4 : at + 2 + size]
        if kind in (SOF0, SOF3):
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError(f"samples of {bits} bits are not read")
            out.process, out.parts = kind, [(c, s >> 4, s & 15, q) for c, s, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
        elif 0xC0 <= kind <= 0xCF and kind not in (DHT, 0xC8, 0xCC):
            raise ValueError(f"JPEG process {kind:#x} is not read; lossless and baseline are")
        elif kind == DHT:
            while body:
                n = sum(body[1:17])
                out.huffman[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == DQT:
            while body:
                wide = body[0] >> 4
                out.quantisation[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == DRI:
            out.restart = struct.unpack(">H", body)[0]
        elif kind == SOS:
            out.scan = body
        at += 2 + size
    if not out.process or not out.height or not out.width:
        raise ValueError("a JPEG frame has no size")
    out.data = file[at:-2]
    return out


def _lookup(table: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits: the code's length (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    code, k = 0, 16
    for n, count in enumerate(table[:16], 1):
        for _ in range(count):
            at = code << 16 - n
            length[at : at + (1 << 16 - n)], symbol[at : at + (1 << 16 - n)] = n, table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length.tolist(), symbol.tolist()


class _Bits:
    """The bits of one restart interval."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff" * 4, dtype=np.uint8).astype(np.uint32)
        three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        self.window = ((three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).ravel().tolist()
        self.at, self.end = 0, 8 * (len(raw) - 4)

    def code(self, table: tuple[list[int], list[int]]) -> int:
        w = self.window[self.at]
        n = table[0][w]
        self.at += n
        if not n or self.at > self.end:
            raise ValueError("a JPEG code is broken")
        return table[1][w]

    def number(self, size: int) -> int:
        if not size:
            return 0
        value = self.window[self.at] >> 16 - size
        self.at += size
        if self.at > self.end:
            raise ValueError("a JPEG scan is cut off")
        return value if value >> size - 1 else value - (1 << size) + 1


def _intervals(frame: Frame) -> list[bytes]:
    out, start, at = [], 0, frame.data.find(b"\xff")
    while at >= 0:
        if 0xD0 <= frame.data[at + 1] <= 0xD7:
            out.append(frame.data[start:at])
            start = at + 2
        at = frame.data.find(b"\xff", at + 2)
    return [*out, frame.data[start:]]


def _table(frame: Frame, kind: int, number: int) -> tuple[list[int], list[int]]:
    if (kind, number) not in frame.huffman:
        raise ValueError("a JPEG frame lacks a Huffman table")
    return _lookup(frame.huffman[kind, number])


def decode(frame: Frame) -> np.ndarray:
    """height x width samples (uint8) of the first component."""
    tables = {c: t for c, t in struct.iter_unpack("BB", frame.scan[1 : 1 + 2 * frame.scan[0]])}
    if [c for c, *_ in frame.parts if c not in tables]:
        raise ValueError("a JPEG file of several scans is not read")
    return _lossless(frame, tables) if frame.process == SOF3 else _baseline(frame, tables)


def _lossless(frame: Frame, tables: dict[int, int]) -> np.ndarray:
    predictor, shift = frame.scan[-3], frame.scan[-1] & 15
    if len(frame.parts) != 1 or frame.restart or not 1 <= predictor <= 7:
        raise ValueError("lossless JPEG is read with one component, a predictor from 1 to 7 and no restarts")
    table = _table(frame, 0, tables[frame.parts[0][0]] >> 4)
    bits = _Bits(frame.data)
    rows: list[list[int]] = []
    for y in range(frame.height):
        row: list[int] = []
        for x in range(frame.width):
            if not y:
                guess = row[-1] if x else 1 << 7 - shift
            elif not x:
                guess = rows[-1][0]
            else:
                a, b, c = row[-1], rows[-1][x], rows[-1][x - 1]
                guess = (a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor - 1]
            size = bits.code(table)
            row.append(guess + (bits.number(size) if size < 16 else 32768) & 0xFFFF)
        rows.append(row)
    return (np.array(rows) << shift).astype(np.uint8)


def _zigzag() -> np.ndarray:
    """Place in the block (row by row) of the k-th coefficient."""
    cells = sorted(((x + y, (y if (x + y) % 2 else x), y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([c[2] for c in cells])


def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 1 / 2)


def _baseline(frame: Frame, tables: dict[int, int]) -> np.ndarray:
    wide, high = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    alone = len(frame.parts) == 1
    first = frame.parts[0]
    parts = [((1, 1) if alone else (h, v), _table(frame, 0, tables[c] >> 4), _table(frame, 1, tables[c] & 15)) for c, h, v, _ in frame.parts]
    (h, v), *_ = parts[0]
    if not alone and (h, v) != (wide, high):
        raise ValueError("a JPEG file whose first component is not its finest is not read")
    across, down = -(-frame.width // (8 * h)), -(-frame.height // (8 * v))
    if first[3] not in frame.quantisation:
        raise ValueError("a JPEG frame lacks a quantisation table")
    blocks = np.zeros((down * v, across * h, 64), dtype=np.int64)
    unit, units = 0, across * down
    for data in _intervals(frame):
        bits, last = _Bits(data), [0] * len(parts)
        for _ in range(min(frame.restart or units, units - unit)):
            for k, ((hk, vk), dc, ac) in enumerate(parts):
                for j in range(vk):
                    for i in range(hk):
                        last[k] += bits.number(bits.code(dc))
                        got, at = [(0, last[k])], 1
                        while at < 64:
                            both = bits.code(ac)
                            if not both & 15:
                                if both != 0xF0:
                                    break
                                at += 16
                                continue
                            at += both >> 4
                            if at > 63:
                                raise ValueError("a JPEG block has too many coefficients")
                            got.append((at, bits.number(both & 15)))
                            at += 1
                        if not k:
                            block = blocks[unit // across * v + j, unit % across * h + i]
                            for place, value in got:
                                block[place] = value
            unit += 1
    if unit < units:
        raise ValueError("a JPEG scan is cut off")
    natural = np.zeros_like(blocks)
    natural[:, :, _zigzag()] = blocks * frame.quantisation[first[3]]
    c = _cosines()
    x = np.einsum("ku,rckl,lv->rcuv", c, natural.reshape(*blocks.shape[:2], 8, 8), c) + 128
    x = np.clip(np.round(x), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(down * v * 8, across * h * 8)
    return x[: frame.height, : frame.width]
