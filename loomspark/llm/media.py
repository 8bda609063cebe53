"""AVI motion-JPEG: RIFF writing and parsing, intra frames, and shots by adaptive histogram differences.

Files from elsewhere are read too: frames are found by the index (without one, in the order in which they stand) and
decoded by their own tables (see jpeg). The frames that are written here are lossless JPEG (ITU T.81, process 14: SOF3, predictor 1, 8-bit samples, one component). The Huffman code gives
a difference of category s a code of 9 - s bits, so that every sample takes 9 bits with its s extra bits: the code is an
ordinary one for any decoder, and numpy writes and reads all samples of a video at once.

Defined cases: a null or empty text is 64 zero bytes; a video's last frame is filled with zero rows, and a chunk `plen`
in the header list says how many bytes count (without it all samples do). Equal payloads, repeated rows among them, give
equal files; a very long text is one video of many frames; an empty table gives no rows. A null media has no clips, and
nulls as what is read from it. Other columns are not read. Damaged files raise an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bytetext as B
from loomspark.llm import jpeg
from loomspark.llm.frames import arrow

WIDTH = 64
HEIGHT = 32
FPS = 25


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """9-bit word of each difference (index: difference + 255), and back as a byte."""
    word = np.zeros(511, dtype=np.uint64)
    back = np.zeros(512, dtype=np.uint8)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        length = 9 - s
        code = (1 << length) - 2  # 0, 10, 110, ...: categories from 8 down to 0
        w = code << s | (d if d >= 0 else d + (1 << s) - 1)
        word[d + 255] = w
        back[w] = d & 0xFF
    return word, back


_WORD, _BACK = _tables()


#: One code of each length from 1 to 9, for the categories from 8 down to 0.
_OWN_TABLE = {(0, 0): bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))}


def _jpeg_head(height: int) -> bytes:
    dht = b"\x00" + _OWN_TABLE[0, 0]
    sof = struct.pack(">BHHB3B", 8, height, WIDTH, 1, 1, 0x11, 0)
    sos = bytes([1, 1, 0x00, 1, 0, 0])
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(x) + 2) + x for m, x in ((0xC3, sof), (0xC4, dht), (0xDA, sos)))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """samples: frames x height x WIDTH of uint8. A JPEG file for each frame."""
    n, height, _ = samples.shape
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _WORD[d.reshape(-1, 8) + 255]
    top = c[:, 7] >> np.uint64(8)
    for k in range(7):
        top |= c[:, k] << np.uint64(55 - 9 * k)
    packed = np.empty((len(c), 9), dtype=np.uint8)
    packed[:, :8] = top.astype(">u8").view(np.uint8).reshape(-1, 8)
    packed[:, 8] = c[:, 7] & np.uint64(0xFF)
    head, raw, size = _jpeg_head(height), packed.tobytes(), height * WIDTH // 8 * 9
    return [head + raw[k * size : (k + 1) * size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for k in range(n)]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples of frames of one size: those with the tables and predictor of encode_frames all at once, others each by its own."""
    parsed = [jpeg.parse(f) for f in frames]
    if len({(f.height, f.width) for f in parsed}) != 1:
        raise ValueError("frames differ in size")
    height, width = parsed[0].height, parsed[0].width
    size = height * width // 8 * 9
    scans = [f.data.replace(b"\xff\x00", b"\xff") if f.huffman == _OWN_TABLE and f.process == jpeg.SOF3 and f.scan[-3:] == b"\1\0\0" and not width % 8 else b"" for f in parsed]
    if any(len(x) != size for x in scans):
        return np.stack([jpeg.decode(f) for f in parsed])
    packed = np.frombuffer(b"".join(scans), dtype=np.uint8).reshape(-1, 9)
    top = np.ascontiguousarray(packed[:, :8]).view(">u8").ravel().astype(np.uint64)
    words = np.empty((len(packed), 8), dtype=np.uint16)
    for k in range(7):
        words[:, k] = (top >> np.uint64(55 - 9 * k)) & np.uint64(511)
    words[:, 7] = ((top & np.uint64(1)) << np.uint64(8)).astype(np.uint16) | packed[:, 8]
    d = _BACK[words].reshape(len(frames), height, width)
    d[:, 0, 0] += np.uint8(128)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(d, axis=2, dtype=np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """payload: a positive multiple of WIDTH bytes, a sample each."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"a payload is a positive multiple of {WIDTH} bytes")
    rows = len(payload) // WIDTH
    height = min(HEIGHT, rows)
    n = -(-rows // height)
    samples = np.frombuffer(payload.ljust(n * height * WIDTH, b"\0"), dtype=np.uint8).reshape(n, height, WIDTH)
    frames = encode_frames(samples)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    strl = b"LIST" + struct.pack("<I", 4 + len(c := _chunk(b"strh", strh) + _chunk(b"strf", strf))) + b"strl" + c
    hdrl = b"hdrl" + _chunk(b"avih", avih) + strl + _chunk(b"plen", struct.pack("<Q", len(payload)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> tuple[list[bytes], int | None, float]:
    """Frames, payload size (None: not said), frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > end:
                raise ValueError("a RIFF chunk is cut off")
            if name == b"LIST":
                found[data[at + 8 : at + 12]] = (at + 8, size)
                if data[at + 8 : at + 12] != b"movi":  # the index leads there
                    walk(at + 12, at + 8 + size)
            else:
                found[name] = (at + 8, size)
            at += 8 + size + (size & 1)

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    if b"movi" not in found or b"strh" not in found:
        raise ValueError("an AVI file lacks its header or its frames")
    (movi, end), frames = found[b"movi"], []
    if b"idx1" in found:
        index, size = found[b"idx1"]
        entries = [x for x in struct.iter_unpack("<4sIII", data[index : index + size]) if x[0][2:] in (b"dc", b"db")]
        # offsets count from the list, or in some files from the file's beginning
        base = movi if not entries or data[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
        for name, _, at, length in entries:
            if data[base + at : base + at + 4] != name:
                raise ValueError("the index leads to no such chunk")
            frames.append(data[base + at + 8 : base + at + 8 + length])
    else:
        at = movi + 4
        while at + 8 <= movi + end:
            name, length = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name[2:] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + length])
            at += 8 + length + (length & 1)
    scale, rate = struct.unpack_from("<II", data, found[b"strh"][0] + 20)
    return frames, struct.unpack_from("<Q", data, found[b"plen"][0])[0] if b"plen" in found else None, rate / max(scale, 1)


def shots(samples: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.08) -> list[tuple[int, int]]:
    """First and last frame of each shot. A cut stands where the histogram difference to the frame before is over floor,
    and over mean + factor * deviation of the window differences before it (0 for the first)."""
    n = len(samples)
    flat = samples.reshape(n, -1)
    bins = (flat >> 4).astype(np.int64) + (np.arange(n) * 16)[:, None]
    hist = np.bincount(bins.ravel(), minlength=16 * n).reshape(n, 16) / flat.shape[1]
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    sums, squares = np.cumsum([0.0, *diff]), np.cumsum([0.0, *(diff * diff)])
    at = np.arange(len(diff))
    low = np.maximum(at - window, 0)
    m = np.maximum(at - low, 1)
    mean = (sums[at] - sums[low]) / m
    dev = np.sqrt(np.maximum((squares[at] - squares[low]) / m - mean * mean, 0))
    cuts = np.flatnonzero((diff > floor) & (diff > mean + factor * dev)) + 1
    begin = [0, *cuts.tolist()]
    return list(zip(begin, [*[c - 1 for c in begin[1:]], n - 1], strict=True))


def padded(text: bytes, unit: int = WIDTH) -> bytes:
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b"\0")


def encode_videos(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_bytes and media (an AVI file) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = B.texts_of(b["t"])
            for i, j in B.blocks(texts):
                yield pa.RecordBatch.from_arrays([b["k"][i:j], pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array([write_avi(padded(t)) for t in texts[i:j]], pa.binary())], [id, "n_bytes", "media"])

    rows = docs.select(F.col(id).alias("k"), F.col(text).alias("t"))
    return arrow(rows, run, docs.select(id).schema.add("n_bytes", "long").add("media", "binary"))


def clips(videos: DataFrame, id: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each shot: id, clip, start_ms, end_ms, n_frames, mean (of its samples). Null media gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in zip(b["k"], b["m"].to_pylist(), strict=True):
                frames, _, fps = read_avi(data)
                x = decode_frames(frames)
                rows = [(i, int(a * 1000 // fps), int((z + 1) * 1000 // fps), z - a + 1, round(float(x[a : z + 1].mean()), 3)) for i, (a, z) in enumerate(shots(x))]
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b["k"].type), *cols], [id, "clip", "start_ms", "end_ms", "n_frames", "mean"])

    rows = videos.where(F.col(media).isNotNull()).select(F.col(id).alias("k"), F.col(media).alias("m"))
    schema = videos.select(id).schema.add("clip", "integer").add("start_ms", "long").add("end_ms", "long").add("n_frames", "integer").add("mean", "double")
    return arrow(rows, run, schema)


def inspect(videos: DataFrame, id: str = "doc_id") -> DataFrame:
    """Of each video: what its stored bytes and the samples read back from them are, and a feature string of its clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b["media"].to_pylist():
                if data is None:
                    out.append((None,) * 6)
                    continue
                frames, size, fps = read_avi(data)
                x = decode_frames(frames)
                payload = x.tobytes()[:size]
                cut = shots(x)
                said = ",".join(f"{int(a * 1000 // fps)}-{int((z + 1) * 1000 // fps)}" for a, z in cut)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={len(frames)};shots={len(cut)};mean={x.mean():.3f};clips={said}"))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b["k"], b["n_bytes"], *cols], [id, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = videos.select(id).schema
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    return arrow(videos.select(F.col(id).alias("k"), "n_bytes", "media"), run, schema)
