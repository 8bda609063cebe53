"""Token-id shards compressed by Re-Pair.

A shard holds the ids of a range of documents in ascending order of id. Frequent pairs of neighbouring symbols are
replaced by nonterminals, round after round, until no pair occurs LEAST_COUNT times. In a round every pair that occurs
so often is counted, and a pair is replaced where it is more frequent than the two pairs that overlap it (ties by a hash
of the pair, so that copies of a passage are parsed alike; of a run of one symbol every second pair). A pair of two old
symbols that is rare stays rare, so only pairs next to a replacement are counted again: later rounds are cheap. A pair
never spans two documents. The shard stores the rules with their expansion lengths, the symbols that are left, and each
document's numbers of symbols and ids: any document, or any of its ids, is decoded alone.

Shard format, little-endian: magic `LRP2`; u32 numbers of documents, rules, symbols, first nonterminal; i64 first
document id; u8 widths in bits of ids' steps, symbols, lengths, counts; then, each packed to its width and padded to a
byte: document ids as steps (sign in the lowest bit), rules' left and right parts, rules' expansion lengths, symbols, documents' numbers of
symbols, and of ids.

Shards are a table in the shared folder (part, shard, n_docs, n_ids, data), range-partitioned by document id.

Defined cases: a null or empty text has the end id alone; rows that share an id, repeated rows among them, stand one
after another in any order; a very long text stays in one shard, which it may make larger than SHARD_IDS; an empty
table has no shard. Null ids count as 0. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.frames import arrow
from loomspark.llm.tokens import encoder as encoder_of
from loomspark.plans.shared import saved

END = 2
#: Occurrences from which a pair is replaced: a rule takes the room of about three symbols.
LEAST_COUNT = 8
SHARD_IDS = 1_000_000
TEXTS_AT_ONCE = 250
#: Symbols are linked, no longer moved, when fewer than the LINKED-th part of them begin a pair that may be frequent.
LINKED = 4
_SLOTS = 18
_MAGIC = b"LRP2"
_HEAD = "<4Iq4B"


def compress(ids: np.ndarray, last: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, where documents end among them, rules (left, right, expansion length), and the first nonterminal. last: true at each document's last id.

    Pairs are counted in slots of a hash that changes from round to round. A slot counts one pair, the one that stands in
    it last; another pair of the same slot waits for a round in which it has a slot of its own, so counts are exact.
    """
    first = int(ids.max()) + 1 if len(ids) else 1
    symbols, last = ids.astype(np.uint32), last.astype(bool)
    rules: list[np.ndarray] = []
    size = np.ones(first, dtype=np.int64)
    open_ = np.flatnonzero(~last)  # where a pair begins that may be frequent
    following = preceding = gone = None  # neighbours of each place that is left, once few pairs are open: symbols then stay where they are
    holder = np.zeros(1 << _SLOTS, dtype=np.uint64)
    number = np.zeros(1 << _SLOTS, dtype=np.int64)
    slots = np.arange(1 << _SLOTS)
    odd = 0x9E3779B97F4A7C15
    while len(open_):
        key = symbols[open_].astype(np.uint64)
        key <<= np.uint64(32)
        key |= symbols[open_ + 1 if following is None else following[open_]]
        slot = key * np.uint64(odd)
        slot >>= np.uint64(64 - _SLOTS)
        slot = slot.view(np.int64)
        odd = odd * 0x5851F42D4C957F2D & (1 << 64) - 1
        # a slot's count is at least a pair's: most rare pairs go at once
        often = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOTS) >= least)[slot])
        open_, key, slot = open_[often], key[often], slot[often]
        holder[slot] = key
        held = holder[slot] == key
        n = np.bincount(slot[np.flatnonzero(held)], minlength=1 << _SLOTS)
        keep = np.flatnonzero(~held | (n >= least)[slot])
        open_, slot, held = open_[keep], slot[keep], held[keep]
        if not len(open_):
            break
        score = (n << _SLOTS | slots)[slot] * held
        joined = (open_[:-1] + 1 if following is None else following[open_[:-1]]) == open_[1:]
        before, after = np.append(0, score[:-1] * joined), np.append(score[1:] * joined, 0)
        best = (score > 0) & (before <= score) & (after <= score)
        # of a run of equal pairs every second one
        equal = before == score
        twin = np.flatnonzero(best & equal)
        taken = best
        if len(twin):
            begin = np.flatnonzero(~equal)
            taken = best.copy()
            taken[twin] = (twin - begin[np.searchsorted(begin, twin, side="right") - 1]) % 2 == 0
        taken = np.flatnonzero(taken)
        at, of = open_[taken], slot[taken]
        used = np.bincount(of, minlength=1 << _SLOTS)
        pays = np.flatnonzero((used >= least)[of])
        at, of = at[pays], of[pays]
        if not len(at):  # what is best overlaps itself too often: it is done, unless others wait for a slot
            open_ = open_[~best]
            continue
        kind = np.flatnonzero(used >= least)
        number[kind] = np.arange(len(kind))
        a, b = (holder[kind] >> np.uint64(32)).astype(np.int64), (holder[kind] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rules.append(np.stack([a, b, size[a] + size[b]], axis=1))
        symbols[at] = number[of] + len(size)
        size = np.concatenate([size, size[a] + size[b]])
        if following is not None:
            second = following[at]
            last[at] |= last[second]
            gone[second] = True
            following[at] = following[second]
            inner = np.flatnonzero(following[at] < len(symbols))
            preceding[following[at[inner]]] = at[inner]
            seen[open_] = seen[np.maximum(preceding[at], 0)] = True
            new = np.flatnonzero(seen)
            seen[new] = False
            open_ = new[~(gone[new] | last[new])]
            continue
        last[at] |= last[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        seen = np.zeros(len(symbols), dtype=bool)
        seen[open_] = True
        symbols, last, seen = symbols[keep], last[keep], seen[keep]
        new = at - np.arange(len(at))  # places after the cut
        seen[np.maximum(new - 1, 0)] = True
        open_ = np.flatnonzero(seen & ~last)
        if len(open_) < len(symbols) // LINKED:
            following, preceding = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
            gone, seen = np.zeros(len(symbols), dtype=bool), np.zeros(len(symbols), dtype=bool)
    if following is not None:
        left = np.flatnonzero(~gone)
        symbols, last = symbols[left], last[left]
    return symbols, last, np.concatenate(rules) if rules else np.zeros((0, 3), dtype=np.int64), first


def _bits(values: np.ndarray) -> int:
    return max(1, int(values.max()).bit_length()) if len(values) else 1


def _packed(values: np.ndarray, width: int) -> bytes:
    out = bytearray()
    for i in range(0, len(values), 1 << 16):  # whole bytes: 2**16 values of any width
        part = values[i : i + (1 << 16)].astype("<u4" if width <= 32 else "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, count=width, bitorder="little")
        out += np.packbits(bits.ravel(), bitorder="little").tobytes()
    return bytes(out)


def _unpacked(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        m = min(1 << 16, n - i)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-m * width // 8), i // 8 * width), count=m * width, bitorder="little").reshape(m, width)
        whole = np.zeros((m, 32 if width <= 32 else 64), dtype=np.uint8)
        whole[:, :width] = bits
        out[i : i + m] = np.packbits(whole, axis=1, bitorder="little").view("<u4" if width <= 32 else "<i8").ravel()
    return out


def write_shard(doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> bytes:
    """doc_ids: ascending. ends: each document's end among ids; no document is empty."""
    last = np.zeros(len(ids), dtype=bool)
    last[ends - 1] = True
    symbols, last, rules, first = compress(ids, last)
    per = np.diff(np.flatnonzero(last), prepend=-1)
    counts = np.concatenate([per, np.diff(ends, prepend=0)])
    steps = np.diff(doc_ids, prepend=doc_ids[:1])
    steps = steps << 1 ^ steps >> 63  # a null id counts as 0, before negative ones
    widths = [_bits(steps), max(1, (first + len(rules) - 1).bit_length()), _bits(rules[:, 2]), _bits(counts)]
    head = struct.pack(_HEAD, len(doc_ids), len(rules), len(symbols), first, int(doc_ids[0]) if len(doc_ids) else 0, *widths)
    parts = [(steps, 0), (rules[:, 0], 1), (rules[:, 1], 1), (rules[:, 2], 2), (symbols, 1), (counts[: len(per)], 3), (counts[len(per) :], 3)]
    return _MAGIC + head + b"".join(_packed(values, widths[k]) for values, k in parts)


class Shard:
    """A shard that was read; ids of any document, or of any range of it."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a shard")
        n_docs, n_rules, n_symbols, self.first, least, *widths = struct.unpack_from(_HEAD, data, 4)
        view, at, parts = memoryview(data), 4 + struct.calcsize(_HEAD), []
        for n, k in ((n_docs, 0), (n_rules, 1), (n_rules, 1), (n_rules, 2), (n_symbols, 1), (n_docs, 3), (n_docs, 3)):
            parts.append(_unpacked(view[at:], n, widths[k]))
            at += sum(-(-min(1 << 16, n - i) * widths[k] // 8) for i in range(0, n, 1 << 16))
        steps, left, right, length, self.symbols, symbols, ids = parts
        self.ids = least + np.cumsum(steps >> 1 ^ -(steps & 1))
        self.symbol, self.start = np.append(0, np.cumsum(symbols)), np.append(0, np.cumsum(ids))
        self.rules = np.stack([left, right, length], axis=1)
        # each nonterminal's ids, one after another; a rule's parts stand before it
        self.size = np.concatenate([np.ones(self.first, dtype=np.int64), length])
        self.at = np.concatenate([np.arange(self.first), self.first + np.cumsum(length) - length])
        self.flat = np.zeros(self.first + int(length.sum()), dtype=np.uint32)
        self.flat[: self.first] = np.arange(self.first)
        needs = np.maximum(left, right) - self.first  # the latest rule that a rule is made of
        done = 0
        while done < n_rules:  # all rules at once that need none of themselves
            wait = np.flatnonzero(needs[done:] >= done)
            stop = done + int(wait[0]) if len(wait) else n_rules
            got = self.expand(np.stack([left[done:stop], right[done:stop]], axis=1).ravel())
            self.flat[self.at[self.first + done] : self.at[self.first + done] + len(got)] = got
            done = stop

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        total = np.cumsum(size)
        return self.flat[np.repeat(self.at[symbols] - total + size, size) + np.arange(int(total[-1]) if len(total) else 0)]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the k-th document; only the symbols that hold them are expanded."""
        symbols = self.symbols[self.symbol[k] : self.symbol[k + 1]]
        edge = np.cumsum(self.size[symbols])
        stop = int(edge[-1]) if stop is None else min(stop, int(edge[-1]))
        a, z = np.searchsorted(edge, start, side="right"), np.searchsorted(edge, stop, side="left")
        skipped = int(edge[a - 1]) if a else 0
        return self.expand(symbols[a : z + 1])[start - skipped : stop - skipped]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return self.expand(self.symbols), self.start


def write_shards(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shard table of docs, written: documents in ascending order of id over (part, shard)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("k"), F.col(text).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "k").sortWithinPartitions("k").select("k", "t", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, with_space=False)
        shard, held, n, part = 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            ends = np.cumsum(np.concatenate([h[2] for h in held]))
            cols = [[part], [shard], [len(keys)], [len(ids)], [write_shard(keys, ids, ends)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "shard", "n_docs", "n_ids", "data"])

        for b in batches:
            keys, texts = np.array([x or 0 for x in b["k"].to_pylist()], dtype=np.int64), [t or "" for t in b["t"].to_pylist()]
            part = b["part"][0].as_py() if b.num_rows else part
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                ids, at = encoder.encode(texts[i : i + TEXTS_AT_ONCE])
                held.append((keys[i : i + TEXTS_AT_ONCE], np.insert(ids, at[1:], np.uint32(end)), np.diff(at) + 1))
                n += len(held[-1][1])
                if n >= shard_ids:
                    yield flush()
                    shard, held, n = shard + 1, [], 0
        if held:
            yield flush()

    return saved(arrow(rows, run, "part int, shard int, n_docs long, n_ids long, data binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a shard table, decoded. start is over all shards in order."""
    sizes = sorted((r["part"], r["shard"], r["n_ids"]) for r in shards.select("part", "shard", "n_ids").collect())  # a row by shard of about SHARD_IDS ids
    starts, total = {}, 0
    for part, shard, n in sizes:
        starts[part, shard] = total
        total += n
    known = shards.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, data in zip(b["part"].to_pylist(), b["shard"].to_pylist(), b["data"].to_pylist(), strict=True):
                s = Shard(data)
                ids, at = s.all()
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(at[:-1] + known.value[part, shard]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow(shards.select("part", "shard", "data"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
