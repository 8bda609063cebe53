"""Best-two-fit packing of token sequences.

Pieces are packed by length: what can differ between two pieces of one length is only which of them goes where. So the
packer works on the histogram of lengths, whose size is bounded by the capacity, whatever the number of documents:
a bin is filled greedily with the longest pieces that fit; if a gap is left, its smallest piece is taken out and the two
unpacked pieces whose lengths together fit the grown gap most tightly are put in, if that fills more. The bin so made
is repeated as often as the counts allow. A piece's bin then follows from its length and its rank among the pieces of
that length, and ranks are sums of counts by partition. All pieces of full length fill sequences of their own.

Defined cases: a null or empty text has the end id alone; repeated rows, and rows that share an id or have none, are
pieces each; a very long text is encoded whole and cut; of pieces of one length any may stand in any of their places; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.frames import arrow
from loomspark.llm.tokens import encoder as encoder_of
from loomspark.plans.shared import saved

CAPACITY = 2048
END = 0
TEXTS_AT_ONCE = 250


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), for counts of pieces by length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        left[length] = n
    out: list[tuple[list[int], int]] = []
    index = np.arange(capacity + 1)

    def longest(most: int, used: list[int]) -> int:
        """The longest unpacked length up to most; 0: none."""
        while most > 0:
            most = int(below[most])
            if most == 0 or left[most] > used.count(most):
                return most
            most -= 1
        return 0

    while left.any():
        below = np.maximum.accumulate(np.where(left > 0, index, 0))
        bin_, gap = [], capacity
        while length := longest(gap, bin_):
            bin_.append(length)
            gap -= length
        if gap and len(bin_) > 1:
            small, room = bin_[-1], gap + bin_[-1]
            rest, best = bin_[:-1], (small, None)
            for a in np.flatnonzero(left[: room // 2 + 1]).tolist():
                if left[a] <= rest.count(a):
                    continue
                b = longest(room - a, [*rest, a])
                if b and a + b > best[0]:
                    best = (a + b, (a, b))
                    if a + b == room:
                        break
            if best[1]:
                bin_ = [*rest, *best[1]]
        times = min(int(left[x]) // bin_.count(x) for x in set(bin_))
        for x in bin_:
            left[x] -= times
        out.append((bin_, times))
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, offset); a run's k-th rank is in its k-th sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + times
            offset += x
        sequence += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in out.items()}


def cut(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32, and part and nth: its partition and its number there among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, with_space=True)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            texts, keys, part = [t or "" for t in b["t"].to_pylist()], b["k"], b["part"]
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                ids, at = encoder.encode(texts[i : i + TEXTS_AT_ONCE])
                rows = []
                for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    own = np.append(ids[x:y], np.uint32(end)).astype("<u4")
                    first = len(own) % capacity or capacity
                    edges = [0, *range(first, len(own) + 1, capacity)]
                    for n, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        rows.append((i + k, n, a, z - a, zlib.crc32(own[a:z].tobytes()), seen[z - a]))
                        seen[z - a] += 1
                index, *cols = zip(*rows, strict=True)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(index)), part.take(pa.array(index)), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], [id, "part", "piece", "start", "length", "ids_crc32", "nth"])

    schema = docs.select(id).schema.add("part", "integer")
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("nth", "long")):
        schema = schema.add(name, kind)
    return arrow(docs.select(F.col(id).alias("k"), F.col(text).alias("t"), F.spark_partition_id().alias("part")), run, schema)


def pack(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    pieces = saved(cut(docs, path, text, id, capacity, end), "pieces")
    by_part = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(best_two_fit(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # runs of bins: bounded by the capacity too
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    # each part's pieces meet its own counts of what stands before, which are sorted in front of them: nothing of the size of parts x lengths is sent anywhere
    empty = {c: F.lit(None).cast(pieces.schema[c].dataType) for c in (id, "piece", "start", "ids_crc32")}
    ahead = by_part.select("part", "length", before.cast("long").alias("nth")).withColumns(empty).withColumn("own", F.lit(False))
    both = pieces.withColumn("own", F.lit(True)).unionByName(ahead).repartition("part").sortWithinPartitions("part", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        ahead, at = np.zeros(capacity + 1, dtype=np.int64), None
        for b in batches:
            part, length, nth, own = (b[c].to_numpy(zero_copy_only=False) for c in ("part", "length", "nth", "own"))
            rank, keep = np.zeros(len(part), dtype=np.int64), np.flatnonzero(own)
            edges = np.flatnonzero(np.diff(part, prepend=part[:1] - 1)).tolist()
            for x, y in zip(edges, [*edges[1:], len(part)], strict=True):
                if part[x] != at:
                    ahead[:], at = 0, part[x]
                first = x + int(np.searchsorted(own[x:y], True))
                ahead[length[x:first]] = nth[x:first]
                rank[first:y] = nth[first:y] + ahead[length[first:y]]
            length, rank = length[keep], rank[keep]
            sequence, offset = np.zeros(len(keep), dtype=np.int64), np.zeros(len(keep), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(rows):
                    continue
                of = runs[int(length[rows[0]])]
                k = np.searchsorted(of[:, 0], rank[rows], side="right") - 1
                sequence[rows] = of[k, 1] + rank[rows] - of[k, 0]
                offset[rows] = of[k, 2]
            kept = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*[kept[c] for c in names[:5]], pa.array(sequence), pa.array(offset)], names)

    names = [id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = docs.select(id).schema
    for name, kind in zip(names[1:], ("integer", "long", "long", "long", "long", "long"), strict=True):
        schema = schema.add(name, kind)
    return arrow(both.select(*names[:5], "part", "nth", "own"), run, schema)
