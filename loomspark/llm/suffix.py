"""Exact removal of long repeated byte strings by a sparse, distributed suffix array.

A byte goes when a LENGTH-byte string that covers it starts at another place too. The strings are found so:

1. Anchors. Among the GRAM-byte hashes inside each LENGTH-byte window the leftmost least one is the window's anchor
   (winnowing, Schleimer et al., 2003). Equal windows have anchors of equal hash at equal offsets, and anchors are
   only about one in a hundred places. Exact copies of a text are one class; one of it goes on.
2. Anchors whose hash occurs once are done. For the others the text around them is cut out: the suffix from the anchor,
   and the bytes before it, as far as the anchor's windows reach.
3. Rows of one hash meet. Their suffixes, and their reversed prefixes, are put in order by deep-shallow sorting; the
   common prefixes of neighbours give, for each offset of a window to its anchor, which rows agree to the left and to
   the right. Rows that agree on both sides have equal windows. No pairs are formed: time is by rows times offsets.
4. A hash with more than BUCKET_ROWS rows is not sorted in one task: rows with equal bytes are counted by a combining
   aggregation; of those that are left the windows are hashed (128 bits) and counted so. That is exact too, and no
   group of copies meets in one place.

A second, shorter length may be asked for: the same anchors then are those of its windows, and each longer window
belongs to the anchor of its first bytes; one order of suffixes answers both.

Defined cases: a null or empty text has no bytes and keeps its empty rest; texts shorter than LENGTH lose nothing;
repeated rows are copies of each other and so lose all their bytes from LENGTH on; matches never cross texts. A very
long text is scanned as a block of its own and meets others by its anchors only; its rest is cut in one pass. Ties have
no part: all places of a repeated string count. An empty table gives no rows. Columns of other names, `h` or `spans`
among them, are not read, and come back as they were in `own`.
Each row is a text of its own: where ids are null or repeated, rows go by numbers and get their ids back at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bytetext as B
from loomspark.llm.deepshallow import deep_shallow_sort
from loomspark.llm.frames import arrow, numbered, only, spread_join
from loomspark.plans.shared import discard, saved

LENGTH = 400
GRAM = 128
BUCKET_ROWS = 100_000
#: Bytes that a passage of over 50 words has, at under five bytes a word with its space.
PASSAGE = 250
SPANS = "length int, doc_id long, a long, b long"


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of a block of texts: each anchor's text, hash, position, and first and last start of its windows."""
    buf, starts = B.joined(texts)
    n, width = len(buf) - gram + 1, length - gram + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < width:
        return empty, empty, empty, empty, empty
    at = np.arange(n)
    h = B.range_hash(B.prefix(buf), at, at + gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    # sliding minimum: least to the right within blocks, least to the left within blocks
    pad = np.concatenate([key, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - width + 1], left[width - 1 : n])
    where = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = starts[1:] - 1  # without the separator
    doc = np.searchsorted(starts, np.arange(len(where)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(where)) + length <= ends[doc])
    if not len(inside):
        return empty, empty, empty, empty, empty
    doc, where = doc[inside], where[inside]
    new = np.flatnonzero((np.diff(where, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    last = np.append(new[1:], len(where)) - 1
    d, p = doc[new], where[new]
    return d, h[p].view(np.int64), p - starts[d], inside[new] - starts[d], inside[last] - starts[d]


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Each row's size, digests and anchors."""
    ints = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = B.texts_of(b["text"]), b["doc_id"]
            for i, j in B.blocks(texts):
                part = texts[i:j]
                d, h, p, first, last = anchors(part, length, gram)
                offsets = np.searchsorted(d, np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (h, p << 32 | (p - first) << 16 | (p - last))]
                sha = [hashlib.sha256(t).hexdigest() for t in part]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array([len(t) for t in part], pa.int64()), pa.array(sha, pa.string()), *[x.cast(ints) for x in lists]], ["doc_id", "n_bytes", "sha", "h", "place"])

    return arrow(docs, run, "doc_id long, n_bytes long, sha string, h array<long>, place array<long>")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """texts: doc_id, text, found (h, place, n). A row by anchor: the bytes that its windows of length cover, as far as the text goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b["doc_id"].to_pylist(), b["found"].to_pylist()
            rows: list[tuple] = []
            for doc, text, anchors_ in zip(ids, B.texts_of(b["text"]), found, strict=True):
                for a in anchors_:
                    p, most, least = a["place"] >> 32, a["place"] >> 16 & 0xFFFF, a["place"] & 0xFFFF
                    rows.append((a["h"], doc, p, most, least, a["n"], text[p - most : p - least + length]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            names = ["h", "doc_id", "p", "most", "least", "n", "bytes"]
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 5000], t) for c, t in zip(cols, types, strict=True)], names)

    return arrow(texts, run, "h long, doc_id long, p long, most int, least int, n long, bytes binary")


def repeated_starts(h: np.ndarray, most: np.ndarray, least: np.ndarray, data: list[bytes], lengths: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each length and offset: the rows whose window that far before its anchor is another row's too."""
    n = len(h)
    suffix = [d[m:] for d, m in zip(data, most.tolist(), strict=True)]
    before = [d[:m][::-1] for d, m in zip(data, most.tolist(), strict=True)]
    r_order, r_lcp = deep_shallow_sort(h, suffix)
    l_order, l_lcp = deep_shallow_sort(h, before)
    by_least = np.argsort(least, kind="stable")
    least_sorted = least[by_least]
    right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for off in range(int(least.min()), int(most.max()) + 1):
        rows = by_least[: np.searchsorted(least_sorted, off, side="right")]
        rows = rows[most[rows] >= off]
        if len(rows) < 2:
            continue
        left[l_order] = np.cumsum(l_lcp < off)
        for length in lengths:
            right[r_order] = np.cumsum(r_lcp < length - off)
            key = right[rows] * n + left[rows]
            order = np.argsort(key)
            k = key[order]
            same = k[1:] == k[:-1]
            hit = np.zeros(len(rows), dtype=bool)
            hit[1:] |= same
            hit[:-1] |= same
            if hit.any():
                yield length, off, rows[order[hit]]


def _intervals(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts in one text: text, first byte, end of the last string."""
    order = np.lexsort((start, doc))
    d, s = doc[order], start[order]
    new = np.flatnonzero((np.diff(d, prepend=d[:1] - 1) != 0) | (np.diff(s, prepend=-9) > 1))
    last = np.append(new[1:], len(d)) - 1
    return d[new], s[new], s[last] + length


def _sorted_spans(contexts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Covered ranges out of the rows of each hash, which meet in one task."""

    def spans(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, doc, p, most, least = (t[c].to_numpy().astype(np.int64) for c in ("h", "doc_id", "p", "most", "least"))
        found: dict[int, list] = {}
        for length, off, rows in repeated_starts(h, most, least, t["bytes"].to_pylist(), lengths):
            found.setdefault(length, []).append((doc[rows], p[rows] - off))
        for length, got in found.items():
            runs = _intervals(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), length)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs[0]), length, dtype=np.int32)), *map(pa.array, runs)], ["length", "doc_id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last hash may go on
            if cut:
                yield from spans(t.slice(0, cut))
            held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if rows:
            yield from spans(pa.Table.from_batches(held))

    return arrow(contexts.repartition("h").sortWithinPartitions("h"), run, SPANS)


def _counted_spans(contexts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The same for hashes with very many rows: windows by digest, counted with a combining aggregation."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, p, most, least, data in zip(*(b[c].to_pylist() for c in ("doc_id", "p", "most", "least", "bytes")), strict=True):
                for length in lengths:
                    keys = [hashlib.blake2b(data[k : k + length], digest_size=16).digest() for k in range(min(most - least, len(data) - length) + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([length] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array([doc] * len(keys), pa.int64()), pa.array(range(p - most, p - most + len(keys)), pa.int64())], ["length", "key", "doc_id", "a"])

    # rows of equal bytes have only repeated windows; one row of each kind is cut into windows
    by = ["kind", "most", "least"]
    marked = contexts.withColumn("kind", F.unhex(F.sha2("bytes", 256)))
    kinds = saved(marked.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "p")).alias("one")), "counts")
    marked = saved(spread_join(marked, kinds, by, marked.count()).withColumn("is_one", F.struct("doc_id", "p") == F.col("one")), "kinds")
    end = F.col("p") - F.col("most") + F.length("bytes")
    whole = marked.where("n > 1").select(F.explode(F.array(*map(F.lit, lengths))).alias("length"), "doc_id", (F.col("p") - F.col("most")).alias("a"), (F.col("p") - F.col("least")).alias("z"), end.alias("end"))
    whole = whole.select("length", "doc_id", "a", F.least("end", F.col("z") + F.col("length")).alias("b")).where("b - a >= length")
    rows = saved(arrow(marked.where("is_one").select("doc_id", "p", "most", "least", "bytes"), windows, "length int, key binary, doc_id long, a long"), "windows")
    more = rows.groupBy("length", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return whole.unionByName(rows.join(more, ["length", "key"], "left_semi").select("length", "doc_id", "a", (F.col("a") + F.col("length")).alias("b")))


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, gram: int | None = None, bucket_rows: int = BUCKET_ROWS, with_text: bool = False, keep: list[str] | None = None, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    And n_passage_bytes (the bytes that repeated strings of passage bytes cover; nothing is removed for them) if passage;
    kept_text (its remaining bytes, broken characters dropped) if with_text; own (a struct of the columns keep) if keep.
    """
    shortest = min(length, passage or length)
    lengths = (length,) if passage in (None, length) else (length, passage)
    gram = gram or min(GRAM, max(1, shortest * 2 // 5))
    if not 0 < gram <= shortest <= max(lengths) < 1 << 15:
        raise ValueError("gram must be from 1 to the shortest length, and lengths below 32768")
    own = [F.struct(*keep).alias("own")] if keep else []
    docs, is_id = numbered(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), *own), "id", "doc_id")
    scan = saved(_scan(docs.select("doc_id", "text"), shortest, gram), "anchors")
    classes = saved(scan.groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "sha")
    places = scan.where(F.size("h") > 0).join(reps, ["doc_id", "sha"], "left_semi").select("doc_id", F.explode(F.arrays_zip("h", "place")).alias("x")).select("doc_id", "x.h", "x.place")
    places = saved(places, "places")
    counts = saved(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    found = saved(spread_join(places, counts, ["h"], places.count()).groupBy("doc_id").agg(F.collect_list(F.struct("h", "place", "n")).alias("found")), "found")
    texts = only(docs.select("doc_id", "text"), found.select("doc_id"), "doc_id").join(found, "doc_id")
    contexts = _contexts(texts.select("doc_id", "text", "found"), max(lengths))
    if counts.where(F.col("n") > bucket_rows).limit(1).count():
        contexts = saved(contexts, "contexts")
        spans = _sorted_spans(contexts.where(F.col("n") <= bucket_rows).drop("n"), lengths).unionByName(_counted_spans(contexts.where(F.col("n") > bucket_rows).drop("n"), lengths))
    else:
        spans = _sorted_spans(contexts.drop("n"), lengths)
    spans = saved(spans.groupBy("doc_id").agg(F.collect_list(F.struct("length", "a", "b")).alias("spans")), "spans")
    discard(places, counts, found, contexts)
    out = _rest(docs.select("doc_id", "text"), scan.select("doc_id", "n_bytes", "sha"), classes, spans, length, passage, with_text)
    # one row of docs to each row
    extra = ["text"] * with_text + ["own"] * bool(keep)
    if extra or not is_id:
        out = out.join(docs.select("doc_id", "id", *extra), "doc_id").withColumn("doc_id", F.col("id")).drop("id")
    if with_text:
        out = out.withColumn("kept_text", F.coalesce("cut_text", F.col("text"), F.lit(""))).drop("cut_text", "text")
    return out


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that don't touch, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def _rest(docs: DataFrame, scan: DataFrame, classes: DataFrame, spans: DataFrame, length: int, passage: int | None, with_text: bool) -> DataFrame:
    gone = hashlib.sha256(b"").hexdigest()
    copies = classes.where("n > 1").drop("rep")
    rows = spread_join(scan, copies, ["sha", "n_bytes"], scan.count(), "left").select("doc_id", "n_bytes", "sha", F.col("n").isNotNull().alias("copied"))
    cut = only(docs, spans.select("doc_id"), "doc_id").join(spans, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, found in zip(b["doc_id"].to_pylist(), B.texts_of(b["text"]), b["spans"].to_pylist(), strict=True):
                own = _merged([(x["a"], x["b"]) for x in found if x["length"] == length])
                covered = sum(z - a for a, z in _merged([(x["a"], x["b"]) for x in found if x["length"] == passage]))
                edges = [0, *(e for r in own for e in r), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, sum(z - a for a, z in own), len(own), covered, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)], ["doc_id", "removed", "spans", "covered", "kept_sha", "kept"])

    cut = arrow(cut.select("doc_id", "text", "spans"), run, "doc_id long, removed long, spans long, covered long, kept_sha string, kept string")
    all_ = rows.join(cut, "doc_id", "left")
    whole = F.col("copied") & (F.col("n_bytes") >= length)
    none = F.lit(0)
    return all_.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", none)).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", none)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(gone)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        *([F.when(F.col("copied") & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("covered", none)).cast("long").alias("n_passage_bytes")] if passage else []),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("cut_text")] if with_text else []),
    )
