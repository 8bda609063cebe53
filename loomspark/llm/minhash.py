"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts whose shingle sets are equal are one class from the start; its smallest id stands for it. Each representative
has a signature of COORDINATES minima. A pair at the similarity threshold agrees on at least MIN_MATCHES of them
(but for a chance of 1.46e-5), so it agrees on one of the first COORDINATES - MIN_MATCHES + 1: only that prefix is
posted under (coordinate, value), and the coordinates after it are skipped in the lists and read from the signatures.

The pairs of a list are never written out. First, each list is tied to its smallest id: these star pairs are counted,
those with enough matches are confirmed on the full sets, and components are formed. Lists that lie in one
component are then done, as are all large groups of true copies. In the rest, pairs from different components are
matched inside the task and only those with enough matches leave it; in lists of more than BINNED_ROWS these are also
compared by one-permutation bins, which for such set sizes are close to the sets themselves; a linked pair is below the
bound there with a chance of about 3.4e-6 (normal tail), so a pair at just the threshold is dropped with a chance of at
most about 1.8e-5 in all. They are confirmed too. The texts of a list longer than LIST_ROWS, such as that of a line that
very many texts hold, are matched over their rarest shingles instead, of which linked texts must share one; a list by
shingle that is longer still is dealt into blocks whose pairs are lists of their own. No list is cut or left out. Links
that are confirmed connect exactly the components of the full similarity graph.

Defined cases: words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer than five words
has its whole sequence as its one shingle; a null, empty or blank text has none and is linked with nothing; repeated
rows are equal sets and each keeps its row. Ids are integers; rows that share an id are one node of the graph, and a null
id has no component. A very long text is one set, held whole by one task; an empty table gives no rows; of equal minima
and counts the smallest id leads. Other columns are not read. Words and shingles are held by 64-bit hashes (words of over
LONG_WORD bytes by a keyed digest).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm import bytetext as B
from loomspark.llm.frames import arrow, only, spread_join
from loomspark.operators.components import connected_components
from loomspark.plans.shared import discard, saved

SHINGLE = 5
COORDINATES = 64
MIN_MATCHES = 33
PERCENT = 75
#: Coordinates that are posted.
PREFIX = COORDINATES - MIN_MATCHES + 1
#: Numbers of a packed signature.
WIDTH = PREFIX + (COORDINATES - PREFIX) // 2
LIST_ROWS = 2000
#: Rows of a list from which pairs are also compared by bins, the number of bins, and how many deviations below its mean a linked pair may lie.
BINNED_ROWS = 16
BINS = 512
DEVIATIONS = 4.5
_SEEDS = B.words_from(11, COORDINATES)
_ODD = B.words_from(13, COORDINATES) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for i, j in B.blocks(texts):
        h, at = B.Words(texts[i:j]).shingles(SHINGLE)
        out += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES 32-bit minima for each non-empty set, in order."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), COORDINATES), dtype=np.uint32)
    if not full:
        return out
    h = np.concatenate(full)
    at = np.cumsum([0, *map(len, full)])[:-1]
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((h ^ _SEEDS[k]) * _ODD[k], at) >> np.uint64(32)
    return out


def packed(sig: np.ndarray) -> np.ndarray:
    """Signatures as they are stored: PREFIX whole minima, which name lists, then 16 bits of each later one, two to a number."""
    return np.concatenate([sig[:, :PREFIX], (sig[:, PREFIX:] & 0xFFFF).astype(np.uint16).view(np.uint32)], axis=1)


def binned(s: np.ndarray) -> bytes:
    """Four bits for each BINS-th part of the hash range: 0 if the sorted set has nothing there, else a digest of its least hash there.

    Equal least hashes have equal digests, so a pair shows at least as many equal parts as it has.
    """
    out = np.zeros(BINS, dtype=np.uint8)
    part = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    out[part[first]] = 1 + s[first] % np.uint64(15)
    return (out[::2] | out[1::2] << 4).tobytes()


def sketch(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, set_key (null: empty set), sig (packed, an array of ints), bins (half of BINS bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = B.texts_of(b["text"]), b["doc_id"]
            for i, j in B.blocks(texts):
                sets = shingle_sets(texts[i:j])
                sig = iter(packed(signatures(sets)).view(np.int32))
                sigs = [next(sig) if len(s) else None for s in sets]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array([binned(s) for s in sets], pa.binary())], ["doc_id", "n_shingles", "set_key", "sig", "bins"])

    return arrow(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_shingles long, set_key binary, sig array<int>, bins binary")


def _lengths_fit(a: str, b: str) -> F.Column:
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def _star_pairs(postings: DataFrame, leads: DataFrame, rows: int, reps: DataFrame) -> DataFrame:
    """Each list's members with its smallest id, where lengths and the number of equal coordinates allow a link."""
    pairs = spread_join(postings, leads, ["key"], rows).where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    equal = lambda start, n, test: F.expr(f"aggregate(zip_with(slice(sa, {start}, {n}), slice(sb, {start}, {n}), (x, y) -> {test}), 0, (s, v) -> s + v)")
    same = equal(1, PREFIX, "if(x = y, 1, 0)") + equal(PREFIX + 1, WIDTH - PREFIX, "if(x & 65535 = y & 65535, 1, 0) + if(shiftrightunsigned(x, 16) = shiftrightunsigned(y, 16), 1, 0)")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_lengths_fit("na", "nb")).where(same >= MIN_MATCHES).select("a", "b")


def _matches(rows: dict[str, np.ndarray], at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each group (at: where groups begin) that may be linked and lie in different components."""
    comp, n, head, tail, coord, mask, has, rank, bins, side = (rows[c] for c in ("comp", "n_shingles", "head", "tail", "coord", "mask", "has", "rank", "bins", "side"))

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] < 0)) & (100 * n[i] >= PERCENT * n[j]) & (100 * n[j] >= PERCENT * n[i])
        i, j = i[ok], j[ok]
        same = head[i] == head[j]
        ok = same.sum(1) + (tail[i] == tail[j]).sum(1) >= MIN_MATCHES
        i, j, same = i[ok], j[ok], same[ok]
        # a pair is for the first short list that it shares, and for lists by shingle only if it shares none
        same &= ((mask[i][:, None] >> np.arange(PREFIX)) & 1) == 0
        ok = np.where(coord[i] < 0, ~same.any(1), same.any(1) & (same.argmax(1) == coord[i]))
        i, j = i[ok], j[ok]
        at = np.flatnonzero(has[i] & has[j])
        if len(at):
            x, y = bins[rank[i[at]]], bins[rank[j[at]]]
            m = ((x | y) != 0).sum(1)
            # linked: the union has at most this many shingles, of which the bins show m
            union = (n[i[at]] + n[j[at]]) * 100 / (100 + PERCENT)
            p = PERCENT / 100
            spread = np.sqrt(p * (1 - p) * m * np.clip((union - m) / np.maximum(union - 1, 1), 0, 1))
            bad = ((x == y) & (x != 0)).sum(1) < p * m - DEVIATIONS * spread - 1e-9
            ok = np.ones(len(i), dtype=bool)
            ok[at[bad]] = False
            i, j = i[ok], j[ok]
        return i, j

    sizes = np.diff(at)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 64)]):
        first = at[:-1][sizes == size]
        x, y = np.triu_indices(int(size), 1)
        step = max(1, 200_000 // len(x))
        for s in range(0, len(first), step):
            part = first[s : s + step, None]
            yield fit((part + x).ravel(), (part + y).ravel())
    for k in np.flatnonzero(sizes > 64):
        for i in range(at[k], at[k + 1]):
            j = np.arange(i + 1, at[k + 1])
            yield fit(np.full(len(j), i), j)


def _cross_pairs(lists: DataFrame) -> DataFrame:
    """lists: key, coord (-1: by shingle), mask (coordinates with long lists), side (-1: all of a list's rows meet; else only rows of different sides), doc_id, comp, n_shingles, sig, bins.

    Pairs of different components that share a list and enough coordinates.
    """

    def pairs(part: pa.Table) -> pa.RecordBatch:
        key = part["key"].to_numpy()
        rows = {c: part[c].to_numpy() for c in ("doc_id", "comp", "n_shingles", "coord", "mask", "side")}
        sig = np.concatenate([c.flatten().to_numpy() for c in part["sig"].chunks]).reshape(len(key), WIDTH)
        rows["head"], rows["tail"] = sig[:, :PREFIX], np.ascontiguousarray(sig[:, PREFIX:]).view(np.uint16)
        got = [x for x in part["bins"].to_pylist() if x is not None]
        rows["has"] = ~np.asarray(part["bins"].is_null())
        rows["rank"] = np.cumsum(rows["has"]) - 1
        half = np.frombuffer(b"".join(got), dtype=np.uint8).reshape(len(got), BINS // 2)
        rows["bins"] = np.concatenate([half & 15, half >> 4], axis=1)
        at = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key))
        found = {(int(min(p)), int(max(p))) for i, j in _matches(rows, at) for p in zip(rows["doc_id"][i], rows["doc_id"][j], strict=True)}
        out = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
            if cut:
                yield pairs(t.slice(0, cut))
            held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if rows:
            yield pairs(pa.Table.from_batches(held))

    return arrow(lists.repartition("key").sortWithinPartitions("key"), run, "a long, b long").distinct()


def _parted(rows: DataFrame, counts: DataFrame, list_rows: int, total: int) -> DataFrame:
    """rows (key, doc_id) in lists of about list_rows rows at most twice: a longer list is dealt into blocks, and each two blocks are a list of two sides.

    counts: key and n; total: the sum of n at most. Every pair of a list's rows meets in one task, whatever the list's size.
    """
    parts = F.ceil(F.col("n") / list_rows).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    met = spread_join(rows, counts, ["key"], total).withColumn("parts", parts).withColumn("own", own)
    met = met.withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    key = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise((F.col("own") > F.col("other")).cast("int"))
    return met.select(key.alias("key"), side.alias("side"), "doc_id")


def _rare_lists(long: DataFrame, docs: DataFrame, list_rows: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Lists by shingle for the texts of long coordinate lists, whatever made those long, and the saved tables behind them.

    A text of n shingles shares at least PERCENT of them with any that it is linked with; so if all order their shingles
    from rare to common, the two agree on one of the first n - ceil(PERCENT * n / 100) + 1. Only these are posted.
    Shingles that no other text has come first in that order and tie nothing: they are counted, not sorted. Signatures
    and bins join when it is known which lists hold several components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = B.texts_of(b["text"]), b["doc_id"].to_numpy()
            for i, j in B.blocks(texts):
                sets = shingle_sets(texts[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(ids[i:j], [len(s) for s in sets]))], ["key", "doc_id"])

    texts = only(docs, long.select("doc_id"), "doc_id").dropDuplicates(["doc_id"])
    shingles = saved(arrow(texts.select("doc_id", "text"), run, "key long, doc_id long"), "shingles")
    often = saved(shingles.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
    of_text = Window.partitionBy("doc_id")
    n = F.col("n_shingles")
    shared = spread_join(shingles, often, ["key"], shingles.count()).withColumn("place", F.row_number().over(of_text.orderBy("n", "key"))).withColumn("shared", F.count("*").over(of_text))
    first = F.col("place") + n - F.col("shared") <= n - F.ceil(n * PERCENT / 100) + 1
    posted = saved(shared.join(long.select("doc_id", "comp", "n_shingles"), "doc_id").where(first).select("key", "doc_id", "comp"), "rare")
    mixed = saved(_mixed(posted), "mixed")
    return _parted(posted.select("key", "doc_id"), mixed, list_rows, posted.count()).join(long, "doc_id"), (shingles, often, posted, mixed)


def _mixed(lists: DataFrame) -> DataFrame:
    """key and n (rows) of the lists (key, comp) that hold several components."""
    return lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets meet the threshold. Texts reach them by two equi-joins, whose large keys AQE splits."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = only(docs, ids, "doc_id")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b, ta = batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ta"]
            sets = shingle_sets(B.texts_of(batch["tb"]))
            keep = []
            for k, (x, s) in enumerate(zip(a, sets, strict=True)):
                if x != last:
                    last, last_set = x, shingle_sets([(ta[k].as_py() or "").encode()])[0]
                both = np.concatenate([last_set, s])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common and 100 * common >= PERCENT * (len(both) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return arrow(both, run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept, of every row."""
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = saved(sketch(docs), "sketch")
    classes = sketches.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = saved(sketches.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").where("sig is not null").select("doc_id", "n_shingles", "sig", "bins"), "reps")
    postings = reps.select("doc_id", F.posexplode(F.slice("sig", 1, PREFIX)).alias("k", "v")).select("doc_id", _key("k", "v").alias("key"))
    leads = saved(postings.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1"), "leads")
    postings = saved(spread_join(postings, leads, ["key"], PREFIX * reps.count()).select("doc_id", "key"), "lists")
    rows = postings.count()

    stars = saved(_star_pairs(postings, leads, rows, reps), "stars")
    links = saved(_confirmed(stars, docs), "links")
    comp = saved(connected_components(links, "a", "b"), "components")

    labelled = postings.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    labelled = saved(labelled, "labelled")
    mixed = saved(_mixed(labelled), "mixed")
    # of each text, its short lists (at most PREFIX) and which of its coordinates have long ones
    is_long = F.col("n") > list_rows
    bit = F.expr("shiftleft(1L, cast(shiftright(key, 32) as int))")
    of_text = spread_join(labelled, mixed, ["key"], rows).groupBy("doc_id").agg(F.min("comp").alias("comp"), F.coalesce(F.bit_or(F.when(is_long, bit)), F.lit(0).cast("long")).alias("mask"), F.collect_list(F.when(~is_long, F.struct("key", "n"))).alias("lists"))
    members = saved(of_text.join(reps, "doc_id"), "members")
    discard(postings, reps, leads, labelled, mixed)
    long = members.where("mask <> 0").drop("lists")
    short = members.select(F.explode("lists").alias("list"), "mask", "doc_id", "comp", "n_shingles", "sig", "bins")
    short = short.select("list.key", F.shiftright("list.key", 32).cast("int").alias("coord"), "mask", F.lit(-1).alias("side"), "doc_id", "comp", "n_shingles", "sig", F.when(F.col("list.n") > BINNED_ROWS, F.col("bins")).alias("bins"))
    rare, behind = _rare_lists(long, docs, list_rows)
    rare = rare.select("key", F.lit(-1).alias("coord"), "mask", "side", "doc_id", "comp", "n_shingles", "sig", "bins")
    pairs = _cross_pairs(short.unionByName(rare)).join(stars, ["a", "b"], "left_anti")
    pairs = saved(pairs, "pairs")
    discard(members, *behind)
    more = saved(_confirmed(pairs, docs), "links")
    # components of the first links are joined by the later ones
    final = connected_components(links.unionByName(more), "a", "b").withColumnRenamed("node", "rep")
    discard(links, more, pairs, stars, comp)
    of_class = classes.join(final, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _key(k: str, v: str) -> F.Column:
    return F.shiftleft(F.col(k).cast("long"), 32).bitwiseOR(F.col(v).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
