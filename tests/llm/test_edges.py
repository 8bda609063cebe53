"""Null, empty and very long texts, null and shared ids, repeated rows, ties, clashing columns and empty tables, for all ten operators."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import chat, decontaminate, jpeg, language, media, minhash, packing, quality, repair, suffix, warc
from loomspark.llm.queries import vocabulary
from loomspark.llm.tokens import PieceEncoder

#: Names of columns that operators use inside.
CLASHES = ("n", "h", "k", "t", "a", "b", "key", "sig", "row", "part", "own", "span", "place", "spans", "media", "first", "piece", "start", "length", "tokens", "lang_pred", "sequence_id", "quality_score", "component_id", "payload", "record_type", "n_words", "hits", "sha", "c", "pos")
LONG = " ".join(f"word{i % 5003}x{i % 7}" for i in range(40_000))
ROWS = [(1, "a plain text of seven whole words"), (1, "a plain text of seven whole words"), (2, None), (3, ""), (4, "  \n\t"), (None, "no id but some words are here"), (None, "no id but some words are here"), (None, None), (5, LONG), (6, "Ünïcode wörds ÀÉÎ ñandú straße"), (7, "a plain text of seven whole words"), (8, "12 345 -- 6")]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t, "en" if t else None) for i, t in ROWS], "doc_id long, text string, lang string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_media(rows):
    got = counted(media.inspect(media.encode_videos(rows)), "doc_id", "n_bytes", "payload_sha256")
    padded = lambda raw: raw + b"\0" * (-len(raw) % 64 if raw else 64)
    assert got == Counter((i, len((t or "").encode()), hashlib.sha256(padded((t or "").encode())).hexdigest()) for i, t in ROWS)
    assert media.inspect(media.encode_videos(rows.where("false"))).count() == 0
    assert media.clips(media.encode_videos(rows)).select("doc_id").distinct().count() == 9
    for bad in (b"", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xda\0\2\xff\xd9", b"\xff\xd8\xff\xc0\0\x11\x0c" + bytes(14) + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError)):
            jpeg.parse(bad)


def test_decontaminate(spark, rows):
    bench = spark.createDataFrame([(1, "seven WHOLE words"), (1, "seven whole words"), (2, None), (None, "wörds"), (3, "word17x1 word18x2 word19x3 word20x4 word21x5 word22x6 word23x0 word24x1 word25x2 word26x3 word27x4")], "item_id long, text string").withColumn("n", F.lit(1))
    unique = rows.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in decontaminate.contamination(unique, bench).collect()}
    assert {i: r["n_hit"] for i, r in got.items()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: got[5]["n_hit"], 6: 1, 7: 3, 8: 0} and got[5]["n_hit"] >= 11
    assert got[1]["n_items"] == 1 and got[2]["n_words"] == 0 and got[5]["n_words"] == 40_000
    left = decontaminate.remove(unique, bench)
    assert left.columns == unique.columns and left.where("hits = 'clash' and n = 'clash'").count() == left.count()
    text = {r["doc_id"]: r["text"] for r in left.collect()}
    assert text[1] == "a plain text of " and text[2] is None and text[3] == "" and len(text[5].split()) == 40_000 - got[5]["n_hit"]
    assert decontaminate.contamination(rows.where("false"), bench).count() == 0 and decontaminate.remove(rows.where("false"), bench).count() == 0


def test_one_text_with_very_many_hits(spark):
    bench = spark.createDataFrame([(1, "hit me")], "item_id long, text string")
    text = "keep this; hit me, " * 30_000
    docs = spark.createDataFrame([(1, text), (2, "hit me")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect()} == {(1, 60_000), (2, 2)}
    assert [r["text"].split() for r in decontaminate.remove(docs, bench).collect()] == [["keep", "this;"] * 30_000]


def test_suffix(rows):
    got = counted(suffix.remove_repeats(rows, length=20), "doc_id", "n_bytes", "n_removed", "n_spans")
    raw = [(i, (t or "").encode()) for i, t in ROWS]
    windows = Counter(t[k : k + 20] for _, t in raw for k in range(len(t) - 19))
    want = Counter()
    for i, t in raw:
        gone = np.zeros(len(t) + 20, dtype=bool)
        for k in range(len(t) - 19):
            if windows[t[k : k + 20]] > 1:
                gone[k : k + 20] = True
        want[i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum())] += 1
    assert got == want
    kept = suffix.remove_repeats(rows, length=20, with_text=True, keep=["n", "h", "spans"])
    assert kept.where("own.spans = 'clash'").count() == len(ROWS) and suffix.remove_repeats(rows.where("false"), with_text=True).count() == 0


def test_minhash(rows):
    got = counted(minhash.near_duplicates(rows), "doc_id", "n_shingles", "component_id", "kept")
    n = {1: 3, 2: 0, 3: 0, 4: 0, 5: len({tuple(LONG.split()[k : k + 5]) for k in range(39_996)}), 6: 1, 7: 3, 8: 1}
    root = {i: i for i in n} | {7: 1}
    want = Counter((i, n[i], root[i], root[i] == i) for i, _ in ROWS if i is not None)
    assert Counter({k: v for k, v in got.items() if k[0] is not None}) == want
    assert sum(v for k, v in got.items() if k[0] is None) == 3
    assert minhash.near_duplicates(rows.where("false")).count() == 0


def test_language_and_quality(spark, rows):
    model = language.fit(rows)
    got = language.identify(rows, model, keep=["doc_id", "n"]).collect()
    assert len(got) == len(ROWS) and Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ROWS)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4, 5, 8)} == {1: "en", 2: "und", 3: "und", 4: "und", 5: "en", 8: "und"}
    assert language.identify(rows.where("false"), model).count() == 0 and language.fit(rows.where("false")).labels == ()
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (5, 1), (None, 1), (99, 0), (6, 7), (7, None)], "doc_id long, label int")
    scored = quality.score(rows, quality.fit_labels(rows, labels), keep=["doc_id", "text"]).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["quality_score"] <= 1 for r in scored)
    by = defaultdict(set)
    for r in scored:
        by[r["text"] or ""].add(r["quality_score"])
    assert all(len(x) == 1 for x in by.values())
    assert quality.score(rows.where("false"), quality.fit_labels(rows.where("false"), labels)).count() == 0


def test_warc(rows):
    pages = rows.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit(None).cast("string"))
    got = counted(warc.read_archives(warc.write_archives(pages)), "page_id", "payload_digest")
    assert got == Counter((i, warc.digest((t or "").encode())) for i, t in ROWS)


def test_chat(spark, rows):
    turns = rows.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), "text", *[c for c in CLASHES])
    got = defaultdict(list)
    for r in chat.read_back(chat.windows(turns)).orderBy("first_turn").collect():
        got[r["conv_id"]] += [t["text"] for t in r["turns"]]
    want = defaultdict(list)
    for i, t in ROWS:
        want[i].append(t or "")
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    one = spark.createDataFrame([(1, t, "user", "x" * 40, 400) for t in range(5)], "conv_id long, turn long, role string, text string, own_tokens int")
    assert [r["n_tokens"] for r in chat.windows(one, tokens="own_tokens").orderBy("first_turn").collect()] == [400] * 5


def test_token_shards(rows):
    path = vocabulary("word_bpe_49k.json")
    e = PieceEncoder(path, False)
    crc = lambda t: zlib.crc32(np.append(e.whole(t or ""), 2).astype("<u4").tobytes())
    for size in (50, 1_000_000):
        got = repair.read_shards(repair.write_shards(rows, path, shard_ids=size)).orderBy("start").collect()
        assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i or 0, crc(t)) for i, t in ROWS)
        assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert repair.read_shards(repair.write_shards(rows.where("false"), path)).count() == 0


def test_packing(rows):
    got = packing.pack(rows, vocabulary("byte_bpe_50k.json")).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in ROWS)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *[n for _, n in sorted(b)]])[:-1].tolist() and sum(n for _, n in b) <= 2048
