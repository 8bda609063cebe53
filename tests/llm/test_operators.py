import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import chat, decontaminate, deepshallow, language, media, minhash, packing, quality, repair, suffix, warc
from loomspark.llm.queries import vocabulary
from loomspark.llm.tokens import PieceEncoder

DOCS = "doc_id long, text string, lang string, extra string"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def corpus(seed=1, n=60):
    """Null, empty, blank, short, repeated, near and very long texts, and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = text(120), text(8)
    out = [None, "", "  \n", "One", "one two", "ONE  two", "ab " * 400, "ab " * 400, text(20000)]
    while len(out) < n:
        kind = rng.randint(0, 5)
        if kind == 0:
            out.append(rng.choice(out))
        elif kind == 1 and (old := rng.choice(out)):
            w = old.split(" ")
            w[rng.randrange(len(w))] = "zzz"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(text(rng.randint(0, 40)) + passage + "\n" + text(rng.randint(0, 40)))
        elif kind == 3:
            out.append(line + "\n" + text(rng.randint(1, 9)))
        else:
            out.append(text(rng.randint(1, 90)))
    return out


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], DOCS)


def words5(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("list_rows", [3, 2000])
def test_minhash_against_brute_force(spark, list_rows):
    texts = corpus(2, 90)
    sets = [words5(t) for t in texts]
    root = list(range(len(texts)))
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    for _ in texts:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, texts), list_rows=list_rows).collect()}
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


def test_minhash_parts_of_a_list(spark):
    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(30 * k)], "key long, doc_id long")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    lists = defaultdict(list)
    for r in minhash._parted(rows, counts, 10, 90).collect():
        lists[r["key"]].append((r["side"], r["doc_id"]))
    met = {(min(a, b), max(a, b)) for x in lists.values() for p, a in x for q, b in x if a != b and (p != q or p < 0)}
    assert met == {(a, b) for a in range(60) for b in range(a + 1, 60)}
    assert max(map(len, lists.values())) < 50


def test_minhash_empty_table(spark):
    assert minhash.near_duplicates(docs(spark, ["a"]).where("false")).count() == 0


@pytest.mark.parametrize(("length", "bucket_rows"), [(40, 100000), (40, 2), (400, 100000)])
def test_suffix_against_brute_force(spark, length, bucket_rows):
    texts = corpus(3, 70)
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    want = {}
    for i, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        spans = int(flags[:1].sum() + (np.diff(flags.astype(int)) == 1).sum())
        want[i] = (len(t), int(flags.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~flags])).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.remove_repeats(docs(spark, texts), length=length, bucket_rows=bucket_rows).collect()}
    assert got == want
    for passage in (length // 2, length * 2):
        two = {r["doc_id"]: tuple(r)[1:] for r in suffix.remove_repeats(docs(spark, texts), length=length, passage=passage, bucket_rows=bucket_rows).collect()}
        assert {i: r[:4] for i, r in two.items()} == want
        other = {r["doc_id"]: r["n_removed"] for r in suffix.remove_repeats(docs(spark, texts), length=passage).collect()}
        assert {i: r[4] for i, r in two.items()} == other
    kept = {r["doc_id"]: r["kept_text"] for r in suffix.remove_repeats(docs(spark, texts), length=length, with_text=True).collect()}
    assert all(hashlib.sha256(kept[i].encode()).hexdigest() == want[i][3] for i in kept if (texts[i] or "").isascii())
    assert suffix.remove_repeats(docs(spark, texts).where("false")).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(1)
    for _ in range(100):
        base = bytes(rng.choice(b"ab") for _ in range(80))
        rows = [base[: rng.randint(0, 80)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 50))]
        bucket = np.array([rng.randint(-1, 2) for _ in rows], dtype=np.int64)
        order, lcp = deepshallow.deep_shallow_sort(bucket, rows, 16)
        got = [(bucket[i], rows[i]) for i in order]
        assert got == sorted(got)
        for k in range(1, len(got)):
            assert lcp[k] == (-1 if got[k][0] != got[k - 1][0] else deepshallow.common_prefix(got[k][1], got[k - 1][1]))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["Ab", "cd", "éf", "GH", "ΣΑΣ", "k1", "x"]
    items = [(i, t) for i, t in enumerate([None, "", "...", "k1 only-three words", "GH", *[" ".join(rng.choice(vocab) for _ in range(rng.randint(2, 14))) for _ in range(12)]] + ["same ab cd x", "same ab cd x"])]
    texts = [None, "", "--"] + [" ,".join(rng.choice([*vocab, "ab", "gh", "σας", "zz"]) for _ in range(rng.randint(1, 80))) for _ in range(40)] + [(items[9][1] or "").upper(), "k1 ONLY, three words; same ab cd x" + " pad" * 9000]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = find(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = {}
    for i, t in enumerate(texts):
        w, hit, ids = find(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    ids |= windows[tuple(w[k : k + size])]
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert got == want
    clean = decontaminate.remove(docs(spark, texts), bench)
    assert clean.columns == docs(spark, texts).columns
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(left[i] == texts[i] for i, w in want.items() if not w[4])
    assert set(left) == {i for i, w in want.items() if w[1] <= 0.5 * max(w[0], 1)}
    assert left[len(texts) - 1].split() == ["pad"] * 9000
    assert {r["doc_id"] for r in decontaminate.remove(docs(spark, texts), bench, mode="documents").collect()} == {i for i, w in want.items() if not w[4]}
    assert decontaminate.contamination(docs(spark, texts), bench.where("false")).where("contaminated").count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "[", "<\\s>", "<<SYS>>", "a", "é", "\n", "</s", "<|im_end|>"]
    turns = []
    for c in range(25):
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", None if c == 3 else "user"])
            turns.append((c, t, role, None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))))
    turns += [(None, 0, "assistant", "x"), (99, 0, "user", "long " * 3000), (99, 1, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    w = chat.windows(df, budget=64)
    got = defaultdict(list)
    for r in chat.read_back(w).orderBy("conv_id", "first_turn").collect():
        got[r["conv_id"]].append(r)
    by = defaultdict(list)
    for c, _, role, text in turns:
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        assert [(x["role"], x["text"]) for r in got[c] for x in r["turns"]] == rows
        assert "".join(r["loss_text"] for r in got[c]) == "".join(t for role, t in rows if role == "assistant")
    for r in w.collect():
        assert r["n_tokens"] <= 64 or (r["n_turns"] == 1 and not r["n_repeated"])
    assert any(r["n_repeated"] for r in w.collect())
    assert chat.windows(df.where("false")).count() == 0


def test_chat_budget(spark):
    turns, system = [], {}
    for c, n in enumerate((0, 40, 100, 130, 180, 200, 230, 300)):
        system[c] = n
        turns += [(c, 0, "system", "s" * max(4 * n - 17, 0))] + [(c, t, "assistant" if t % 2 else "user", "x" * (37 * t % 150 + 4 * 70 * (t == 9))) for t in range(1, 25)]
    turns.append((99, 0, "user", "long " * 3000))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    w = chat.windows(df, budget=256)
    rows = w.collect()
    assert all(r["n_tokens"] <= 256 or (r["n_turns"] == 1 and not r["n_repeated"]) for r in rows)
    # a system turn that leaves room goes before all later spans that it fits with
    for r in rows:
        if r["first_turn"] > 0 and system[r["conv_id"]] <= 180 and r["n_turns"] > 1:
            assert r["formatted"].startswith("<s>system")
    read = sorted((r["conv_id"], r["first_turn"], [tuple(t) for t in r["turns"]]) for r in chat.read_back(w).collect())
    assert [(c, *t) for c, _, own in read for t in own] == [(c, role, text) for c, _, role, text in sorted(turns)]


def test_chat_repeated_rows_and_ranges_of_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHAPTER", 7)
    monkeypatch.setattr(chat, "SPANS_AT_ONCE", 2)
    rows = [(1, t, "system" if t == 3 else "assistant" if t % 2 else "user", f"turn {t} " * (t % 5)) for t in range(60)] + [(2, 5, "assistant", "same")] * 6 + [(2, None, "user", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, first string")
    w = chat.windows(df, budget=64)
    read = chat.read_back(w).orderBy("conv_id", "first_turn").collect()
    for c in (1, 2):
        want = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1]))]
        assert [tuple(t) for r in read if r["conv_id"] == c for t in r["turns"]] == want
        assert "".join(r["loss_text"] for r in read if r["conv_id"] == c) == "".join(t for role, t in want if role == "assistant")
    got = w.collect()
    assert all(r["n_tokens"] <= 64 for r in got)
    assert all(r["formatted"].startswith("<s>system[/INST]") for r in got if r["conv_id"] == 1 and r["first_turn"] > 3)
    assert sum(r["n_repeated"] > 1 for r in got) > 3


def test_media_round_trip(spark):
    texts = corpus(5, 25)
    videos = media.encode_videos(docs(spark, texts))
    got = {r["doc_id"]: r for r in media.inspect(videos).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.clips(videos).where("start_ms >= end_ms").count() == 0
    x = np.zeros((30, 32, 64), dtype=np.uint8)
    x[10:20] = 200
    assert media.shots(x) == [(0, 9), (10, 19), (20, 29)]
    frames = media.encode_frames(np.random.default_rng(0).integers(0, 256, (3, 32, 64), dtype=np.uint8))
    assert np.array_equal(media.decode_frames(frames), np.random.default_rng(0).integers(0, 256, (3, 32, 64), dtype=np.uint8))
    assert media.shots(x[9:11]) == [(0, 0), (1, 1)]
    for bad in (b"RIFF", media.write_avi(b"a" * 64)[:-40]):
        with pytest.raises(Exception):
            media.read_avi(bad)
    none = videos.limit(2).withColumn("media", F.lit(None).cast("binary"))
    assert [r["payload_sha256"] for r in media.inspect(none).collect()] == [None, None] and media.clips(none).count() == 0
    assert media.inspect(media.encode_videos(docs(spark, texts).where("false"))).count() == 0


@pytest.mark.parametrize("segment_bytes", [300, 32768])
def test_warc_round_trip(spark, segment_bytes):
    html = [None, "", "a", "a", "b" * 5000, "é" * 3000, "b" * 5000, "\r\n\r\n0\r\n"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, data int")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages, segment_bytes=segment_bytes)).collect()}
    last = {h or "": i for i, h in enumerate(html)}
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), got[i]
        first = last[h or ""]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), warc.digest(raw), "response" if first == i else "revisit", None if first == i else first)
        assert r["payload"] is None or bytes(r["payload"]) == raw
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
    with pytest.raises(ValueError, match="missing"):
        warc.reassemble([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(ValueError, match="bytes"):
        warc.reassemble([(1, None, b"a"), (2, 9, b"b")])


def test_warc_repeated_and_null_pages(spark):
    rows = [(1, "a" * 900), (1, "a" * 900), (2, "b"), (2, "b"), (2, "c"), (None, "d" * 900), (None, "d" * 900), (None, "e"), (5, "e"), (6, None)]
    pages = spark.createDataFrame([(i, "http://x/", h) for i, h in rows], "page_id long, url string, html string")
    want = Counter((i, warc.digest((h or "").encode())) for i, h in rows)
    for parts in (1, 6):
        archives = warc.write_archives(pages.repartition(parts), segment_bytes=300)
        got = warc.read_archives(archives).collect()
        assert Counter((r["page_id"], r["payload_digest"]) for r in got) == want
        whole = [r for r in got if r["record_type"] == "response"]
        assert len(whole) == len({r["payload_digest"] for r in got}) == len({r["payload_digest"] for r in whole})
        assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(1, 1), (2, 2), (None, None), (None, 5)}
        ids = [h["warc-record-id"] for r in archives.collect() for h, _ in warc.parse(bytes(r["data"]))]
        assert len(ids) == len(set(ids))


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_equal_whole_texts(name, spaced):
    rng = random.Random(8)
    texts = ["", " ", "a  <|endoftext|> b", "x  y", "\r\n\r\n a", *["".join(rng.choice(" \n\ta b.1é's　") for _ in range(rng.randint(0, 30))) for _ in range(400)]]
    e = PieceEncoder(vocabulary(name), spaced)
    ids, at = e.encode(texts)
    for k, x in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == x.ids


def test_token_shards(spark):
    texts = corpus(7, 60)
    e = PieceEncoder(vocabulary("word_bpe_49k.json"), False)
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = np.append(e.whole(t or ""), 2).astype("<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shards = repair.write_shards(docs(spark, texts), vocabulary("word_bpe_49k.json"), shard_ids=3000)
    assert {r["doc_id"]: tuple(r)[1:] for r in repair.read_shards(shards).collect()} == want
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 5, 3000), np.tile([7, 8, 9, 7], 900)]).astype(np.uint32)
    ends = np.array([1, 10, 3000, len(ids)])
    data = repair.write_shard(np.arange(4), ids, ends)
    s = repair.Shard(data)
    assert len(s.rules) and len(s.symbols) < len(ids) / 2
    assert np.array_equal(s.all()[0], ids)
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        assert np.array_equal(s.document(k), ids[a:b])
        assert np.array_equal(s.document(k, 3, 17), ids[a:b][3:17])


def test_packing(spark):
    texts = corpus(9, 80)
    path = vocabulary("byte_bpe_50k.json")
    e = PieceEncoder(path, True)
    rows = packing.pack(docs(spark, texts), path, capacity=256).orderBy("doc_id", "piece").collect()
    at, bins = defaultdict(int), defaultdict(list)
    own = {i: np.append(e.whole(t or ""), 0).astype("<u4") for i, t in enumerate(texts)}
    for r in rows:
        ids = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 256)
        at[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in own.items()}
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == list(np.cumsum([0, *[n for _, n in sorted(b)]])[:-1]) and sum(n for _, n in b) <= 256
    plan = packing.best_two_fit({6: 1, 5: 2, 3: 1, 2: 2, 4: 1}, 10)
    assert sum(n for _, n in plan) == 3 and Counter(x for b, n in plan for x in b * n) == Counter({6: 1, 5: 2, 3: 1, 2: 2, 4: 1})
    assert packing.best_two_fit({9: 1, 4: 1, 3: 2}, 10)[1][0] == [4, 3, 3]
    assert packing.pack(docs(spark, texts).where("false"), path).count() == 0


def test_language(spark):
    rng = random.Random(1)
    say = lambda syll: " ".join("".join(rng.choice(syll) for _ in range(3)) for _ in range(30))
    rows = [(i, say(["the", "ing", "and"]) if i % 2 else say(["sch", "ung", "ein"]), "en" if i % 2 else "de", "x") for i in range(200)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    test = spark.createDataFrame([(1, say(["the", "ing"]), None, ""), (2, say(["sch", "ein"]), None, ""), (3, None, "en", ""), (4, "12 -- \n", "de", ""), (5, "", "de", "")], DOCS)
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.identify(test, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[1][1] > 0.5 and got[3][1] == 0
    none = language.fit(test.where("lang is null and text is null"))
    assert {r["lang_pred"] for r in language.identify(test, none).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "sea", "was", "calm", "and", "wide"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["the", "sea", "%%%", "***", "BUY"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), 1 if i % 3 else 0) for i in range(240)] + [(900, None, None), (901, "a", 7)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    texts = [good(), bad(), None, "", good() * 200]
    got = [r["quality_score"] for r in quality.score(docs(spark, texts), model).orderBy("doc_id").collect()]
    assert got[0] > 0.8 and got[1] < 0.3 and got[2] == got[3] and got[4] > 0.8
    empty = quality.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert {r["quality_score"] for r in quality.score(docs(spark, texts), empty).collect()} == {0.5}


class BitWriter:
    def __init__(self):
        self.bits = ""

    def put(self, code, value=0, size=0):
        self.bits += code + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else "")

    def data(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")


def segment(kind, body):
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def flat_codes(symbols):
    """Codes of nine bits each, and the table that says so."""
    return {s: format(k, "09b") for k, s in enumerate(symbols)}, bytes([0] * 8 + [len(symbols)] + [0] * 7) + bytes(symbols)


@pytest.mark.parametrize("predictor", range(1, 8))
def test_foreign_lossless_jpeg(predictor):
    x = np.random.default_rng(predictor).integers(0, 256, (7, 11)).astype(int)
    codes, table = flat_codes(list(range(17)))
    out = BitWriter()
    for r in range(7):
        for c in range(11):
            a, b, d = x[r, c - 1], x[r - 1, c], x[r - 1, c - 1]
            guess = 128 if not r and not c else a if not r else b if not c else (a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[predictor - 1]
            diff = int(x[r, c] - guess)
            out.put(codes[abs(diff).bit_length()], diff, abs(diff).bit_length())
    file = b"\xff\xd8" + segment(0xC3, bytes([8, 0, 7, 0, 11, 1, 1, 0x11, 0])) + segment(0xC4, b"\0" + table) + segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + out.data() + b"\xff\xd9"
    assert np.array_equal(media.decode_frames([file, file])[1], x)


@pytest.mark.parametrize(("layout", "restart"), [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_baseline_jpeg(layout, restart):
    """A small encoder with quantisation steps of 1: what is decoded differs by rounding only."""
    h, v = layout[0]
    height, width = 24, 40
    ys, xs = np.mgrid[0:height, 0:width]
    image = (128 + 60 * np.sin(xs / 5.0) + 40 * np.cos(ys / 7.0)).astype(np.uint8)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    full = np.pad(image, ((0, down * 8 * v - height), (0, across * 8 * h - width)), mode="edge").astype(float) - 128
    cosines = np.array([[np.cos((2 * i + 1) * k * np.pi / 16) * (np.sqrt(1 / 8) if k == 0 else 0.5) for i in range(8)] for k in range(8)])
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    dc_codes, dc = flat_codes(list(range(12)))
    ac_codes, ac = flat_codes([0, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]])
    scans, last, out = [], [0] * len(layout), BitWriter()

    def block(values, k):
        diff = values[0] - last[k]
        last[k] = values[0]
        out.put(dc_codes[abs(diff).bit_length()], diff, abs(diff).bit_length())
        run = 0
        for value in values[1:]:
            if not value:
                run += 1
                continue
            while run > 15:
                out.put(ac_codes[0xF0])
                run -= 16
            out.put(ac_codes[run << 4 | abs(value).bit_length()], value, abs(value).bit_length())
            run = 0
        if run:
            out.put(ac_codes[0])

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            scans.append(out.data())
            last, out = [0] * len(layout), BitWriter()
        for k, (hk, vk) in enumerate(layout):
            for j in range(vk):
                for i in range(hk):
                    r, c = (unit // across * v + j) * 8, (unit % across * h + i) * 8
                    coefficients = np.round(cosines @ full[r : r + 8, c : c + 8] @ cosines.T).astype(int) if k == 0 else np.zeros((8, 8), dtype=int)
                    block([int(coefficients[p]) for p in order], k)
    scans.append(out.data())
    data = scans[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + s for k, s in enumerate(scans[1:]))
    parts = b"".join(bytes([k + 1, hk << 4 | vk, 0]) for k, (hk, vk) in enumerate(layout))
    file = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([1] * 64)) + segment(0xC0, bytes([8, 0, height, 0, width, len(layout)]) + parts) + segment(0xC4, b"\0" + dc + b"\x10" + ac)
    file += segment(0xDD, restart.to_bytes(2, "big")) * bool(restart) + segment(0xDA, bytes([len(layout)]) + b"".join(bytes([k + 1, 0]) for k in range(len(layout))) + bytes([0, 63, 0])) + data + b"\xff\xd9"
    assert np.abs(media.decode_frames([file])[0].astype(int) - image).max() <= 2
    with pytest.raises(ValueError, match="process"):
        media.decode_frames([file.replace(b"\xff\xc0", b"\xff\xc2")])
    with pytest.raises(ValueError, match="Huffman"):
        media.decode_frames([file.replace(b"\xff\xc4", b"\xff\xe4")])


def test_new_words_of_letters_skip_the_normal_form(spark):
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    rng = random.Random(5)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(3000)] + ["École", "ǅ", "ŉx", "İstanbul", "naïve.", "don't", "é", "ﬁ", "x1y"]
    text = " ".join(words)
    e = PieceEncoder(vocabulary("word_bpe_49k.json"), False)
    full, calls = e.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **k):
            calls.extend(texts)
            return full.encode_batch_fast(texts, **k)

    e.tokenizer = Counted()
    ids, at = e.encode([text, "", "Aé bC"])
    want = [full.encode(t, add_special_tokens=False).ids for t in (text, "", "Aé bC")]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    # only what isn't plain letters goes through the vocabulary's normal form
    assert not [w for t in calls for w in t.split(" ") if w.isalpha() and max(w) < "ɐ" and "İ" not in w]


def test_linked_symbols_give_the_same_shard(monkeypatch):
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 400, 700)
    parts = [x for _ in range(60) for x in (rng.integers(0, 400, rng.integers(1, 300)), passage[: rng.integers(1, 700)])]
    ids, ends = np.concatenate([*parts, np.full(999, 5), np.tile([1, 2], 400)]).astype(np.uint32), np.cumsum([*map(len, parts), 999, 800])
    data = []
    for linked in (1 << 40, 4, 1):  # never, as it is, from the second round
        monkeypatch.setattr(repair, "LINKED", linked)
        data.append(repair.write_shard(np.arange(len(ends)), ids, ends))
    assert data[0] == data[1] == data[2]
    s = repair.Shard(data[0])
    assert len(s.rules) > 100 and np.array_equal(s.all()[0], ids)
    pairs = Counter()
    for k in range(len(ends)):
        row, skip = s.symbols[s.symbol[k] : s.symbol[k + 1]].tolist(), False
        for p in zip(row[:-1], row[1:], strict=True):
            skip = p[0] == p[1] and not skip  # of a run every second pair
            pairs[p] += p[0] != p[1] or skip
    assert max(pairs.values()) < repair.LEAST_COUNT


@pytest.mark.parametrize("width", [1, 7, 8, 31, 32, 33, 62])
def test_packed_widths(width):
    rng = np.random.default_rng(width)
    values = np.append(rng.integers(0, 1 << width, 70_001), (1 << width) - 1)
    data = repair._packed(values, width)
    assert np.array_equal(repair._unpacked(memoryview(data), len(values), width), values)
    assert int.from_bytes(data[: 8 * width], "little") == sum(int(v) << k * width for k, v in enumerate(values[:64]))
