import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from loomspark.llm import quality, suffix

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def after_near_duplicates(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, r in rows.items() for w in [re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER))]}
    root = {i: i for i in rows}
    linked = [(i, j) for i in rows for j in rows if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return {i: r["text"] for i, r in rows.items() if root[i] == i}


def after_repeated_passages(rows, n=suffix.PASSAGE):
    raw = {i: (r["text"] or "").encode() for i, r in rows.items()}
    count = Counter(t[k : k + n] for t in raw.values() for k in range(len(t) - n + 1))
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k : k + n] = True
        out[i] = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


def after_benchmark(rows, bench):
    find = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
    windows = {tuple(m[0] for m in w[k : k + 10]) for t in bench for w in [find(t)] for k in range(max(1, len(w) - 9) if w else 0)}
    out = {}
    for i, r in rows.items():
        w, hit = find(r["text"]), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(m[0] for m in w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        if len(hit) <= 0.5 * len(w):
            t = r["text"] or ""
            ends = [m.start() for m in w[1:]] + [len(t)]
            out[i] = r["text"] if not hit else (t[: w[0].start()] if 0 not in hit else "") + "".join(t[m.start() : e] for k, (m, e) in enumerate(zip(w, ends, strict=True)) if k not in hit)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        rows = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
            before = spark.read.parquet(f"{SF}/documents.parquet")
            score = {r["doc_id"]: r["quality_score"] for r in quality.score(before, quality.fit_labels(before, labels)).collect()}
            want = {i: r["text"] for i, r in rows.items() if score[i] >= pipeline.QUALITY_THRESHOLD}
        else:
            want = {"near_duplicates": after_near_duplicates, "repeated_passages": after_repeated_passages}[name](rows) if name != "benchmark" else after_benchmark(rows, bench)
        assert {i: t or "" for i, t in got.items()} == {i: t or "" for i, t in want.items()}, name
        counts.append(len(got))
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_clashing_columns_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("quality_score", "kept_text", "own", "h", "spans", "n", "row", "component_id", "w", "k", "start", "hits", "a")
    more = docs.withColumns({c: F.lit(7) for c in names})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns
        assert out.where(" and ".join(f"{c} = 7" for c in names)).count() == out.count() > 0
        empty = stage(spark, more.where("false"), SF)
        assert empty.columns == more.columns and empty.count() == 0
    assert pipeline.STAGES[-1][1](spark, more.where("false"), SF).count() == 0


def test_null_and_repeated_ids(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    passage = max((r["text"] or "" for r in bench.collect()), key=len)
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    shared = text("shared", 80)
    rows = [(1, text(1)), (1, text(1)), (1, text(1)), (2, text(2)), (2, text(3)), (None, text(4)), (None, text(4)), (None, text(5) + " five " + shared), (None, text(6) + " six " + shared), (7, text(1)), (None, text(2)), (None, text(8, 400) + " " + passage), (9, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id int, text string, lang string, source string, n_chars long")
    order = lambda found: sorted(found, key=lambda r: (str(r[0]), str(r[1])))
    read = lambda df: order((r["doc_id"], r["text"]) for r in df.collect())
    near = pipeline.near_duplicate_stage(spark, docs, SF)
    left = [rows[i] for i in (0, 3, 4, 5, 7, 8, 11, 12, 13)]
    assert read(near) == order(left)
    repeats = pipeline.repeated_passage_stage(spark, near, SF)
    assert repeats.dtypes == docs.dtypes
    ends = lambda t: t.replace(" " + shared, "") if t else ""
    assert read(repeats) == order((i, ends(t)) for i, t in left)
    # identical rows are copies of each other there, each with a row of its own
    assert pipeline.repeated_passage_stage(spark, docs, SF).count() == len(rows)
    clean = {r["text"] for r in pipeline.benchmark_stage(spark, repeats, SF).collect()}
    assert text(4) in clean and not any(passage in t for t in clean)
