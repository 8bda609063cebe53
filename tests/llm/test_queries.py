"""The registered queries over whole tables at sf0.001: against their SQL, or against brute force where there is none."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from loomspark.llm import media
from loomspark.llm import queries as llm
from loomspark.llm.tokens import PieceEncoder

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations")


def test_every_query_is_tested():
    assert set(llm.QUERIES) == set(llm.ORACLES) | {"op2_media_avi", "op6_language_id", "op8_quality", "op9_token_shards", "op10_packing"}


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = llm.QUERIES[name](spark, SF)
    rel = con.execute(llm.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(df.select(*names).collect()) == order(rel.fetchall())


def texts_of(spark, sf=SF):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_media(spark):
    got = {r["doc_id"]: r for r in llm.op2_media_avi(spark, SF).collect()}
    texts = texts_of(spark)
    assert set(got) == set(texts)
    feature = {}
    for i, t in texts.items():
        raw, r = t.encode(), got[i]
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored = media.write_avi(payload)
        assert tuple(r)[1:7] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert feature.setdefault(t, r["feature"]) == r["feature"] and r["feature"].startswith(f"frames={-(-len(payload) // 2048)};")


def test_token_shards(spark):
    path, start = llm.vocabulary("word_bpe_49k.json"), 0
    e = PieceEncoder(path, False)
    got = {r["doc_id"]: tuple(r)[1:] for r in llm.op9_token_shards(spark, SF).collect()}
    for i, t in sorted(texts_of(spark).items()):
        ids = np.append(e.whole(t), 2).astype("<u4")
        assert got.pop(i) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_packing(spark):
    e = PieceEncoder(llm.vocabulary("byte_bpe_50k.json"), True)
    own = {i: np.append(e.whole(t), 0).astype("<u4") for i, t in texts_of(spark).items()}
    bins, at = defaultdict(list), dict.fromkeys(own, 0)
    for r in llm.op10_packing(spark, SF).orderBy("doc_id", "piece").collect():
        ids = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["length"] == len(ids) and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 2048
        at[r["doc_id"]] += len(ids)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in own.items()}
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *[n for _, n in sorted(b)]])[:-1].tolist() and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(map(len, own.values())) // 2048) * 1.02 + 1


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = {r["doc_id"]: r for r in llm.op6_language_id(spark, sf).collect()}
    assert set(got) == set(rows) and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    learned = {r["lang"] for i, r in rows.items() if not got[i]["held_out"]}
    for i, r in rows.items():
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert 0 <= got[i]["score"] <= 1 and (got[i]["lang_pred"] == "und") == blank and (blank or got[i]["lang_pred"] in learned)
    held = [i for i in rows if got[i]["held_out"] and rows[i]["lang"] and got[i]["lang_pred"] != "und"]
    assert len(held) > 150 and np.mean([got[i]["lang_pred"] == rows[i]["lang"] for i in held]) >= 0.97


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in llm.op8_quality(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"] and r["quality"] is not None}
    good, bad = ([got[i]["score"] for i, y in labels.items() if y == k] for k in (1, 0))
    assert len(bad) > 50
    better = np.mean(np.array(good)[:, None] > np.array(bad)[None, :])
    assert better >= 0.9 and np.mean([got[i]["predicted"] == y for i, y in labels.items()]) >= 0.9
