"""Quality classifier: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

A text's features are the hashed one- and two-grams of its tokens (runs of letters, digits and bytes over 0x7F, or runs
of other visible characters), each with weight 1/sqrt(number of features); its score is the sigmoid of a sparse dot
product with the learned weights. Executors turn the labelled sample into feature ids; the driver fits.

Defined cases: a null or empty text has no features and gets the score of the bias alone; equal texts, repeated rows
among them, get equal scores, each its own row; a very long text is scored whole, as a block of its own; without any
label, or with labels of one class, the score is the class's share (0.5 without labels); an empty table of documents
has no scores. A label without a document, of a null id or of another value than 0 and 1 is not learned from; of labels
that share an id one is. Other columns are not read; keep may not name a column `quality_score`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bytetext as B
from loomspark.llm.frames import arrow
from loomspark.plans.shared import discard, saved

#: Most labelled rows that a fit reads: those first by a hash of their id, and per class half of them.
MAX_TRAIN_ROWS = 6000
BITS = 18

_kind = np.full(256, 2, dtype=np.uint8)  # 0: space, 1: word, 2: other
_kind[B.SPACE] = 0
_kind[48:58] = _kind[65:91] = _kind[97:123] = _kind[128:] = 1


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of a block of texts, one after another, and where each text's begin."""
    buf, starts = B.joined(texts)
    kind = _kind[buf]
    cut = np.flatnonzero(np.diff(kind, prepend=0))
    end = np.append(cut[1:], len(buf))
    keep = kind[cut] > 0 if len(cut) else np.zeros(0, dtype=bool)
    s, e = cut[keep], end[keep]
    h = B.range_hash(B.prefix(buf, B.LOWER_VALUES), s, e)
    first = np.searchsorted(s, starts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = doc[1:] == doc[:-1]
    two = B.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pair]
    ids = np.concatenate([h, two]) >> np.uint64(64 - bits)
    order = np.argsort(np.concatenate([doc, doc[1:][pair]]), kind="stable")
    sizes = np.diff(first) + np.bincount(doc[1:][pair], minlength=len(texts))[: len(texts)]
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    return ids[order].astype(np.int32), at


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float

    def score_block(self, texts: list[bytes]) -> np.ndarray:
        ids, at = features(texts, int(self.weights.size).bit_length() - 1)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[ids].astype(np.float64))])
        n = np.diff(at)
        z = self.bias + (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(n, 1))
        return np.round(1 / (1 + np.exp(-np.clip(z, -35, 35))), 6)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 3, seed: int = 5) -> QualityModel:
    """FTRL-proximal (McMahan et al., 2013), a row at a time; weights are made from z and n as they are needed."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(1 << bits, dtype=np.float32), math.log(share / (1 - share)))
    bias, bias_n = math.log(share / (1 - share)), 0.0

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    unique = [np.unique(r, return_counts=True) for r in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, count = unique[i]
            x = count / math.sqrt(max(count.sum(), 1))
            zi, ni = z[ids], n[ids]
            w = weight(zi, ni)
            p = 1 / (1 + math.exp(-min(max(bias + float(w @ x), -35), 35)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids], n[ids] = zi + g - sigma * w, ni + g * g
            bias_n += (p - labels[i]) ** 2
            bias -= 0.1 * (p - labels[i]) / (1 + math.sqrt(bias_n))
    return QualityModel(weight(z, n).astype(np.float32), bias)


def fit_labels(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", id: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS) -> QualityModel:
    """Fit on at most max_rows of the documents that labels (id, label) cover: ids are chosen first, then meet the texts once, by broadcast."""
    rows = labels.select(F.col(id).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and k is not null").dropDuplicates(["k"])
    rows = saved(rows.join(docs.select(F.col(id).cast("long").alias("k")).distinct(), "k", "left_semi"), "labels")
    model = _fit(docs.select(F.col(id).cast("long").alias("k"), F.col(text).alias("t")), rows, max_rows)
    discard(rows)
    return model


def fit(labelled: DataFrame, text: str = "text", label: str = "label", id: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS) -> QualityModel:
    """Fit on at most max_rows labelled rows (label 0 or 1; others and null are left out)."""
    rows = labelled.select(F.col(id).cast("long").alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    return _fit(rows.select("k", "t"), rows.select("k", "y").where("y in (0, 1) and k is not null").dropDuplicates(["k"]), max_rows)


def _fit(texts: DataFrame, rows: DataFrame, max_rows: int) -> QualityModel:
    """texts: k, t. rows: k, unique, and y."""
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(max_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = saved(chosen, "chosen")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    met = texts.join(F.broadcast(chosen), "k")  # max_rows rows at most
    met = met.groupBy("k", "y").agg(F.min("t").alias("t"))  # rows that share an id are one, of its least text

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = B.texts_of(b["t"])
            for i, j in B.blocks(found):
                ids, at = features(found[i:j])
                got = [ids[a:c].tobytes() for a, c in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b["k"][i:j], b["y"][i:j], pa.array(got, pa.binary())], ["k", "y", "ids"])

    got = sorted(((r.k, r.y, bytes(r.ids)) for r in arrow(met.select("k", "t", "y"), read, "k long, y int, ids binary").collect()), key=lambda r: str(r[0]))
    discard(chosen)
    model = ftrl([np.frombuffer(r[2], dtype=np.int32) for r in got], np.array([r[1] for r in got], dtype=np.float64))
    return _rebalanced(model, got, totals)


def _rebalanced(model: QualityModel, got: list, total: dict[int, int]) -> QualityModel:
    """Classes were sampled evenly; the bias gives back the share that all labels have."""
    n = [sum(r[1] == y for r in got) for y in (0, 1)]
    if not all(n) or len(total) < 2:
        return model
    return QualityModel(model.weights, model.bias + math.log(total[1] / total[0]) - math.log(n[1] / n[0]))


def score(docs: DataFrame, model: QualityModel, text: str = "text", id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (id by default) of every row of docs, and its quality_score (double)."""
    keep = keep or [id]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2**bits floats
    schema = docs.select(*keep).schema.add("quality_score", "double")
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = QualityModel(*shared.value)
        for b in batches:
            texts = B.texts_of(b["__text"])
            s = [m.score_block(texts[i:j]) for i, j in B.blocks(texts)]
            kept = [b.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(s) if s else np.zeros(0))], [*keep, "quality_score"])

    return arrow(rows, run, schema)
