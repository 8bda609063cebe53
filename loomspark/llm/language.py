"""Language identification: averaged hashed subword embeddings, a linear softmax, and a calibrated rejection.

A text's features are the 2-, 3- and 4-grams of its letters' bytes within words (with a mark at each end), hashed into
2**BITS buckets. Its vector is the mean of its features' embeddings; a linear softmax over the vector gives the classes.
Stochastic gradient descent in numpy fits embeddings and softmax together; a temperature fitted on a part that the fit
did not see calibrates the probabilities, and the rejection threshold is the given quantile of that part's right answers.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled row every text is.
Repeated rows get a row and the same prediction each; a very long text is counted whole; an empty table has no rows; of
equal probabilities the label that is first in order wins. Other columns are not read; keep may not name `lang_pred`,
`lang_score` or `rejected`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bytetext as B
from loomspark.llm.frames import arrow
from loomspark.plans.shared import saved

UNKNOWN = "und"
#: Most labelled rows that a fit reads: those first by a hash of their id.
MAX_TRAIN_ROWS = 3000
BITS = 13
DIM = 16
_LETTER = re.compile(r"[^\W\d_]")
_fold = np.arange(256, dtype=np.uint8)
_fold[:65], _fold[91:97], _fold[123:128] = 32, 32, 32
_fold[65:91] += 32


def counts(texts: list[str], bits: int = BITS) -> np.ndarray:
    """Feature counts, one row by text."""
    buf, starts = B.joined([t.lower().encode() for t in texts], b" ")
    b = _fold[buf]
    v = B.BYTE_VALUES[b] >> np.uint64(8)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts)) << bits
    out = np.zeros(len(texts) << bits, dtype=np.int64)
    space = b == 32
    h, inner = v.copy(), np.zeros(len(b), dtype=bool)
    for n in (2, 3, 4):
        if len(b) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + v[n - 1 :]
        # no white space inside the gram, and not two of it around nothing
        inner = np.zeros(len(b) - 1, dtype=bool) if n == 2 else (inner[:-1] | space[n - 2 : len(b) - 1][: len(h)])
        ok = ~inner[: len(h)] & ~(space[: len(h)] & space[n - 1 :]) if n == 2 else ~inner[: len(h)]
        ids = doc[: len(h)] + (B.mix(h + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)
        out += np.bincount(ids[ok], minlength=len(out))
    return out.reshape(len(texts), 1 << bits)


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    table: np.ndarray  # embeddings times softmax weights: the model is linear in the mean
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t is not None and self.labels and _LETTER.search(t)]
        bits = max(1, int(self.table.shape[0]).bit_length() - 1)
        for a in range(0, len(use), 64):
            part = use[a : a + 64]
            x = counts([texts[i] for i in part], bits).astype(np.float32)
            z = (x @ self.table) / np.maximum(x.sum(1, keepdims=True), 1) + self.bias
            p = _softmax(z / self.temperature)
            for i, best, s in zip(part, p.argmax(1), p.max(1), strict=True):
                labels[i], score[i] = self.labels[best], round(float(s), 6)
        return labels, score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sgd(x: np.ndarray, y: np.ndarray, labels: tuple[str, ...], reject: float = 0.01, epochs: int = 25, rate: float = 8.0, seed: int = 3) -> LanguageModel:
    """x: feature counts, a row by text; y: index into labels. A tenth of the rows calibrates."""
    rng = np.random.default_rng(seed)
    x = (x / np.maximum(x.sum(1, keepdims=True), 1)).astype(np.float32)
    order = rng.permutation(len(x))
    held = order[: len(x) // 10] if len(x) >= 50 else order
    train = order[len(x) // 10 :] if len(x) >= 50 else order
    e = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, len(labels))).astype(np.float32), np.zeros(len(labels), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(train), 32):
            rows = train[at : at + 32]
            hidden = x[rows] @ e
            g = _softmax(hidden @ w + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            e -= step * (x[rows].T @ (g @ w.T))
            w -= step * 0.1 * (hidden.T @ g)
            bias -= step * 0.05 * g.sum(0)
        rng.shuffle(train)
    table = e @ w
    z = x[held] @ table + bias
    right = (np.arange(len(held)), y[held])
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(_softmax(z / t)[right] + 1e-12).mean())
    p = _softmax(z / temperature)
    sure = p.max(1)[p.argmax(1) == y[held]]
    return LanguageModel(labels, table, bias, float(temperature), float(np.quantile(sure, reject)) if len(sure) else 1.0)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", id: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS) -> LanguageModel:
    """Fit on at most max_rows rows that have an id, a label and a letter: ids are chosen first, then meet the texts once, by broadcast."""
    rows = labelled.select(F.col(id).cast("string").alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("y"))
    ids = rows.where(F.col("k").isNotNull() & F.col("y").isNotNull() & F.col("t").rlike(r"\p{L}")).select("k").distinct()
    chosen = saved(ids.orderBy(F.xxhash64("k"), "k").limit(max_rows), "chosen")
    # rows that share an id are one, of its least label and text
    chosen = rows.join(F.broadcast(chosen), "k").where("t is not null and y is not null").groupBy("k").agg(F.min(F.struct("y", "t")).alias("r")).select("k", "r.t", "r.y")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, y = b["k"].to_pylist(), b["t"].to_pylist(), b["y"].to_pylist()
            for a in range(0, len(texts), 64):
                use = [i for i in range(a, min(a + 64, len(texts))) if _LETTER.search(texts[i])]
                c = counts([texts[i] for i in use])
                at = [np.flatnonzero(r) for r in c]
                out = [np.concatenate([k, r[k]]).astype(np.int32).tobytes() for k, r in zip(at, c, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in use], pa.string()), pa.array([y[i] for i in use], pa.string()), pa.array(out, pa.binary())], ["k", "y", "x"])

    got = sorted(((r.k or "", r.y, bytes(r.x)) for r in arrow(chosen, read, "k string, y string, x binary").collect()))
    labels = tuple(sorted({r[1] for r in got}))
    if not labels:
        return LanguageModel((), np.zeros((2, 0), dtype=np.float32), np.zeros(0, dtype=np.float32), 1.0, 1.0)
    x = np.zeros((len(got), 1 << BITS), dtype=np.float32)
    for row, r in zip(x, got, strict=True):
        k, n = np.frombuffer(r[2], dtype=np.int32).reshape(2, -1)
        row[k] = n
    return sgd(x, np.array([labels.index(r[1]) for r in got]), labels)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id by default), lang_pred, lang_score and rejected (the score is under the model's threshold, or nothing was predicted)."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.table, model.bias, model.temperature, model.threshold))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("lang_score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*shared.value)
        for b in batches:
            labels, score = m.predict(b["__text"].to_pylist())
            kept = [b.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels, pa.string()), pa.array(score), pa.array([x == UNKNOWN or s < m.threshold for x, s in zip(labels, score, strict=True)], pa.bool_())], [*keep, "lang_pred", "lang_score", "rejected"])

    return arrow(docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text")), run, schema)
