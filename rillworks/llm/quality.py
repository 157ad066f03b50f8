"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by numbers, encoded, and weighted by gated
attention that is learned from document labels alone; the document's score comes from the weighted mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm import samples
from rillworks.llm.words import hashes, raw, words_of

PASSAGE = 64
SAMPLE = 3000
HIDDEN = 16
LEXICAL = 16
_AT_ONCE = 1 << 16

#: Classes of bytes: small letters, capitals, digits, sentence ends, other usual punctuation, symbols, bytes of other letters.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b",;:'\"()-", bytes(range(128, 256))]
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _i
WIDTH = len(_KINDS) + 1 + 10 + LEXICAL


def passages(text: bytes | None) -> np.ndarray:
    """One row of numbers per 64 words of the whole text; a text without words is one row of zeros."""
    words = words_of(text)
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    return np.concatenate([_described(words[i:i + _AT_ONCE], text) for i in range(0, len(words), _AT_ONCE)])


def _described(words: list[bytes], text: bytes) -> np.ndarray:
    n, count = len(words), -(-len(words) // PASSAGE)
    starts = np.arange(0, n, PASSAGE)
    size = np.diff(np.append(starts, n)).astype(np.float64)
    length = np.fromiter(map(len, words), np.int64, n)
    data = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(length) - length
    of_word = np.arange(n) // PASSAGE
    kinds = len(_KINDS) + 1
    per_kind = np.bincount(np.repeat(of_word, length) * kinds + _KIND[data], minlength=count * kinds).reshape(count, kinds)
    total = per_kind.sum(axis=1, keepdims=True)
    h = hashes(words)
    padded = np.full(count * PASSAGE, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    by_value = np.sort(padded.reshape(count, PASSAGE), axis=1)
    distinct = (by_value[:, 1:] != by_value[:, :-1]).sum(axis=1) + 1 - (size < PASSAGE)
    again = np.append(False, h[1:] == h[:-1])
    mean = np.add.reduceat(length, starts) / size
    spread = np.sqrt(np.maximum(0, np.add.reduceat(length**2, starts) / size - mean**2))
    first, last = _KIND[data[begin]], _KIND[data[begin + length - 1]]
    share = lambda x: np.add.reduceat(x.astype(np.float64), starts) / size
    lexical = np.bincount(of_word * LEXICAL + (h >> np.uint64(60)).astype(np.int64), minlength=count * LEXICAL).reshape(count, LEXICAL)
    numbers = [distinct / size, share(again), mean / 10, spread / 10, share(first == 1), share(last == 3), share(last == 6), share(length <= 3),
               size / PASSAGE, np.full(count, min(1.0, np.log1p(n) / 10))]
    return np.concatenate([per_kind / np.maximum(1, total), np.stack(numbers, axis=1), lexical / size[:, None]], axis=1).astype(np.float32)


@dataclass
class Model:
    """Standardisation, encoder (e), attention (v, u, w) and output (c) weights; the last row of e and c is the bias."""

    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.e[:-1] + self.e[-1])
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-h @ self.u))
        a = (t * g) @ self.w
        size = np.diff(np.append(starts, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), size))
        a /= np.repeat(np.add.reduceat(a, starts), size)
        z = np.add.reduceat(h * a[:, None], starts)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c[:-1] + self.c[-1], -30, 30)))
        return p, (x, h, t, g, a, z, size)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
        return self.forward(np.concatenate(bags).astype(np.float64), starts)[0]


def _gradients(m: Model, p, y, weight, parts) -> list[np.ndarray]:
    x, h, t, g, a, z, size = parts
    dz = ((p - y) * weight)[:, None] * m.c[:-1]
    dc = np.append(z.T @ ((p - y) * weight), ((p - y) * weight).sum())
    dz_row = np.repeat(dz, size, axis=0)
    da = (dz_row * h).sum(axis=1)
    starts = np.cumsum(size) - size
    ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), size))
    dw = (t * g).T @ ds
    dt, dg = ds[:, None] * m.w * g * (1 - t**2), ds[:, None] * m.w * t * g * (1 - g)
    dh = (dz_row * a[:, None] + dt @ m.v.T + dg @ m.u.T) * (1 - h**2)
    return [np.vstack([x.T @ dh, dh.sum(axis=0)]), h.T @ dt, h.T @ dg, dw, dc]


def train(bags: list[np.ndarray], labels: np.ndarray, rounds: int = 60, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """Fits the model to bags of passages with labels 0 and 1 by Adam. Without bags every score is the same."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags).astype(np.float64) if bags else np.zeros((1, WIDTH))
    deal = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    m = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, np.vstack([deal(WIDTH, HIDDEN), np.zeros(HIDDEN)]), deal(HIDDEN, HIDDEN), deal(HIDDEN, HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(HIDDEN + 1))
    names = ["e", "v", "u", "w", "c"]
    first, second, t = [0.0] * 5, [0.0] * 5, 0
    for _ in range(rounds if bags else 0):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            chosen = order[i:i + batch]
            part = [bags[j] for j in chosen]
            starts = np.cumsum([0, *[len(b) for b in part[:-1]]])
            p, state = m.forward(np.concatenate(part).astype(np.float64), starts)
            t += 1
            for k, grad in enumerate(_gradients(m, p, labels[chosen], np.full(len(chosen), 1 / len(chosen)), state)):
                grad = grad + 1e-4 * getattr(m, names[k])
                first[k], second[k] = 0.9 * first[k] + 0.1 * grad, 0.999 * second[k] + 0.001 * grad**2
                setattr(m, names[k], getattr(m, names[k]) - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8))
    return m


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled documents, as many of either label as there are up to half of it."""
    labelled = samples.learnable(labels, key, label, train_rows)
    chosen = samples.sampled(labelled, docs.select(key, text), key, label, max(1, sample // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [passages(t).tobytes() for t in raw(b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array(bags, pa.binary())], ["k", "y", "x"])

    rows = chosen.select(F.col(key).cast("string").alias("k"), F.col(label).cast("double").alias("y"), F.col(text).alias("t")).mapInArrow(run, "k string, y double, x binary").collect()
    rows.sort(key=lambda r: (r["k"], r["x"]))
    return train([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows], np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` with quality_score, 0 to 1, of every whole text; a column of this name is replaced.

    NULL and blank texts are scored as one passage without words.
    """
    docs = docs.drop("quality_score")
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_model.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                scores = m.score([passages(t) for t in raw(part.column(part.schema.get_field_index(text)))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))
