"""Log probabilities of texts: a smoothed word unigram, and a causal self-attention model over subword ids.

The attention model is one layer of masked self-attention, trained in numpy: a start on few texts, then one pass in which
each task goes on with its share of all training texts, every id a target once; the weights are averaged. It predicts the class of the next
id; classes are bands of ids of equal frequency, and within a class an id has its share in the corpus. Texts
are scored in overlapping windows, each id once, with at least `OVERLAP` ids of context but at the beginning.
"""

from __future__ import annotations

import base64
import re
import sys
import threading
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.llm import shared
from rillworks.llm.words import LOWER, hashes, raw, values

WINDOW = 32
OVERLAP = 8
CLASSES = 32
WIDTH = 16
FREQUENT = 2048
SAMPLE_DOCS = 800
SAMPLE_WINDOWS = 32
SMOOTHING = 0.1
#: Groups of tasks whose weights are added up before the driver gets them.
AVERAGED = 16
GROUPS_PER_PARTITION = 4
_BATCH = 128
#: Where white space never stands twice, splitting patterns need no look behind it to find its last one.
_TWO_SPACES = re.compile(r"\s\s").search
_LAST_SPACE = r"|\s+(?!\S)"
_SPACED = bytes(32 if 9 <= i <= 13 else x for i, x in enumerate(LOWER))


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


@dataclass(frozen=True)
class Subwords:
    """A file of byte-pair ranks and its splitting pattern; the end of a text is the id after the last rank."""

    path: str
    pattern: str

    @property
    def end(self) -> int:
        return _encoding(self.path, self.pattern)[1]

    def ids(self, text: bytes | None) -> np.ndarray:
        """Ids of a whole text, A to Z as small letters, and the end."""
        return np.frombuffer(self.coded(text), _kind(self)).astype(np.int64)

    def coded(self, text: bytes | None) -> bytes:
        """`ids` as little-endian bytes, 16 bits each if the end fits."""
        encoding, end = _encoding(self.path, self.pattern)
        found: list[int] = []
        if text:
            small = text.translate(LOWER).decode()
            if not _TWO_SPACES(small):  # the same ids, by a pattern that is matched without going back
                encoding, _ = _encoding(self.path, self.pattern.replace(_LAST_SPACE, ""))
            found = encoding.encode_ordinary(small)
        found.append(end)
        ids = array("H" if end < 1 << 16 else "I", found)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def windows(sizes: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """(first position, first scored column) of all windows over sequences that stand one after the other; each position is scored once."""
    step = window - overlap
    count = 1 + np.maximum(0, -(-(sizes - window) // step))
    start = np.cumsum(sizes) - sizes
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + number * step, np.where(number > 0, overlap, 0)


class _Room(threading.local):
    """Arrays by name that are written again in every batch: fresh ones of this size cost more than what is computed in them."""

    def __init__(self):
        self._kept: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        kept = self._kept.get((name, kind))
        if kept is None or len(kept) < size:
            kept = self._kept[name, kind] = np.empty(size, kind)
        return kept[:size].reshape(shape)


_ROOM = _Room()


@dataclass
class Model:
    """`band` and `share`: class of each id and log10 of its share there; `row`: its embedding; the rest are weights."""

    band: np.ndarray
    share: np.ndarray
    row: np.ndarray
    w: dict[str, np.ndarray]

    @classmethod
    def of_counts(cls, counts: np.ndarray, seed: int = 11) -> Model:
        mass = counts + 0.5
        order = np.argsort(-counts, kind="stable")
        before = np.cumsum(mass[order]) - mass[order]
        band = np.empty(len(counts), np.int64)
        band[order] = np.minimum(CLASSES - 1, before * CLASSES // mass.sum()).astype(np.int64)
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        share = np.log10(mass / np.bincount(band, mass, CLASSES)[band])
        rng = np.random.default_rng(seed)
        deal = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
        w = {"e": deal(FREQUENT + CLASSES + 1, WIDTH), "p": deal(WINDOW, WIDTH), "q": deal(WIDTH, WIDTH), "k": deal(WIDTH, WIDTH), "v": deal(WIDTH, WIDTH), "o": deal(WIDTH, WIDTH), "u": deal(WIDTH, CLASSES), "b": np.log(np.bincount(band, mass, CLASSES) + 1e-3).astype(np.float32)}
        w["b"] -= w["b"].max()
        return cls(band, share, np.where(rank < FREQUENT, rank, FREQUENT + band), w)

    @property
    def begin(self) -> int:
        return FREQUENT + CLASSES

    def forward(self, rows: np.ndarray) -> tuple:
        """Class scores for each position of windows of embedding rows; a position sees itself and what is before it."""
        w = self.w
        x = w["e"][rows] + w["p"][:rows.shape[1]]
        q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
        a = q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + _mask(rows.shape[1])
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        c = a @ v
        h = np.tanh(x + c @ w["o"])
        return h @ w["u"] + w["b"], (x, q, k, v, a, c, h)

    def log_p(self, rows: np.ndarray, target: np.ndarray, since: int = 0) -> np.ndarray:
        """Natural log probability of each target class from column `since` on, as `forward` gives it, with as few passes over the windows as it takes.

        Exponents are held below 60 and above -60 instead of being shifted by each row's maximum.
        """
        w = self.w
        b, n = rows.shape
        here, kind = n - since, w["e"].dtype
        m = b * here
        xs = w["e"].take(rows.reshape(-1), axis=0, out=_ROOM("x", kind, b * n, WIDTH), mode="clip").reshape(b, n, WIDTH)
        xs += w["p"][:n]
        x = xs.reshape(-1, WIDTH)
        if since:
            x = _ROOM("since", kind, b, here, WIDTH)
            x[:] = xs[:, since:]
            x = x.reshape(m, WIDTH)
        y = np.matmul(x, w["q"] @ w["k"].T * kind.type(WIDTH**-0.5), out=_ROOM("y", kind, m, WIDTH))
        a = np.matmul(y.reshape(b, here, WIDTH), xs.transpose(0, 2, 1), out=_ROOM("a", kind, b, here, n))
        _held_exp(a)
        a *= _before(n, kind)[since:]
        c = np.matmul(a, xs, out=_ROOM("c", kind, b, here, WIDTH)).reshape(m, WIDTH)
        c /= (a.reshape(m, n) @ np.ones(n, kind))[:, None]
        h = np.matmul(c, w["v"] @ w["o"], out=_ROOM("h", kind, m, WIDTH))
        h += x
        _tanh(h)
        logits = np.matmul(h, w["u"], out=_ROOM("d", kind, m, CLASSES))
        wanted = target[:, since:].reshape(-1)
        places = np.arange(0, m * CLASSES, CLASSES)
        places += wanted
        if (np.abs(w["u"]).sum(axis=0) + np.abs(w["b"])).max() < 60:  # what is added to all rows is a factor of their sums; h is between -1 and 1
            chosen = logits.reshape(-1).take(places) + w["b"].take(wanted)
            np.exp(logits, out=logits)
            return (chosen - np.log(logits @ np.exp(w["b"]))).reshape(b, here)
        logits += w["b"]
        np.clip(logits, -60, 60, out=logits)
        chosen = logits.reshape(-1).take(places)
        np.exp(logits, out=logits)
        return (chosen - np.log(logits @ np.ones(CLASSES, kind))).reshape(b, here)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of ids, its end included."""
        sizes = np.array([len(t) for t in texts])
        ids = np.concatenate(texts)
        first = np.cumsum(sizes) - sizes
        rows = np.empty(len(ids), np.int64)
        self.row.take(ids[:-1], out=rows[1:], mode="clip")
        rows[first] = self.begin
        limit = np.repeat(np.cumsum(sizes), sizes)
        at, scored = windows(sizes)
        out, band = self.share.take(ids), self.band.take(ids)
        for since in np.unique(scored).tolist():
            of = at[scored == since]
            end = limit[of] - of
            for i in range(0, len(of), _BATCH):
                place = of[i:i + _BATCH, None] + np.arange(WINDOW)
                inside = np.arange(since, WINDOW) < end[i:i + _BATCH, None]
                np.minimum(place, len(ids) - 1, out=place)
                log_p = self.log_p(rows.take(place), band.take(place), since)
                out[place[:, since:][inside]] += log_p[inside] * 0.4342944819032518
        return np.add.reduceat(out, first)


@lru_cache(maxsize=4)
def _mask(n: int) -> np.ndarray:
    return np.triu(np.full((n, n), -1e9, np.float32), 1)


def train(model: Model, sequences: list[np.ndarray], rounds: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
    """Fits the weights to windows of rows (inputs) and classes (targets), shape (2, n), by Adam; in place."""
    rng = np.random.default_rng(seed)
    full = [s for s in sequences if s.shape[1] == WINDOW]
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    t = 0
    for _ in range(rounds if full else 0):
        order = rng.permutation(len(full))
        for i in range(0, len(order), batch):
            part = np.stack([full[j] for j in order[i:i + batch]])
            grads = _gradients(model, part[:, 0], part[:, 1])
            t += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.w[name] = (model.w[name] - rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


class Pass:
    """One pass of Adam over the ids of whole texts, begun at the weights of `model`; `n` counts the ids."""

    def __init__(self, model: Model, rate: float = 0.003, batch: int = 256):
        self.model, self.rate, self.batch = Model(model.band, model.share, model.row, {k: v.copy() for k, v in model.w.items()}), rate, batch
        self.first, self.second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
        self.n = self.t = 0

    def learn(self, texts: list[np.ndarray]) -> None:
        """Windows stand side by side; the places behind the end of a text count for nothing."""
        model, w = self.model, self.model.w
        sizes = np.array([len(t) for t in texts])
        ids = np.concatenate(texts)
        rows, band = np.empty(len(ids), np.int64), model.band.take(ids)
        model.row.take(ids[:-1], out=rows[1:], mode="clip")
        rows[np.cumsum(sizes) - sizes] = model.begin
        at, _ = windows(sizes, WINDOW, 0)
        end = np.repeat(np.cumsum(sizes), -(-sizes // WINDOW)) - at
        for i in range(0, len(at), self.batch):
            place = at[i:i + self.batch, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < end[i:i + self.batch, None]
            np.minimum(place, len(ids) - 1, out=place)
            self.t += 1
            rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
            for name, g in _gradients(model, rows.take(place), band.take(place), inside).items():
                first, second = self.first[name], self.second[name]
                first *= np.float32(0.9)
                first += np.multiply(g, np.float32(0.1), out=_ROOM("step", g.dtype, *g.shape))
                g *= g
                g -= second
                g *= np.float32(0.001)
                second += g
                np.sqrt(second, out=g)
                g += np.float32(1e-8)
                np.divide(first, g, out=g)
                g *= rate
                w[name] -= g
        self.n += len(ids)


def _gradients(model: Model, rows: np.ndarray, target: np.ndarray, counted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over the counted places, by as few passes over the windows as it takes.

    As in `Model.log_p` exponents are held, below 60 and above -60, instead of being shifted by each row's maximum, and sums of
    attention are products with ones. Attention stays unscaled; its sums divide the gradients of what it made. Two
    products of weights, queries by keys and values by outputs, stand for the four.
    """
    w = model.w
    b, n = rows.shape
    m = b * n
    kind = w["e"].dtype
    room = _ROOM
    every = rows.reshape(-1)
    ones = np.ones(max(m, n, CLASSES), kind)
    scale = kind.type(WIDTH**-0.5)
    meet, pass_on = w["q"] @ w["k"].T * scale, w["v"] @ w["o"]
    flat = lambda name, x, y, width=WIDTH: np.matmul(x, y, out=room(name, kind, m, width))
    deep = lambda name, x, y: np.matmul(x, y, out=room(name, kind, b, x.shape[1], y.shape[2]))
    by_window = lambda x: x.reshape(b, n, -1)
    x = w["e"].take(every, axis=0, out=room("x", kind, m, WIDTH), mode="clip")
    xs = by_window(x)
    xs += w["p"][:n]
    y = by_window(flat("y", x, meet))
    a = deep("a", y, xs.transpose(0, 2, 1))
    _held_exp(a)
    a *= _before(n, kind)
    part = 1 / (a.reshape(m, n) @ ones[:n])[:, None]
    c = deep("c", a, xs).reshape(m, WIDTH)
    c *= part
    h = flat("h", c, pass_on)
    h += x
    _tanh(h)
    d = flat("d", h, w["u"], CLASSES)
    d += w["b"]
    _held_exp(d)
    weight = np.full(m, 1 / m, kind) if counted is None else (counted / counted.sum()).astype(kind).reshape(-1)
    d *= (weight / (d @ ones[:CLASSES]))[:, None]
    places = np.arange(0, m * CLASSES, CLASSES)
    places += target.reshape(-1)
    d.reshape(-1)[places] -= weight
    g = {"u": h.T @ d, "b": ones[:m] @ d}
    dx = flat("dx", d, w["u"].T)
    h *= h
    np.subtract(1, h, out=h)
    dx *= h
    passed = c.T @ dx
    g["o"], g["v"] = w["v"].T @ passed, passed @ w["o"].T
    dc = flat("dc", dx, pass_on.T)
    dc *= part
    mean = np.einsum("ij,ij->i", dc, c).reshape(b, n, 1)
    dc = by_window(dc)
    ds = deep("ds", dc, xs.transpose(0, 2, 1))
    ds -= mean
    ds *= a
    dy = deep("dy", ds, xs).reshape(m, WIDTH)
    met = x.T @ dy * scale
    g["q"], g["k"] = met @ w["k"], met.T @ w["q"]
    dx += flat("back", dy, meet.T)
    dxs = by_window(dx)
    dxs += deep("back", ds.transpose(0, 2, 1), y)
    dxs += deep("back", a.transpose(0, 2, 1), dc)
    g["p"] = np.zeros_like(w["p"])
    g["p"][:n] = dxs.sum(axis=0)
    order = np.argsort(every.astype(np.uint16), kind="stable")  # as 16-bit numbers, which are sorted by radix
    sorted_ = every[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    g["e"] = np.zeros_like(w["e"])
    g["e"][sorted_[first]] = np.add.reduceat(dx.take(order, axis=0, out=room("turned", kind, m, WIDTH), mode="clip"), first, axis=0)
    return g


def _tanh(x: np.ndarray) -> None:
    """tanh in place as 1 - 2 / (exp(2 x) + 1), which takes two thirds of the time of numpy's."""
    x += x
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1


def _held_exp(x: np.ndarray) -> None:
    """exp of values held below 60 and above -60, in place; the pass that holds them is left out where they are."""
    if max(x.max(), -x.min()) > 60:
        np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)


@lru_cache(maxsize=4)
def _before(n: int, kind: np.dtype) -> np.ndarray:
    return np.tri(n, dtype=kind)


def cut_texts(docs: DataFrame, learn: Column, subwords: Subwords, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, learn, at, ids) of every row, stored: ids are cut once for `fit` and `scores`. `at` is a hash of key and text."""
    rows = docs.select(F.col(key).alias("key"), learn.alias("learn"), F.xxhash64(key, text).alias("at"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches):
            ids = list(map(subwords.coded, raw(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], ["key", "learn", "at", "ids"])

    return shared.stored(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, learn boolean, at long, ids binary"), "zstd")


def _kind(subwords: Subwords) -> str:
    return "<u2" if subwords.end < 1 << 16 else "<u4"


def fit(docs: DataFrame, learn: Column, subwords: Subwords, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, cut_rows: DataFrame | None = None) -> Model:
    """Fits the model to all rows that `learn` marks: counts of all ids, and weights trained on all texts.

    Ids are those of `cut_rows`, from `cut_texts`; the counts (one per id of the vocabulary) are summed over tasks. The common start of the
    weights comes from the `sample_docs` keys with the least hashes, and of each of these texts at most `sample_windows` windows,
    evenly spread. From there each task trains on all of its texts, and the weights of the tasks are averaged by their ids, within
    AVERAGED groups of tasks first, so that the driver gets that many at most.
    """
    cut_rows = (cut_texts(docs, learn, subwords, key, text) if cut_rows is None else cut_rows).filter("learn")
    kind = _kind(subwords)

    def lists(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(subwords.end + 1, np.int64)
        for b in shared.slices(batches):
            total += np.bincount(np.concatenate(lists(b)), minlength=subwords.end + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    sums = cut_rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(subwords.end + 1)
    for r in sums:
        counts[r["id"]] = r["n"]
    model = Model.of_counts(counts)
    chosen = cut_rows.select("key").filter("key IS NOT NULL").distinct().orderBy(F.xxhash64("key"), "key").limit(sample_docs)
    row, band, begin = model.row, model.band, model.begin

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches):
            for ids in lists(b):
                inputs = np.concatenate([[begin], row[ids[:-1]]])
                starts = np.unique(np.linspace(0, max(0, len(ids) - WINDOW), sample_windows).astype(np.int64))
                found = [np.stack([inputs[s:s + WINDOW], band[ids[s:s + WINDOW]]]).astype("<i4").tobytes() for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["w"])

    got = sorted(bytes(r["w"]) for r in cut_rows.join(F.broadcast(chosen), "key").mapInArrow(cut, "w binary").collect())
    train(model, [np.frombuffer(g, "<i4").reshape(2, -1).astype(np.int64) for g in got])
    begun = docs.sparkSession.sparkContext.broadcast(model)
    names = list(model.w)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Pass(begun.value)
        for b in shared.slices(batches):
            run.learn(lists(b))
        if run.n:
            yield _weights([(np.concatenate([run.model.w[k].reshape(-1) for k in names]) * np.float64(run.n)).astype("<f8")], [run.n])

    def added(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("n").to_pylist(), table.column("w").to_pylist()))
        return pa.Table.from_batches([_weights([sum(np.frombuffer(w, "<f8") for _, w in parts)], [sum(n for n, _ in parts)])])

    tasks = cut_rows.select("ids").mapInArrow(learned, "n long, w binary").withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(AVERAGED)))
    groups = sorted((r["n"], bytes(r["w"])) for r in tasks.groupBy("grp").applyInArrow(lambda t: added(t), "n long, w binary").collect())
    if groups:
        mean = sum(np.frombuffer(w, "<f8") for _, w in groups) / sum(n for n, _ in groups)
        for name, part in zip(names, np.split(mean, np.cumsum([model.w[k].size for k in names])[:-1])):
            model.w[name] = part.reshape(model.w[name].shape).astype(np.float32)
    return model


def _weights(weights: list[np.ndarray], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([w.tobytes() for w in weights], pa.binary())], ["n", "w"])


def _distinct(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different words in ascending order, each word's place there, number of words of each text); each different word is hashed once."""
    lists = pc.split_pattern(pa.array([(t or b"").translate(_SPACED) for t in texts], pa.large_string()), " ")
    words = lists.flatten().dictionary_encode()
    filled = pc.greater(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)
    h, place = np.unique(hashes([w for w in values(words.dictionary) if w]), return_inverse=True)
    of = np.zeros(len(filled), np.int64)
    of[filled] = place
    code = words.indices.to_numpy()
    real = filled[code]
    return h, of[code[real]], np.diff(np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()])


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as their lowest bytes, then their second ones and so on: the high ones, nearly all alike, are stored and moved as next to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _ask(keys, table):
    """A group's distinct words by bucket, and in one more row, of bucket -1, its documents with the place of each of their words there."""
    h, inverse, size = _distinct(raw(table.column("_text")))
    learn = np.repeat(table.column("_learn").to_numpy(), size)
    n = np.bincount(inverse, learn, len(h)).astype("<u4")
    bucket = ((h >> np.uint64(40)) * np.uint64(table.column("_buckets")[0].as_py()) >> np.uint64(24)).astype(np.int32)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut[1:], len(h)) if len(cut) else cut
    nothing = [None] * len(cut)
    whole = lambda name: pa.array([*nothing, table.column(name).to_pylist()], pa.list_(table.schema.field(name).type))
    return pa.table({"grp": pa.array([keys[0].as_py()] * (len(cut) + 1), pa.int32()), "bucket": pa.array(np.append(bucket[cut], np.int32(-1))),
                     "h": pa.array([*[h[i:j].tobytes() for i, j in zip(cut, ends)], None], pa.binary()), "n": pa.array([*[n[i:j].tobytes() for i, j in zip(cut, ends)], None], pa.binary()),
                     "key": whole("key"), "at": whole("_at"), "learn": whole("_learn"), "size": pa.array([*nothing, size.astype("<u4").tobytes()], pa.binary()), "place": pa.array([*nothing, _planes(inverse)], pa.binary())})


def _count(table):
    """Sums a bucket's counts and answers each group in its own order; the first row also has the bucket's known words and their sum."""
    part = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
    n = np.frombuffer(b"".join(table.column("n").to_pylist()), "<u4")
    h, inverse = np.unique(np.concatenate(part), return_inverse=True)
    total = np.bincount(inverse, n, len(h)).astype("<i8")
    answers = total[inverse]
    ends = np.cumsum([len(p) for p in part])
    return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "c": pa.array([answers[e - len(p):e].tobytes() for e, p in zip(ends, part)], pa.binary()),
                     "distinct": pa.array([int((total > 0).sum())] + [0] * (len(part) - 1), pa.int64()), "total": pa.array([int(total.sum())] + [0] * (len(part) - 1), pa.int64())})


def scores(docs: DataFrame, learn: Column, subwords: Subwords, model: Model, key: str = "doc_id", text: str = "text", cut_rows: DataFrame | None = None) -> DataFrame:
    """(key, learn, n_tokens, n_known, train_tokens, base_score, score) of every whole text, NULL as empty.

    Tokens are words with A to Z as small letters, and one end. base_score is the sum of
    log10((c + 0.1) / (N + 0.1 (V + 1))), with c, N and V from the rows that `learn` marks; score is the
    attention model's. Word counts are exact but for equal 64-bit hashes of different words: groups of
    documents ask buckets of hashes once per distinct word, so a frequent word is one row per group; texts are moved and cut into words once. NULL keys
    and repeated rows stay, and count as often as they occur. The model scores the ids of `cut_rows`, from `cut_texts`,
    where they are; its scores meet the base scores by key and hash of key and text.
    """
    spark = docs.sparkSession
    parts = shared.partitions(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("_text"), learn.alias("_learn"))
    rows = rows.withColumn("_at", F.xxhash64("key", "_text")).withColumn("_buckets", F.lit(parts)).withColumn("_grp", shared.spread(GROUPS_PER_PARTITION * parts, "key", "_text"))
    kind = docs.schema[key].dataType.simpleString()
    asked = shared.stored(rows.groupBy("_grp").applyInArrow(_ask, f"grp int, bucket int, h binary, n binary, key array<{kind}>, at array<bigint>, learn array<boolean>, size binary, place binary"), "zstd")
    told = shared.stored(asked.filter("bucket >= 0").select("grp", "bucket", "h", "n").groupBy("bucket").applyInArrow(_count, "grp int, bucket int, c binary, distinct long, total long"))
    known, words = told.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    shared_model = spark.sparkContext.broadcast(model)
    ends = docs.filter(learn).count()
    tokens = words + ends
    kinds = known + (ends > 0)
    floor = np.log10(tokens + SMOOTHING * (kinds + 1))
    kind_of_ids = _kind(subwords)

    def base_score(keys, table, told):
        size, place = np.frombuffer(table.column("size")[0].as_py(), "<u4").astype(np.int64), _of_planes(table.column("place")[0].as_py())
        answers = dict(zip(told.column("bucket").to_pylist(), told.column("c").to_pylist()))
        c = np.frombuffer(b"".join(answers[b] for b in sorted(answers)), "<i8")[place]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(size)])])
        each = np.log10(c + SMOOTHING) - floor
        base = np.array([part.sum() for part in np.split(each, np.cumsum(size)[:-1])]) + np.log10(ends + SMOOTHING) - floor
        n = len(size)
        key, at, learn = (table.column(x).combine_chunks().flatten() for x in ("key", "at", "learn"))
        return pa.table({"key": key, "at": at, "learn": learn, "n_tokens": pa.array(size + 1), "n_known": pa.array(sums(c > 0).astype(np.int64) + (ends > 0)),
                         "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(base, pa.float64())})

    def model_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches, 64):
            got = shared_model.value.score([np.frombuffer(x, kind_of_ids) for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("at"), pa.array(got, pa.float64())], ["key", "at", "score"])

    schema = f"key {kind}, at long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double"
    words_of = asked.filter("bucket < 0").select("grp", "key", "at", "learn", "size", "place")
    bases = words_of.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(base_score, schema)
    cut_rows = cut_texts(docs, learn, subwords, key, text) if cut_rows is None else cut_rows
    scored = cut_rows.select("key", "at", "ids").mapInArrow(model_score, f"key {kind}, at long, score double").groupBy("key", "at").agg(F.max("score").alias("score"))
    met = bases.alias("b").join(scored.alias("m"), F.col("b.key").eqNullSafe(F.col("m.key")) & (F.col("b.at") == F.col("m.at")))
    return met.select("b.key", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score")
