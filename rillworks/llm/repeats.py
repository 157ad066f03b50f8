"""Removes long passages that an earlier document already holds, by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window; every rolling run of that
length probes them. A window holds a whole reference block, so passages shared by two documents always meet
in one. Anchors are then extended: all windows over an anchor are compared whole, by 128 bits, and the
document with the least key keeps them.

Documents are dealt to groups by content, hashes to buckets by value. A group asks a bucket about each
distinct hash once, in sorted order; the answer is one bit per question. A passage that a third of all
documents hold is one question per group, and no list of its places is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm import merkle, shared
from rillworks.llm.words import hashes, mixed, raw, rolling, words_of

WINDOW = 50
GROUPS_PER_PARTITION = 4

_LOW = np.int64((1 << 30) - 1)


class _Group:
    """The words of one group's documents, in key order, and what each round needs of them."""

    def __init__(self, table: pa.Table, key: str, text: str, window: int, buckets: int):
        keys = table.column(key)
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        keys = keys.fill_null(0).to_numpy()
        self.window, self.block, self.buckets = window, window // 2, buckets
        self.order = np.lexsort((keys, ~known))
        self.words = [words_of(t) for t in raw(table.column(text))]
        part = [i for i in self.order if known[i] and len(self.words[i]) >= window]
        self.rows = np.array(part, np.int64)
        self.keys = keys[self.rows]
        size = np.array([len(self.words[i]) for i in part], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.doc = np.repeat(np.arange(len(part)), size)
        # documents with the same key count as one
        self.number = np.unique(self.keys, return_inverse=True)[1] if len(part) else np.zeros(0, np.int64)
        self.w = hashes([w for i in part for w in self.words[i]])

    def _places(self, length: int) -> np.ndarray:
        """Starts of all runs of `length` words that lie in one document."""
        at = np.arange(max(0, len(self.w) - length + 1))
        return at[at + length <= self.end[self.doc[at]]] if len(at) else at

    def anchors(self):
        """Distinct 25-word runs: (key of each, first place in `order`, flags), with places ordered by key."""
        at = self._places(self.block)
        h = rolling(self.w, self.block)[at]
        key = (((h >> np.uint64(40)) * np.uint64(self.buckets)) >> np.uint64(24)).astype(np.int64) << 30 | (h.astype(np.int64) & _LOW)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        first = _firsts(key)
        last = np.append(first[1:], len(key)) - 1
        number = self.number[self.doc[at]]
        several = number[first] != number[last] if len(first) else np.zeros(0, bool)
        aligned = (at - self.start[self.doc[at]]) % self.block == 0
        is_block = np.add.reduceat(aligned.astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
        return at, key, first, is_block, several

    def ask_anchors(self, group: int) -> pa.Table:
        _, key, first, is_block, several = self.anchors()
        bucket = key[first] >> 30
        entry = ((key[first] & _LOW).astype(np.uint32) << np.uint32(2)) | (is_block.astype(np.uint32) << np.uint32(1)) | several.astype(np.uint32)
        cut = _firsts(bucket)
        ends = np.append(cut[1:], len(bucket)) if len(cut) else cut
        return pa.table({"grp": pa.array([group] * len(cut), pa.int32()), "bucket": pa.array(bucket[cut].astype(np.int32)),
                         "asked": pa.array([entry[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})

    def windows(self, told: dict[int, bytes]):
        """Windows over a shared anchor: (start, hash, second hash, document), ordered by hash and key."""
        at, key, first, _, _ = self.anchors()
        shared_key = _answers(key[first] >> 30, told)
        hit = np.zeros(len(self.w) + 1, np.int64)
        hit[at] = np.repeat(shared_key, np.diff(np.append(first, len(key)))) if len(first) else 0
        seen = np.concatenate([[0], np.cumsum(hit[:len(self.w)])])
        place = self._places(self.window)
        place = place[seen[place + self.window - self.block + 1] > seen[place]]
        a = rolling(self.w, self.window)[place]
        b = rolling(mixed(self.w), self.window, 1)[place]
        order = np.lexsort((place, b, a))
        place, a, b = place[order], a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return place, a, b, first

    def _bucket(self, a: np.ndarray) -> np.ndarray:
        return (((a >> np.uint64(40)) * np.uint64(self.buckets)) >> np.uint64(24)).astype(np.int64)

    def ask_windows(self, group: int, told: dict[int, bytes]) -> pa.Table:
        place, a, b, first = self.windows(told)
        a, b, keys = a[first], b[first], self.keys[self.doc[place[first]]] if len(first) else np.zeros(0, np.int64)
        bucket = self._bucket(a)
        cut = _firsts(bucket)
        ends = np.append(cut[1:], len(bucket)) if len(cut) else cut
        return pa.table({"grp": pa.array([group] * len(cut), pa.int32()), "bucket": pa.array(bucket[cut].astype(np.int32)),
                         **{n: pa.array([x[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()) for n, x in (("a", a), ("b", b), ("least", keys))}})

    def removed(self, told: dict[int, bytes], owned: dict[int, bytes]) -> dict[int, np.ndarray]:
        """Row of the table: mask of its words that an earlier document holds."""
        place, a, b, first = self.windows(told)
        if not len(first):
            return {}
        elsewhere = _answers(self._bucket(a[first]), owned)
        number = self.number[self.doc[place]]
        size = np.diff(np.append(first, len(place)))
        gone = place[np.repeat(elsewhere, size) | (number > np.repeat(number[first], size))]
        edge = np.zeros(len(self.w) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.window, -1)
        mask = np.cumsum(edge[:-1]) > 0
        return {int(self.rows[d]): mask[self.start[d]:self.end[d]] for d in np.unique(self.doc[gone])}


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _answers(bucket: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
    """One bit per question; buckets without an answer said no."""
    out = np.zeros(len(bucket), bool)
    cut = _firsts(bucket)
    for i, j in zip(cut, np.append(cut[1:], len(bucket))):
        bits = told.get(int(bucket[i]))
        if bits is not None:
            out[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
    return out


def _reply(table: pa.Table, size: list[int], bits: np.ndarray, kind: str) -> pa.Table:
    ends = np.cumsum(size)
    rows = [(g, k, np.packbits(bits[e - n:e]).tobytes()) for g, k, n, e in zip(table.column("grp").to_pylist(), table.column("bucket").to_pylist(), size, ends) if bits[e - n:e].any()]
    return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()),
                     "kind": pa.array([kind] * len(rows), pa.string()), "bits": pa.array([r[2] for r in rows], pa.binary())})


def _shared_anchors(table: pa.Table) -> pa.Table:
    """An anchor counts if two documents hold it and it is a reference block of one of them."""
    asked = [np.frombuffer(x, np.uint32) for x in table.column("asked").to_pylist()]
    entry = np.concatenate(asked)
    order = np.argsort(entry >> np.uint32(2), kind="stable")
    sorted_entry = entry[order]
    first = _firsts(sorted_entry >> np.uint32(2))
    size = np.diff(np.append(first, len(entry)))
    several = (size > 1) | (np.bitwise_or.reduceat(sorted_entry & np.uint32(1), first) > 0)
    block = np.bitwise_or.reduceat(sorted_entry & np.uint32(2), first) > 0
    bits = np.zeros(len(entry), bool)
    bits[order] = np.repeat(several & block, size)
    return _reply(table, [len(x) for x in asked], bits, "anchor")


def _owned_elsewhere(table: pa.Table) -> pa.Table:
    """A question is answered yes if the window starts in a document with a smaller key than the asked one."""
    part = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
    a = np.concatenate(part)
    b = np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint64)
    least = np.frombuffer(b"".join(table.column("least").to_pylist()), np.int64)
    order = np.lexsort((least, b, a))
    x, y, z = a[order], b[order], least[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    bits = np.zeros(len(a), bool)
    bits[order] = z > np.repeat(z[first], np.diff(np.append(first, len(a))))
    return _reply(table, [len(p) for p in part], bits, "window")


_REPLY = "grp int, bucket int, kind string, bits binary"


def _told(table: pa.Table, kind: str) -> dict[int, bytes]:
    return {k: v for k, t, v in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("bits").to_pylist()) if t == kind}


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of `docs`, with `text` freed of repeated passages, and n_words, n_removed, removed.

    A window is `window` consecutive words of one row. A word goes if a window over it also starts in a row
    with a smaller key; windows are judged on the input. Texts that lose nothing stay as they are; of others
    the kept words remain, joined by one space. `removed` lists [from, to) word spans. NULL texts have no
    words and stay NULL; rows with a NULL key neither lose words nor make others lose any; rows that share
    a key don't count as earlier than one another. Keys may be of any type that can be ordered. Columns named like
    the added ones are replaced; any other name may occur.
    """
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.LongType):
        number = shared.fresh("_number", docs.columns)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            numbered = docs.withColumn(number, F.col(key).cast("long"))
        else:  # the places of the keys in their order stand for them
            keys = docs.select(F.col(key).alias("k"), F.lit("").alias("tree")).filter("k IS NOT NULL").distinct()
            ranks = shared.stored(merkle.places(keys, "tree", [F.col("k")]).select(F.col("k").alias(number + "k"), F.col("pos").alias(number)))
            numbered = docs.join(ranks, F.col(key) == F.col(number + "k"), "left").drop(number + "k")
        return without_repeats(numbered, number, text, window).drop(number)
    if window < 2 or window % 2:
        raise ValueError("a window is an even number of words")
    spark = docs.sparkSession
    parts = shared.partitions(spark)
    groups = GROUPS_PER_PARTITION * parts
    docs = docs.drop("n_words", "n_removed", "removed")
    grp = shared.fresh("_grp", docs.columns)
    base = docs.withColumn(grp, shared.spread(groups, key, text))

    def first(keys, table):
        shared.trim()
        g = keys[0].as_py()
        return _Group(table, key, text, window, parts).ask_anchors(g)

    def second(keys, table, told):
        shared.trim()
        if not table.num_rows:
            return pa.table({"grp": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in ("a", "b", "least")}})
        return _Group(table, key, text, window, parts).ask_windows(keys[0].as_py(), _told(told, "anchor"))

    spans = T.ArrayType(T.ArrayType(T.LongType()))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", spans)])

    def last(keys, table, told):
        shared.trim()
        group = _Group(table, key, text, window, parts)
        gone = group.removed(_told(told, "anchor"), _told(told, "window"))
        texts = table.column(text).to_pylist()
        lost, cuts = [], []
        for i, words in enumerate(group.words):
            mask = gone.get(i)
            lost.append(0 if mask is None else int(mask.sum()))
            cuts.append([] if mask is None else np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2).tolist())
            if mask is not None:
                texts[i] = b" ".join([w for w, m in zip(words, mask) if not m]).decode()
        names = [n for n in table.column_names if n != grp]
        out = {n: table.column(n) for n in names} | {text: pa.array(texts, table.schema.field(text).type)}
        return pa.table({**out, "n_words": pa.array([len(w) for w in group.words], pa.int64()), "n_removed": pa.array(lost, pa.int64()),
                         "removed": pa.array(cuts, pa.list_(pa.list_(pa.int64())))})

    grouped = base.groupBy(grp)
    anchors = grouped.applyInArrow(first, "grp int, bucket int, asked binary").groupBy("bucket").applyInArrow(_shared_anchors, _REPLY)
    anchors = shared.stored(anchors)
    windows = grouped.cogroup(anchors.groupBy("grp")).applyInArrow(second, "grp int, bucket int, a binary, b binary, least binary")
    owned = windows.groupBy("bucket").applyInArrow(_owned_elsewhere, _REPLY)
    return grouped.cogroup(anchors.union(owned).groupBy("grp")).applyInArrow(last, schema)
