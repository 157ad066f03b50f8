"""Packs token sequences into as few fixed-size sequences as it can: best fit, then a local search by exchanges."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm import shared
from rillworks.llm.tokens import encoder

CAPACITY = 2048
GROUP = 8192
_BATCH = 1024


def pieces(docs: DataFrame, tokenizer: str, cuts: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every row: its ids and `end_id`, cut only if longer than `capacity`.

    Of a long row the first piece has what is over, the others `capacity` ids. `start` counts the row's ids
    before the piece. NULL texts are empty: one piece with the end id. NULL keys and repeated rows stay.
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField("key", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, cuts)
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                b = whole.slice(at, _BATCH)
                row, number, start, length, crc, ids = [], [], [], [], [], []
                for i, coded in enumerate(own.encode(b.column(1).to_pylist())):
                    coded += end
                    n = len(coded) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, z) in enumerate(zip(edges, edges[1:])):
                        part = coded[4 * a:4 * z]
                        row.append(i), number.append(k), start.append(a), length.append(z - a), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), [f.name for f in fields])
        shared.trim()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))


class _Bins:
    """Open bins by their space; one bit per space that some bin has, so the best fit is a shift and a lowest bit."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.space: list[int] = []
        self._at: list[set[int]] = [set() for _ in range(capacity + 1)]
        self._mask = 0

    def _out(self, b: int) -> None:
        r = self.space[b]
        self._at[r].discard(b)
        if not self._at[r]:
            self._mask &= ~(1 << r)

    def _in(self, b: int, space: int) -> None:
        self.space[b] = space
        self._at[space].add(b)
        self._mask |= 1 << space

    def best(self, length: int) -> int | None:
        above = self._mask >> length
        return None if not above else min(self._at[length + (above & -above).bit_length() - 1])

    def put(self, item: int, b: int | None = None) -> None:
        length = self.lengths[item]
        if b is None:
            b = self.best(length)
        if b is None:
            b = len(self.items)
            self.items.append([])
            self.space.append(self.capacity)
        else:
            self._out(b)
        self.items[b].append(item)
        self._in(b, self.space[b] - length)

    def take(self, item: int, b: int) -> None:
        self._out(b)
        self.items[b].remove(item)
        self._in(b, self.space[b] + self.lengths[item])

    def hide(self, b: int) -> None:
        self._out(b)

    def show(self, b: int) -> None:
        self._in(b, self.space[b])


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into `lengths` (each 1 to capacity), as few as found.

    Best fit in falling order first. Then the emptiest bin is the source: each of its items moves to the
    best-fitting other bin, or is exchanged, one for one or two for one, for a shorter item of another
    underfull bin that has room for the difference. Every step moves length from an emptier bin to a fuller
    one, so the sum of squared fills rises; a bin that becomes empty is gone. A source without a step is
    left. The search ends when no source is left or the number of bins is the least possible.
    """
    bins = _Bins(lengths, capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins.put(i)
    least, count = -(-sum(lengths) // capacity), len(bins.items)
    sources = sorted((b for b in range(count) if bins.space[b]), key=lambda b: -bins.space[b])
    for s in sources:
        if count <= least or sum(bins.space) - bins.capacity * (len(bins.items) - count) - bins.space[s] < capacity - bins.space[s]:
            break
        while bins.items[s] and _step(bins, s):
            pass
        if not bins.items[s]:
            count -= 1
            bins.hide(s)
    return [b for b in bins.items if b]


def _step(bins: _Bins, s: int) -> bool:
    """One exchange that empties bin `s` further, if there is one."""
    mine = sorted(bins.items[s], key=lambda i: -bins.lengths[i])
    bins.hide(s)
    for a in mine:
        target = bins.best(bins.lengths[a])
        if target is not None:
            bins.show(s)
            bins.take(a, s)
            bins.put(a, target)
            return True
    bins.show(s)
    fill = bins.capacity - bins.space[s]
    others = [(i, b) for b in range(len(bins.items)) if b != s and bins.space[b] and bins.capacity - bins.space[b] >= fill for i in bins.items[b]]
    if not others:
        return False
    length = np.array([bins.lengths[i] for i, _ in others])
    room = length + np.array([bins.space[b] for _, b in others])
    offers = [(a,) for a in mine] + [(a, c) for k, a in enumerate(mine) for c in mine[k + 1:]]
    for offer in offers:
        total = sum(bins.lengths[i] for i in offer)
        gain = np.where((length < total) & (total <= room), total - length, 0)
        k = int(gain.argmax())
        if gain[k]:
            item, target = others[k]
            for i in offer:
                bins.take(i, s)
            bins.take(item, target)
            bins.put(item, s)
            for i in offer:
                bins.put(i, target)
            return True
    return False


def placed(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, length: str = "length") -> DataFrame:
    """All columns of `parts` (one row per piece of 1 to `capacity` ids) with sequence_id and offset in it, gapless from 0.

    Pieces are dealt to groups of about `group`; each is packed alone, with its size bounded at any input.
    What stands in bins of less than 15/16 of the capacity is then dealt and packed once more across groups.
    Columns named sequence_id or offset are replaced; any other name may occur.
    """
    with shared.few_at_once(parts.sparkSession, _BATCH):
        parts = shared.stored(parts.drop("sequence_id", "offset"))
    place, dealt_to, done = (shared.fresh(n, parts.columns) for n in ("_row", "_grp", "_full"))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField(done, T.BooleanType())])

    def packed(df: DataFrame, turn: int) -> DataFrame:
        groups = max(1, -(-df.count() // group))

        def run(keys, table):
            table = table.drop_columns([dealt_to, place]).take(pc.sort_indices(table.column(place)))
            lengths = table.column(length).to_pylist()
            seq, offset, full = (np.zeros(len(lengths), np.int64) for _ in range(3))
            for n, members in enumerate(pack(lengths, capacity)):
                at = 0
                for i in members:
                    seq[i], offset[i], at = (turn << 56) + (keys[0].as_py() << 20) + n, at, at + lengths[i]
                full[members] = 16 * at >= 15 * capacity
            return table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset)).append_column(done, pa.array(full.astype(bool)))

        dealt = df.withColumn(place, F.monotonically_increasing_id()).withColumn(dealt_to, F.pmod(F.xxhash64(place), F.lit(groups)))
        return dealt.groupBy(dealt_to).applyInArrow(run, schema)

    first = shared.stored(packed(parts, 0))
    again = packed(first.filter(~F.col(done)).drop("sequence_id", "offset", done), 1)
    return first.filter(F.col(done)).union(again).drop(done)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from pieces with `ids`; a group holds at most one sequence."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
