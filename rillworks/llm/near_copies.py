"""Near copies by 64-bit fingerprints of word shingles, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rillworks.llm import components, shared
from rillworks.llm.words import LOWER, SEED, raw, words_of

SHINGLE = 3
RADIUS = 2
BLOCKS = 6
_CHUNK = 1 << 16
_JOBS = 1 << 18


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit j is set if it is set in over half of the shingle hashes (XXH64, seed 42); no words: 0."""
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = h[i:i + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): one row per row of `docs`, fp the fingerprint as a signed long. NULL texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches):
            fps = np.array([fingerprint(words_of(t and t.translate(LOWER)), shingle) for t in raw(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Each mask keeps all but `radius` blocks of bits: fingerprints at `radius` or fewer differing bits agree under one of them."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked elements the least label of their class, in place."""
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(label[label], label):
            label[:] = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]


def close_within(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Class label (least index) of each fingerprint, linking those of one run that differ in `radius` or fewer bits.

    A run is cut into words of 64 lanes, one bit plane each. A fingerprint is compared with all lanes of a
    word at once: each differing plane is added into two carry-save counters and an overflow plane per lane.
    A word is abandoned for a fingerprint as soon as all its lanes exceed the radius.
    """
    if not 1 <= radius <= 3:
        raise ValueError("two counter planes count differences up to 3")
    label = np.arange(len(fps))
    size = ends - starts
    words = -(-size // 64)
    first_word = np.cumsum(words) - words
    member = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if len(starts) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(starts)), size)
    place = member - starts[run]
    word, lane = first_word[run] + place // 64, (place % 64).astype(np.uint64)
    total = int(words.sum())
    planes, valid = np.zeros((64, total), np.uint64), np.zeros(total, np.uint64)
    np.bitwise_or.at(valid, word, np.uint64(1) << lane)
    base = np.zeros(total, np.int64)
    base[word] = member - lane.astype(np.int64)
    for j in range(64):
        np.bitwise_or.at(planes[j], word, ((fps[member] >> np.uint64(j)) & np.uint64(1)) << lane)
    # a fingerprint meets the words from its own onward: each pair once
    own = word
    last = first_word[run] + words[run]
    jobs = np.cumsum(last - own)
    at = 0
    while at < len(member):
        upto = max(at + 1, int(np.searchsorted(jobs, (jobs[at - 1] if at else 0) + _JOBS, side="right")))
        count = last[at:upto] - own[at:upto]
        who = np.repeat(np.arange(at, upto), count)
        w = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + own[who]
        mine = fps[member[who]]
        one, two, over = (np.zeros(len(who), np.uint64) for _ in range(3))
        for j in range(64):
            differ = planes[j][w] ^ (np.uint64(0) - ((mine >> np.uint64(j)) & np.uint64(1)))
            carry = one & differ
            one ^= differ
            over |= two & carry
            two ^= carry
            if j % 8 == 7:
                alive = (valid[w] & ~_exceeds(one, two, over, radius)) != 0
                if not alive.all():
                    who, w, mine, one, two, over = (x[alive] for x in (who, w, mine, one, two, over))
                if not len(who):
                    break
        near = valid[w] & ~_exceeds(one, two, over, radius) if len(who) else np.zeros(0, np.uint64)
        for i in range(0, len(near), _CHUNK // 8):
            bits = np.unpackbits(near[i:i + _CHUNK // 8].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            job, hit = np.nonzero(bits)
            _union(label, member[who[i + job]], base[w[i + job]] + hit)
        at = upto
    return label


def _exceeds(one: np.ndarray, two: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (one + 2 * two, or over) is above the radius."""
    if radius == 3:
        return over
    return over | (two & one) if radius == 2 else over | two


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(u, v): for distinct fingerprints (rep, fp), links that span the same classes as all pairs within the radius; v < u.

    Fingerprints meet under each mask of `masks`; with 6 blocks and radius 2 a bucket shares about 42 bits, so
    it holds at most 2^22 of them. A bucket gives one link per member, never all its pairs.
    """
    keep = masks(radius, blocks)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in keep]
    keyed = fps.select("rep", "fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("slot", "mask"))
    keyed = keyed.select("slot", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "rep", "fp")

    kind = to_arrow_type(fps.schema["rep"].dataType)  # any that can be ordered

    def found(slot, part, rep, fp):
        change = np.flatnonzero((slot[1:] != slot[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(slot)]])
        many = ends - starts > 1
        label = close_within(fp.view(np.uint64), starts[many], ends[many], radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rep[moved], kind), pa.array(rep[label[moved]], kind)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            slot, part = held[0], held[1]
            if not len(slot):
                continue
            whole = np.flatnonzero((slot[1:] != slot[:-1]) | (part[1:] != part[:-1]))
            if len(whole):  # all runs but the last are complete
                cut = int(whole[-1]) + 1
                yield found(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield found(*held)
        shared.trim()

    ddl = fps.schema["rep"].dataType.simpleString()
    placed = keyed.repartition("slot", "part").sortWithinPartitions("slot", "part", "rep")
    return placed.mapInArrow(run, f"u {ddl}, v {ddl}").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component): every row with its fingerprint and the least key of its class.

    Classes are the components of all rows whose fingerprints differ in `radius` or fewer bits. Equal
    fingerprints are reduced to their least key before they are compared. Texts that are NULL, empty or
    blank have fingerprint 0 and link like any other. Rows with a NULL key get the class of their
    fingerprint; a fingerprint with NULL keys only gets a NULL class. Repeated rows stay repeated.
    """
    fps = shared.stored(fingerprints(docs, key, text, shingle))
    distinct = fps.groupBy("fp").agg(F.min("key").alias("rep")).filter("rep IS NOT NULL")
    distinct = shared.stored(distinct)
    roots = components.components(links(distinct, radius))
    named = distinct.join(roots.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(named, "fp", "left").select("key", "fp", "component")


def grouped(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """All columns of `docs`, number (a stored number of each row) and component, the least number of its class; keys play no part.

    Columns of `docs` with these two names are replaced."""
    numbered = shared.stored(docs.drop("number", "component").withColumn("number", F.monotonically_increasing_id()))
    named = classes(numbered, "number", text, shingle, radius).select(F.col("key").alias("number"), "component")
    return numbered.join(named, "number")
