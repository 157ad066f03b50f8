"""Keyed state for streams: unfinished frames and lines, the state of shedding, silent agents, contents seen.

Within a micro-batch the rows of a key come in no certain order and may be many, so the byte streams order them by
sorted runs that are merged: beyond `held` bytes, runs stand in map state and not in memory. What is unfinished stands
there as numbered pieces, which are read once they are complete. Results leave in batches of bounded size.
"""

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillworks.model import HEADER_BYTES, LARGEST_FRAME, MAGIC, VERSION

_START = MAGIC.to_bytes(4, "little") + VERSION.to_bytes(2, "little")
HELD_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
_BLOCK_BYTES = 64 << 10
_OUT_BYTES = 4 << 20
_ROW_BYTES = 64  # besides its data, about


def _ordered(rows: Iterator[pd.DataFrame], by: str | list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by)


class _Runs:
    """Orders the chunks of a key's micro-batch by sequence number, with at most `held` bytes and a block per run in memory."""

    def __init__(self, handle: StatefulProcessorHandle, held: int, ttl: int | None):
        self.held = held
        self.blocks = handle.getMapState("runs", "run int, block int", "seqs array<long>, ends array<int>, data binary", ttl)

    def ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bytes]]:
        runs, chunks, size = [], [], 0
        for frame in rows:
            for seq, data in zip(frame["seq"], frame["data"]):
                chunks.append((int(seq), bytes(data)))
                size += len(data) + _ROW_BYTES
                if size > self.held:
                    runs.append(self._written(len(runs), chunks))
                    chunks, size = [], 0
        chunks.sort(key=lambda c: c[0])
        return heapq.merge(*[self._read(run, n) for run, n in enumerate(runs)], chunks, key=lambda c: c[0]) if runs else iter(chunks)

    def _written(self, run: int, chunks: list[tuple[int, bytes]]) -> int:
        """Number of the run's blocks."""
        chunks.sort(key=lambda c: c[0])
        n, block, size = 0, [], 0
        for i, (seq, data) in enumerate(chunks):
            block.append((seq, data))
            size += len(data) + _ROW_BYTES
            if size >= _BLOCK_BYTES or i + 1 == len(chunks):
                ends, at = [], 0
                for _, d in block:
                    at += len(d)
                    ends.append(at)
                self.blocks.updateValue((run, n), ([q for q, _ in block], ends, b"".join(d for _, d in block)))
                n, block, size = n + 1, [], 0
        return n

    def _read(self, run: int, n: int) -> Iterator[tuple[int, bytes]]:
        for i in range(n):
            seqs, ends, data = self.blocks.getValue((run, i))
            self.blocks.removeKey((run, i))
            at = 0
            for seq, end in zip(seqs, ends):
                yield seq, bytes(data[at:end])
                at = end


class _Unfinished:
    """Bytes that wait for more: numbered pieces in map state, and less than a piece in memory."""

    def __init__(self, handle: StatefulProcessorHandle, ttl: int | None):
        self.pieces = handle.getMapState("pieces", "piece int", "data binary", ttl)

    def open(self, stored: int) -> None:
        self.stored, self.parts, self.size = stored, [], 0

    def add(self, data: bytes) -> None:
        if data:
            self.parts.append(data)
            self.size += len(data)
        if self.size >= PIECE_BYTES:
            self.store()

    def store(self) -> None:
        if self.parts:
            self.pieces.updateValue((self.stored,), (b"".join(self.parts),))
            self.open(self.stored + 1)

    def take(self) -> bytes:
        """All of them, in order; nothing is kept."""
        stored = []
        for i in range(self.stored):
            stored.append(bytes(self.pieces.getValue((i,))[0]))
            self.pieces.removeKey((i,))
        data = b"".join(stored + self.parts)
        self.open(0)
        return data

    def drop(self) -> None:
        for i in range(self.stored):
            self.pieces.removeKey((i,))
        self.open(0)


def _batched(stream: str, values: Iterable[bytes], column: str) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value) + _ROW_BYTES
        if size >= _OUT_BYTES:
            yield pd.DataFrame({"stream": [stream] * len(held), column: held})
            held, size = [], 0
    if held:
        yield pd.DataFrame({"stream": [stream] * len(held), column: held})


class FrameAssembler(StatefulProcessor):
    """(stream, raw) of complete frames from (stream, seq, data) chunks; a bad header, or one that announces more than
    LARGEST_FRAME bytes, closes the stream.

    With `idle_ms`, a connection without data for that long is gone, and its state with it."""

    def __init__(self, idle_ms: int | None = None, held: int = HELD_BYTES):
        self.idle_ms, self.held = idle_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "header binary, missing long, stored int, closed boolean", self.idle_ms)
        self.runs = _Runs(handle, self.held, self.idle_ms)
        self.payload = _Unfinished(handle, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        header, missing, stored, closed = self.place.get() if self.place.exists() else (b"", 0, 0, False)
        self.header, self.missing, self.closed = bytes(header), missing, closed
        self.payload.open(stored)
        yield from _batched(key[0], self._frames(self.runs.ordered(rows)), "raw")
        self.payload.store()
        self.place.update((self.header, self.missing, self.payload.stored, self.closed))

    def _frames(self, chunks: Iterator[tuple[int, bytes]]) -> Iterator[bytes]:
        for _, data in chunks:
            at = 0
            while at < len(data) and not self.closed:
                if len(self.header) < HEADER_BYTES:
                    part = data[at:at + HEADER_BYTES - len(self.header)]
                    self.header += part
                    at += len(part)
                    if len(self.header) < HEADER_BYTES:
                        break
                    self.missing = int.from_bytes(self.header[8:12], "little")
                    self.closed = self.header[:6] != _START or self.missing + HEADER_BYTES > LARGEST_FRAME
                    if self.closed:
                        self.header, self.missing = b"", 0
                        break
                part = data[at:at + self.missing]
                self.payload.add(part)
                at += len(part)
                self.missing -= len(part)
                if not self.missing:
                    yield self.header + self.payload.take()
                    self.header = b""

    def close(self) -> None:
        pass


class LineAssembler(StatefulProcessor):
    """(stream, line) of complete lines from (stream, seq, data) chunks; bytes are kept until the line feed,
    however long the file is idle; nothing is kept for a file that ends with a line feed.

    A chunk that does not come after the one that left the kept bytes begins a new file at the same place: the
    kept bytes are then a line of their own, or are dropped with `keep_cut` false."""

    def __init__(self, keep_cut: bool = True, held: int = HELD_BYTES):
        self.keep_cut, self.held = keep_cut, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "stored int, seq long")
        self.runs = _Runs(handle, self.held, None)
        self.tail = _Unfinished(handle, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored, self.last = self.place.get() if self.place.exists() else (0, None)
        self.tail.open(stored)
        yield from _batched(key[0], self._lines(self.runs.ordered(rows)), "line")
        self.tail.store()
        if self.tail.stored:
            self.place.update((self.tail.stored, self.last))
        else:
            self.place.clear()

    def _lines(self, chunks: Iterator[tuple[int, bytes]]) -> Iterator[bytes]:
        before, first = self.last, True
        for seq, data in chunks:
            if first and before is not None and seq <= before:
                if self.keep_cut:
                    yield self.tail.take()
                else:
                    self.tail.drop()
            first, self.last = False, seq
            *whole, rest = data.split(b"\n")
            for line in whole:
                self.tail.add(line)
                yield self.tail.take()
            self.tail.add(rest)

    def close(self) -> None:
        pass


class Shedder(StatefulProcessor):
    """(session, seq, accepted, level, closed) from recorded changes of a session's buffer, as the batch forms
    `shed_hysteresis` and `session_close` have it. With `idle_ms`, state goes when a session has no rows for
    that long."""

    def __init__(self, high: int, low: int, full_seconds: int, idle_ms: int | None = None):
        self.idle_ms = idle_ms
        self.marks = (high, low)
        self.full_us = full_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "level long, shedding boolean, first_drop long, closed boolean", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        level, shedding, first, closed = self.buffer.get() if self.buffer.exists() else (0, False, -1, False)
        high, low = self.marks
        out = []
        for seq, us, change in _ordered(rows, "seq")[["seq", "us", "change"]].itertuples(index=False):
            shedding = level >= low if shedding else level > high
            message = change >= 0
            out.append((key[0], seq, not shedding if message else None, level, closed))
            level += change
            if message and shedding:
                first = us if first < 0 else first
                closed = closed or us - first > self.full_us
        self.buffer.update((int(level), bool(shedding), int(first), bool(closed)))
        yield pd.DataFrame(out, columns=["session", "seq", "accepted", "level", "closed"])

    def close(self) -> None:
        pass


class AgentLife(StatefulProcessor):
    """(agent, event, us, info) as `metrics.life_events` tells them, from beats (agent, seq, us, told); `down` comes from a timer in
    event time, so an agent that falls silent is told without a further row of its own.

    Beats of an agent may come in any order within a micro-batch; one that is older than a beat of an earlier batch changes nothing."""

    def __init__(self, gap_seconds: int):
        self.gap_us = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "us long, seq long, info string, up boolean, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, seq, info, up, timer = self.seen.get() if self.seen.exists() else (-1, -1, None, False, -1)
        out = []
        for now, n, told in _ordered(rows, ["us", "seq"])[["us", "seq", "told"]].itertuples(index=False):
            now, n, told = int(now), int(n), told if isinstance(told, str) else None
            if (now, n) <= (us, seq):
                continue
            if up and now - us > self.gap_us:
                out.append((key[0], "down", us, info))
                up = False
            if not up or (told is not None and told != info):
                info = info if told is None else told
                out.append((key[0], "changed" if up else "up", now, info))
            us, seq, up = now, n, True
        # the first millisecond by which the silence is too long
        ends = (us + self.gap_us) // 1000 + 1
        if up and ends != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
            timer = ends
        self.seen.update((us, seq, info, up, timer))
        yield from _life(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, seq, info, up, _ = self.seen.get()
        self.seen.update((us, seq, info, False, -1))
        yield from _life([(key[0], "down", us, info)] if up else [])

    def close(self) -> None:
        pass


def _life(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=["agent", "event", "us", "info"])


class FirstContents(StatefulProcessor):
    """(topic, partition, offset, duplicate) for rows (topic, shard, partition, offset, us, digest): whether an earlier row has the content.

    A row is judged once the watermark has passed it: until then an earlier one may come. Then nothing before it is missing, so
    rows are judged in the order of (us, partition, offset) whatever micro-batches they came in. Digests stay for `retention_us` after
    their first arrival, or for ever."""

    def __init__(self, retention_us: int | None = None):
        self.retention_us = retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, partition int, offset long", "digest string")
        self.seen = handle.getMapState("seen", "digest string", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = -1
        for frame in rows:
            for us, partition, offset, digest in frame[["us", "partition", "offset", "digest"]].itertuples(index=False):
                self.waiting.updateValue((int(us), int(partition), int(offset)), (digest,))
                last = max(last, int(us))
        if last >= 0:
            self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        ripe = sorted((place, value[0]) for place, value in self.waiting.iterator() if place[0] < until)
        out = []
        for place, digest in ripe:
            us, partition, offset = place
            first = self.seen.getValue((digest,))[0] if self.seen.containsKey((digest,)) else None
            repeated = first is not None and (self.retention_us is None or us - first <= self.retention_us)
            if not repeated:
                self.seen.updateValue((digest,), (us,))
            self.waiting.removeKey(place)
            out.append((key[0], partition, offset, repeated))
        if self.retention_us is not None:
            for digest in [d for d, value in self.seen.iterator() if value[0] < until - self.retention_us]:
                self.seen.removeKey(digest)
        if out:
            yield pd.DataFrame(out, columns=["topic", "partition", "offset", "duplicate"])

    def close(self) -> None:
        pass
