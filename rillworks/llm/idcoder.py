"""A context-mixing range coder for token ids, many blocks side by side.

Each block of ids starts from an empty model and stands alone. Within a block an id is a slot: its number, from 1, in
order of first appearance. Three orders predict the next slot: order 2 from the two slots before, order 1
from one, order 0 from how often each slot occurred. Counts of what came true, by the confidence of each
order, are mixed into the probabilities of four events: order 2 was right, order 1 was right, another known
slot, an escape. The event, then a slot by order 0 or the escaped id, drive the range coder. All blocks of a
batch advance together, one id at a time, as numpy lanes; encoder and decoder run the same integer model.

What a lane does is chosen by arithmetic with 0 and 1, as the processor can't foresee a choice between two values.
The range coder's integers stay below 2^53 and are doubles, which are divided and rounded down exactly.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
_FIRST, _GROWTH = 32, 2
_PAIRS = 1024
_CHUNK = 64
_TOP, _BOTTOM, _WORD = float(1 << 48), float(1 << 32), float(1 << 16)
#: Above so many ids, words leave the span between an event and an id too, or it gets too narrow.
_WIDE = 1 << 17
_ONES = np.uint64(0x0001000100010001)
_FIELD = np.uint64(1) << np.arange(0, 64, 16, dtype=np.uint64)
_U1, _U2, _U16, _U48 = (np.uint64(x) for x in (1, 2, 16, 48))
_NEXT, _HASH1, _HASH2, _MASK = (np.uint16(x) for x in (1, 40503, 9973, _PAIRS - 1))


class Damaged(ValueError):
    """The bytes aren't what was written."""


def _zeros(shape: int | tuple[int, int], kind: type) -> np.ndarray:
    """Zeros in the large pages that numpy asks for in np.empty: every lane is on a page of its own otherwise."""
    out = np.empty(shape, kind)
    out.fill(0)
    return out


class _Mixer:
    """Adaptive state of all lanes. Entries of order 1 and, behind them, order 2 hold slot * 4 + confidence, 0 if nothing was seen.

    The counts of the four events are fields of 16 bits of one integer: a block is short enough that their
    mixed sums stay below 2^16, so one multiplication gives all cumulative frequencies. Order 0 is counted anew after
    32, 64, 128 .. ids; a slot that is new since then counts once.
    """

    def __init__(self, lanes: int, block: int, vocabulary: int, inverse: bool):
        if 7 * block + 4 >= 1 << 16:
            raise ValueError("a block is too long for the event counts")
        self.lanes, self.block, self.inverse = lanes, block, inverse
        lane = np.arange(lanes)
        self.base = np.concatenate([lane * (block + 1), lanes * (block + 1) + lane * _PAIRS])
        self.base_event, self.base_trust = lane * 4, np.arange(2 * lanes) * 4
        self.seen = _zeros(lanes * (block + 1 + _PAIRS), np.uint16)
        self.events0, self.events = np.full(lanes, _ONES), np.zeros(lanes * 8, np.uint64)
        self.context, self.slots = np.zeros(2 * lanes, np.uint16), np.zeros(lanes, np.uint16)
        self.totals = np.ones(lanes * 4)  # by event: of what stands behind it
        self.totals[3::4] = vocabulary
        self.count = _zeros((lanes, block + 1), np.uint16)
        if inverse:
            self.table, self.base_place = np.empty(lanes * (block + 1), np.int32), np.empty(lanes, np.int64)
        else:
            self.intervals = np.empty((block, lanes), np.int32)
        self.step = self.counted = 0

    def predict(self) -> None:
        """Sets the slots that order 1 and order 2 expect, and the events' frequencies: field k of `cum` has the sum up to event k."""
        self.at = self.base + self.context
        self.entry = self.seen.take(self.at)
        self.guess = (self.entry >> 2).reshape(2, -1)
        self.trust = self.entry & 3
        self.at_trust = self.base_trust + self.trust
        self.found = self.events.take(self.at_trust)
        self.mixed = self.events0 + (self.found[:self.lanes] << _U1) + (self.found[self.lanes:] << _U2)
        self.cum = self.mixed * _ONES

    def span_of(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of an event's interval."""
        self.at_event = self.base_event + event
        return _fields(self.cum << _U16).take(self.at_event), _fields(self.mixed).take(self.at_event)

    def learn(self, slot: np.ndarray, event: np.ndarray, new: np.ndarray, history: np.ndarray) -> None:
        more = _FIELD.take(event)
        self.events0 += more
        self.events[self.at_trust] = (self.found.reshape(2, -1) + more).reshape(-1)
        hit = (self.guess == slot).reshape(-1)
        stays = hit | (self.trust > 1)
        changed = self.entry + (hit & (self.trust < 3)) - (stays ^ hit)
        fresh = (slot << 2) + _NEXT
        self.seen[self.at] = ((changed.reshape(2, -1) - fresh) * stays.reshape(2, -1) + fresh).reshape(-1)
        self.context[self.lanes:] = (slot * _HASH1 + self.context[:self.lanes] * _HASH2) & _MASK
        self.context[:self.lanes] = slot
        self.slots += new
        self.totals[2::4] += new
        self.step += 1
        if self.step == self.due:
            self.refresh(history)

    def refresh(self, history: np.ndarray) -> None:
        """Order 0 over the slots so far: start and width - 1 << 16 of each slot's interval.

        The decoder gets them in `table` by slot, where slot 0 has those of other events, and the slot at each place; the encoder, whose
        history goes on, in `intervals` by step.
        """
        t = self.step
        self.due = min(max(t + _FIRST, t * _GROWTH), self.block)
        most = int(self.slots.max())
        wide = most + self.due - t
        if self.inverse:
            self.base_table = np.arange(self.lanes) * (wide + 1)
        numbers, places, before = np.arange(wide + 1, dtype=np.uint16), [], 0
        for i in range(0, self.lanes, _CHUNK):
            count = self.count[i:i + _CHUNK]
            n = len(count)
            part = history[self.counted:t, i:i + n].T + (np.arange(n) * (most + 1))[:, None]
            count[:, :most + 1] += np.bincount(part.reshape(-1), minlength=n * (most + 1)).reshape(n, -1).astype(np.uint16)
            each = np.ones((n, wide + 1), np.int32)
            each[:, 0] = 0
            np.maximum(count[:, 1:most + 1], 1, out=each[:, 1:most + 1])
            end = np.cumsum(each, axis=1, dtype=np.int32)
            table = end + each * 0xFFFF - (1 << 16)
            table[:, 0] = 0
            if not self.inverse:
                self.intervals[t:self.due, i:i + n] = table.take(history[t:self.due, i:i + n] + np.arange(n) * (wide + 1))
            else:
                self.table[i * (wide + 1):(i + n) * (wide + 1)] = table.reshape(-1)
                places.append(np.repeat(np.broadcast_to(numbers, each.shape).reshape(-1), each.reshape(-1)))
                size = end[:, -1].astype(np.int64)
                self.base_place[i:i + n] = before + np.cumsum(size) - size
                before += int(size.sum())
        if self.inverse:
            self.by_place = np.concatenate(places)
        self.counted = t
        self.totals[2::4] = max(t, 1)


def _fields(x: np.ndarray) -> np.ndarray:
    """The 16-bit fields of 64-bit integers, low ones first."""
    return x.astype("<u8", copy=False).view("<u2")


def _event(past2: np.ndarray, past1: np.ndarray, new: np.ndarray) -> np.ndarray:
    return (past2.view(np.int8) + past1.view(np.int8) + new.view(np.int8)).astype(np.intp)


def _slots(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By step and row: each id's number in order of first appearance in its row, whether it appears first, and then the id, else 0."""
    lanes, n = ids.shape
    slots, new, escapes = np.empty((n, lanes), np.uint16), np.empty((n, lanes), bool), np.empty((n, lanes), np.uint32)
    group = max(1, min(8, (1 << 22) // vocabulary))
    steps = np.tile(np.arange(n, dtype=np.uint16), group).reshape(group, n)
    first = np.empty(group * min(vocabulary, 1 << 22), np.uint16)
    for i in range(0, lanes, group):
        part = ids[i:i + group]
        k = len(part)
        if vocabulary > 1 << 22:  # a row at a time; a number for each different id
            key = np.unique(part, return_inverse=True)[1].reshape(part.shape)
        else:
            key = part + (np.arange(k) * vocabulary)[:, None]
        first[key[:, ::-1].reshape(-1)] = steps[:k, ::-1].reshape(-1)
        at = first.take(key)
        fresh = at == steps[:k]
        rank = np.cumsum(fresh, axis=1, dtype=np.uint16)
        slots[:, i:i + k] = rank.take(at + (np.arange(k) * n)[:, None]).T
        new[:, i:i + k] = fresh.T
        escapes[:, i:i + k] = (part * fresh).T
    return slots, new, escapes


def _encode_lanes(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    lanes, n = ids.shape
    slots, news, escapes = _slots(ids, vocabulary)
    m = _Mixer(lanes, n, vocabulary, False)
    m.refresh(slots)
    room = (2 if vocabulary <= _WIDE else 4) * n + 4
    out = _zeros(lanes * room, np.uint16)
    base = np.arange(lanes) * room
    at = base.copy()
    low, span = np.zeros(lanes), np.full(lanes, _TOP - 1)

    def carry(over):
        low[over] -= _TOP
        back = at[over] - 1
        while len(back):
            out[back] += _NEXT
            back = back[out[back] == 0] - 1

    def narrow(low, span):
        small = span < _BOTTOM
        word = np.floor(low * (1 / _BOTTOM))
        out[at] = word.astype(np.uint16)
        factor = small * (_WORD - 1) + 1
        low = (low - word * small * _BOTTOM) * factor
        span = span * factor
        np.add(at, small, out=at)
        while len(left := np.flatnonzero(span < _BOTTOM)):
            word = np.floor(low[left] * (1 / _BOTTOM))
            out[at[left]] = word.astype(np.uint16)
            at[left] += 1
            low[left] = (low[left] - word * _BOTTOM) * _WORD
            span[left] *= _WORD
        return low, span

    for t in range(n):
        slot, new = slots[t], news[t]
        m.predict()
        past2 = slot != m.guess[1]
        past1 = past2 & (slot != m.guess[0])
        event = _event(past2, past1, new)
        start, freq = m.span_of(event)
        unit = np.floor(span / (m.cum >> _U48))
        low += unit * start
        span = unit * freq
        if vocabulary > _WIDE:
            carry(np.flatnonzero(low >= _TOP))
            low, span = narrow(low, span)
        place = m.intervals[t] * (past1 ^ new)
        unit = np.floor(span / m.totals.take(m.at_event))
        low += unit * ((place & 0xFFFF) + escapes[t])
        span = unit * ((place >> 16) + 1)
        if len(over := np.flatnonzero(low >= _TOP)):
            carry(over)
        low, span = narrow(low, span)
        m.learn(slot, event, new, slots)
    value = np.ceil(low * (1 / _WORD))  # the upper 32 bits, rounded up: it stays in the span whatever follows
    low = value * _WORD
    if len(over := np.flatnonzero(low >= _TOP)):
        carry(over)
    for _ in range(2):
        word = np.floor(low * (1 / _BOTTOM))
        out[at] = word.astype(np.uint16)
        at += 1
        low = (low - word * _BOTTOM) * _WORD
    return [out[a:z].astype("<u2", copy=False).tobytes() for a, z in zip(base.tolist(), at.tolist())]


def _decode_lanes(coded: list[bytes], n: int, vocabulary: int) -> np.ndarray:
    lanes = len(coded)
    words = np.frombuffer(b"".join(coded) + bytes(16), "<u2")
    size = np.array([len(c) // 2 for c in coded])
    at = np.cumsum(size) - size
    history, news, names = np.empty((n, lanes), np.uint16), np.empty((n, lanes), bool), np.empty((n, lanes), np.uint32)
    m = _Mixer(lanes, n, vocabulary, True)
    m.refresh(history)
    code, span = np.zeros(lanes), np.full(lanes, _TOP - 1)
    for _ in range(3):
        code = code * _WORD + words.take(at, mode="clip")
        at += 1

    def narrow(code, span):
        small = span < _BOTTOM
        factor = small * (_WORD - 1) + 1
        code = code * factor + words.take(at, mode="clip") * small
        span = span * factor
        np.add(at, small, out=at)
        while len(left := np.flatnonzero(span < _BOTTOM)):
            code[left] = code[left] * _WORD + words.take(at[left], mode="clip")
            at[left] += 1
            span[left] *= _WORD
        return code, span

    for t in range(n):
        m.predict()
        ends = _fields(m.cum)
        unit = np.floor(span / ends[3::4])
        v = np.floor(code / unit)
        past2, past1, new = v >= ends[0::4], v >= ends[1::4], v >= ends[2::4]
        event = _event(past2, past1, new)
        start, freq = m.span_of(event)
        code -= unit * start
        span = unit * freq
        if vocabulary > _WIDE:
            code, span = narrow(code, span)
        known = past1 ^ new
        total = m.totals.take(m.at_event)
        unit = np.floor(span / total)
        v = np.minimum(np.floor(code / unit), total - 1).astype(np.int64)
        slot = m.by_place.take(m.base_place + v * known, mode="clip") * known + (m.slots + _NEXT) * new + m.guess[1] * ~past2 + m.guess[0] * (past2 ^ past1)
        place = m.table.take(m.base_table + slot * known, mode="clip")
        code -= unit * ((place & 0xFFFF) + v * new)
        span = unit * ((place >> 16) + 1)
        history[t], news[t], names[t] = slot, new, v
        code, span = narrow(code, span)
        m.learn(slot, event, new, history)
    if not (history.all() and news[0].all()):
        raise Damaged("a block's bytes don't decode")
    ids = np.empty((lanes, n), np.uint32)
    for i in range(0, lanes, _CHUNK):
        own, new = np.ascontiguousarray(history[:, i:i + _CHUNK].T), np.ascontiguousarray(news[:, i:i + _CHUNK].T)
        escaped = np.ascontiguousarray(names[:, i:i + _CHUNK].T)[new]  # row by row in the order of their slots
        known = np.count_nonzero(new, axis=1)
        escaped.take(own + (np.cumsum(known) - known - 1)[:, None], out=ids[i:i + _CHUNK], mode="clip")
    return ids


def encode(ids: np.ndarray, vocabulary: int, block: int = BLOCK, lanes: int = 8192) -> tuple[list[bytes], list[int]]:
    """Coded bytes and crc32 of each block of `block` ids. The last block is filled up by its last id before it is coded."""
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("an id is not in the vocabulary")
    count = -(-len(ids) // block)
    full = np.concatenate([ids, np.repeat(ids[-1:], count * block - len(ids))]).astype("<u4").reshape(count, block)
    coded: list[bytes] = []
    for i in range(0, count, lanes):
        coded += _encode_lanes(full[i:i + lanes], vocabulary)
    return coded, [zlib.crc32(row) for row in full]


def decode(coded: list[bytes], crcs: list[int], length: int, vocabulary: int, block: int = BLOCK, lanes: int = 8192) -> np.ndarray:
    """The ids again, as unsigned 32-bit integers; Damaged if a block doesn't have its checksum."""
    with np.errstate(all="ignore"):  # of damaged bytes, found below
        rows = [_decode_lanes(coded[i:i + lanes], block, vocabulary) for i in range(0, len(coded), lanes)]
    full = np.concatenate(rows).astype("<u4", copy=False) if rows else np.zeros((0, block), "<u4")
    for row, crc in zip(full, crcs):
        if zlib.crc32(row) != crc:
            raise Damaged("a block's checksum is wrong")
    return full.reshape(-1)[:length]
