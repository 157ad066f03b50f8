"""Token ids of whole texts by a public tokenizer's file, with a cache of pieces.

Texts are cut where the tokenizer never joins what stands on both sides, so the ids of the pieces, one
after the other, are the ids of the text; frequent pieces are encoded once. Each different word of some texts is looked up once,
as two pieces if it is letters and punctuation behind them: new words are mostly known letters with other punctuation.
New pieces are encoded many at a time; where words end in ids of their own, those of letters alone without the tokenizer's
normalizer and patterns, which leave them as they are.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rillworks.llm.words import values

#: How texts may be cut. `before_space`: byte-level BPE whose pieces take one space in front; `white_space`: white space is dropped; `whole`: not at all.
CUTS = ("before_space", "white_space", "whole")
#: Pieces in the cache, and bytes of known words with their ids, at which either is begun anew: every worker has its own.
CACHED_PIECES = 1 << 17
CACHED_BYTES = 1 << 24
CACHED_LENGTH = 64
_TOGETHER = 256
#: Texts are cut into words so many characters at a time, and new words become Python objects so many at a time.
_CHARS = 1 << 22
_WORDS = 1 << 14


#: A text with none of these, and without spaces or line feeds next to each other or at its ends, may be cut before each.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")
_WIDE = re.compile("[^\0-\xff]")
#: Letters of Latin-1 and the ASCII punctuation behind them but for the apostrophe, which begins contractions; else the whole word.
_STEMS = re.compile("(?:(\n?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++)([!-&(-/:-@\\[-`{-~]*+)|([^ ]*)) ").findall
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
#: Words that have to have the same ids without normalizer and patterns before others are encoded so.
_PROBES = ["a", "ab", "Zebra", "stra\xdfe", "\xe0\xed\xff", "\xc0\xcd\xdf\xd8\xfe", "\xe9t\xe9", "donaudampfschiff", "qxzjkvw", "ll", "s"]
#: Stands between pieces that are encoded together.
_SEPARATORS = {"before_space": "\n", "white_space": " \x01 ", "whole": ""}
#: The pre-tokenizer has to cut these as given before stems stand apart.
_CUT_AS = {"ab": ["ab"], "Ab,-": ["Ab", ",-"], "\xe9\xdfX_[]": ["\xe9\xdfX", "_[]"], "a<|": ["a", "<|"]}


def _safe(t: str) -> bool:
    return not (t[0] in " \n" or t[-1] in " \n" or "  " in t or " \n" in t or "\n " in t or "\n\n" in t or _ODD.search(t))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cuts: str, room: int = 1):
        """`room`: how many times the usual bounds of known words, cached pieces and characters at a time this encoder has."""
        if cuts not in CUTS:
            raise ValueError(f"unknown cuts: {cuts}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        resize = getattr(self._tokenizer.model, "_resize_cache", None)
        if resize:  # pieces are cached here; the library's own cache only costs time for words seen once
            resize(0)
        self._cuts, self._room = cuts, room
        self._cache: dict[str, bytes] = {"": b""}
        self._known, self._known_ids, self._known_at = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if cuts == "whole":
            return
        cut = self._tokenizer.pre_tokenizer
        self._apart = cut is not None and all([t[i:j] for _, (i, j) in cut.pre_tokenize_str(t)] == parts for t, parts in _CUT_AS.items())
        self._space = " " if cuts == "before_space" else ""
        self._feed = self._one("\n") if self._space else b""
        self._separator = _SEPARATORS[cuts]
        mark = self._tokenizer.encode(self._separator, None, False, False).ids
        self._mark = mark[0] if len(mark) == 1 else None
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._plain = None
        self._prepare_plain()
        #: Whether small and capital letters have the same ids.
        self._lower = self._one("aB\xc9") == self._one("ab\xe9") == self._one("AB\xe9")

    def _prepare_plain(self) -> None:
        """The model behind a cut at spaces, if words of Latin-1 letters have the same ids so and end where an id of the end of a word stands."""
        from tokenizers import Tokenizer, pre_tokenizers

        model = self._tokenizer.model
        suffix = getattr(model, "end_of_word_suffix", None)
        if self._cuts != "white_space" or not suffix or not self._apart or any(x.isalpha() for x in self._special):
            return
        self._final = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._final[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._as_bytes = [(c.encode()[1:].decode("latin-1"), by_bytes.pre_tokenize_str(c)[0][0][1:]) for c in "\xdf\xe0\xed"]
        self._plain = Tokenizer(model)
        self._plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if self._letters(_PROBES) != [self._one(p) for p in _PROBES]:
            self._plain = None

    def _letters(self, words: list[str]) -> list[bytes] | None:
        """The ids of words of Latin-1 letters by the model alone, which sees bytes as letters; None if they can't be told apart."""
        text = " ".join(words).lower().encode().decode("latin-1")
        for byte, letter in self._as_bytes:
            text = text.replace(byte, letter)
        ids = np.array(self._plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self._final[ids]) + 1).tolist()
        if len(ends) != len(words):
            return None
        raw = ids.tobytes()
        return [raw[4 * a:4 * z] for a, z in zip([0, *ends], ends)]

    @property
    def vocabulary(self) -> int:
        return self._tokenizer.get_vocab_size()

    def _one(self, text: str) -> bytes:
        ids = array("I", self._tokenizer.encode(text, None, False, False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _small(self, t: str) -> str:
        """The text with small letters, where that has the same ids: not if special strings come about, which are found before."""
        if _WIDE.search(t):
            return t
        small = t.lower()
        return t if any(x in small for x in self._special) else small

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces that the cache lacks, many in one call with a piece of one known id between them."""
        cache = self._cache
        if self._plain:
            letters = [p for p in pieces if p.isalpha() and (p.isascii() or _LATIN(p))]
            for i in range(0, len(letters), _TOGETHER):
                part = letters[i:i + _TOGETHER]
                cache.update(zip(part, self._letters(part) or map(self._one, part)))
            pieces = pieces.difference(letters)
        alone = [p for p in pieces if self._mark is None or "\n" in p or "\x01" in p or "<" in p]
        for p in alone:
            cache[p] = self._one(p)
        together = list(pieces.difference(alone))
        for i in range(0, len(together), _TOGETHER):
            part = together[i:i + _TOGETHER]
            ids = np.array(self._tokenizer.encode_batch_fast([self._separator.join(part)], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(ids == self._mark).tolist()
            if len(marks) != len(part) - 1:
                cache.update((p, self._one(p)) for p in part)
                continue
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, [*marks, len(ids)]):
                cache[p] = raw[4 * at:4 * end]
                at = end + 1

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of different words, each behind a space where words take one, unless it begins with a line feed."""
        cache, space = self._cache, self._space
        rows = _STEMS(" ".join(words) + " ") if self._apart else [("", "", "", w) for w in words]
        if space:
            heads = [(stem if feed else " " + stem) if stem else other if other[0] == "\n" else " " + other for feed, stem, _, other in rows]
        else:
            heads = [stem or other for _, stem, _, other in rows]
        if len(cache) > CACHED_PIECES * self._room:
            cache.clear()
            cache[""] = b""
        pieces = {*heads, *[tail for _, _, tail, _ in rows]}.difference(cache)
        self._learn(pieces)
        out = [(self._feed if row[0] else b"") + cache[head] + cache[row[2]] for row, head in zip(rows, heads, strict=True)]
        for p in pieces:
            if len(p) > CACHED_LENGTH:
                del cache[p]
        return out

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of different words begin in `_known_ids`, and how many they are; words not known yet are added."""
        if self._known.nbytes + self._known_ids.nbytes > CACHED_BYTES * self._room:
            self._known, self._known_ids, self._known_at = self._known[:0], self._known_ids[:0], self._known_at[:1]
        at = pc.index_in(words, value_set=self._known)
        missing = at.is_null()
        new = words.filter(missing)
        ids, sizes = [], []
        for i in range(0, len(new), _WORDS):
            part = self._words([w.decode() for w in values(new[i:i + _WORDS])])
            ids.append(b"".join(part)), sizes.extend(len(x) // 4 for x in part)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = len(self._known) + np.arange(len(new))
        self._known = pa.concat_arrays([self._known, new])
        self._known_at = np.concatenate([self._known_at, self._known_at[-1] + np.cumsum(np.array(sizes, np.int64))])
        self._known_ids = np.concatenate([self._known_ids, np.frombuffer(b"".join(ids), "<u4")])
        return self._known_at[place], self._known_at[place + 1] - self._known_at[place]

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut at their spaces. A line feed is put in front of each where it has ids of its own, and left out again."""
        spaced = ["\n" + t.replace("\n", " \n") if self._space else t.replace("\n", " ") for t in texts]
        lists = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        words = lists.flatten().dictionary_encode()
        start, size = self._places(words.dictionary)
        code = words.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        from_ = np.repeat((start[code] - (ends - n)).astype(np.int32), n)
        from_ += np.arange(len(from_), dtype=np.int32)
        raw = self._known_ids[from_].tobytes()
        edges = 4 * np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return [raw[a + len(self._feed):z] for a, z in zip(edges.tolist(), edges[1:].tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; NULL has none."""
        texts = [t or "" for t in texts]
        if self._cuts == "whole":
            return [self._one(t) for t in texts]
        if self._cuts == "white_space":
            out: list[bytes | None] = [None] * len(texts)
            if self._lower:
                texts = list(map(self._small, texts))
        else:
            out = [None if t and _safe(t) else self._one(t) for t in texts]
        part, chars = [], 0
        for i, x in enumerate([*out, None]):
            if part and (i == len(out) or chars > _CHARS * self._room):
                for j, ids in zip(part, self._cut([texts[j] for j in part])):
                    out[j] = ids
                part, chars = [], 0
            if i < len(out) and x is None:
                part.append(i)
                chars += len(texts[i])
        return out


@lru_cache(maxsize=4)
def encoder(path: str, cuts: str, room: int = 1) -> Encoder:
    """The worker's own encoder: tasks that run in it one after the other share its cache."""
    return Encoder(path, cuts, room)
