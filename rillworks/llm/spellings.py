"""Groups spelling variants of words: pairs that are one inserted, deleted or replaced character apart, by PartEnum.

A word's letters are a binary vector over (letter, how many of it came before). A replaced character changes at most two
places of it, an inserted or deleted one exactly one. The places are dealt to PARTS parts by a hash; of two vectors
that differ in two places, all but two parts are equal, so they share the signature of one choice of PARTS - 2 parts,
and two that differ in one place that of PARTS - 1. Every choice is enumerated, words meet by equality of signatures,
and what met is verified character by character. One edit also leaves the first or the last half of the shorter word as
it is, so its length and either half stand beside the parts in a signature; anagrams then rarely meet for nothing.

Nothing is gathered per signature: pairs come from an equality join, and words reach it counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.llm import shared

PARTS = 4
#: Characters of a text that are split at once, and different words a task counts before it passes them on.
SLICE, HELD = 1 << 20, 100_000
RUN, BREAK = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")


def runs(text: str) -> Iterator[list[str]]:
    """Maximal runs of letters, A-Z lower-cased, a slice of the text at a time; runs are never cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            rest = BREAK.search(text, end)
            end = rest.start() if rest else len(text)
        # lower() of bytes changes A-Z alone
        yield RUN.findall(text[at:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        at = end


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None) -> DataFrame:
    """(word, n): how often each run of letters occurs over all texts. NULL texts have none.

    With `slip`, runs are first read with known slips of the pen: where the crc32 h of `<key>:<run>` is a multiple of
    `slip`, character h % length is left out. A NULL key is empty there."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = crc32(f"{'' if k is None else k}:".encode())
                for found in runs(t.as_py() or ""):
                    words.update(found if slip is None else [_slipped(w, crc32(w.encode(), prefix), slip) for w in found])
                    if len(words) > HELD:
                        yield _batch(words)
                        words.clear()
        if words:
            yield _batch(words)

    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    parts = rows.mapInArrow(count, "word string, n bigint")
    return parts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _slipped(word: str, h: int, slip: int) -> str:
    if h % slip:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def _batch(words: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": list(words), "n": pa.array(words.values(), pa.int64())})


def _parts(word: Column) -> list[Column]:
    """The letters of a word by part, each with its number among equal ones."""
    letters = F.array_sort(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)))
    places = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))

    def part(j: int) -> Column:
        return F.array_join(F.filter(places, lambda p: F.pmod(F.crc32(p.cast("binary")), F.lit(PARTS)) == j), "")

    return [part(j) for j in range(PARTS)]


def _signatures(parts: list[str], keep: int, shorter: Column) -> Column:
    """Hashes of each choice of `keep` parts with the length of the shorter word and its first or last half."""
    half = (shorter / 2).cast("int")
    sides = [F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - half + 1, half)]
    return F.array(*[F.xxhash64(F.lit(i), shorter, F.lit(s), side, *[F.col(parts[j]) for j in choice])
                     for i, choice in enumerate(combinations(range(len(parts)), keep)) for s, side in enumerate(sides)])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of all pairs one edit apart. `words` (word, n) are distinct, of two characters at least."""
    names = [f"_p{j}" for j in range(PARTS)]
    # written once: the parts take longer than all that follows, and are read four times
    split = shared.stored(words.select("word", "n", F.length("word").alias("_l"), *[F.xxhash64(p).alias(n) for n, p in zip(names, _parts(F.col("word")))]))
    meet = lambda keep, shorter: split.select("word", "n", F.explode(_signatures(names, keep, shorter)).alias("sig"))
    same, short, long = meet(PARTS - 2, F.col("_l")), meet(PARTS - 1, F.col("_l")), meet(PARTS - 1, F.col("_l") - 1)
    right = lambda df: df.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "sig")
    replaced = same.join(right(same), "sig").filter("word < near")
    inserted = short.join(right(long), "sig")
    found = replaced.unionByName(inserted).filter(F.levenshtein("word", "near", 1) == 1)
    once = found.groupBy("word", "near").agg(F.max("n").alias("n"), F.max("near_n").alias("near_n"))
    return once.select(F.inline(F.array(F.struct("word", "n", "near", "near_n"), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))))


def grouped(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of `words` (word, n), which are distinct.

    A word's form is the near word of largest n, the first in code-point order of equals, if that n is at least `times`
    its own; else NULL. Its root is where following forms ends, itself without a form. n grows with every step, so
    the steps end; they are doubled each round, and the rounds stop when no word moves any more. No words, no rows."""
    near = near_pairs(words).select("word", F.lit(None).cast("bigint").alias("n"), F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("form")).alias("best"))
    own = words.select("word", "n", F.lit(None).cast("struct<least: bigint, form: string>").alias("best"))
    best = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.least") >= times * F.col("n")
    forms = shared.stored(best.select("word", "n", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.least")).alias("form_n")))
    return forms.join(_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form."""
    roots = shared.stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = shared.stored(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        roots = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return roots


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None, least_chars: int = 5, least_n: int = 3, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of all texts with `least_chars` characters and `least_n` occurrences at least.

    NULL and empty texts have no words, repeated rows count again, very long texts are split slice by slice, other columns of
    `docs` don't matter, and no documents give no rows."""
    words = counted(docs, key, text, slip).filter((F.length("word") >= max(2, least_chars)) & (F.col("n") >= least_n))
    return grouped(shared.stored(words), times)
