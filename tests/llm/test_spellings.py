import random
import re
from collections import Counter
from zlib import crc32

import pytest

from rillworks.llm import spellings as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, l = sorted((a, b), key=len)
    return len(l) == len(s) + 1 and any(l[:i] + l[i + 1:] == s for i in range(len(l)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if v != w and near(v, w)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(around), form, counts.get(form))
    root = lambda w: w if out[w][2] is None else root(out[w][2])
    return {w: (*r, root(w)) for w, r in out.items()}


def got(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("alphabet, seed", [("ab", 1), ("abcdeé", 2), ("etaoinshrdlüß€😀", 3)])
def test_grouped_equals_brute_force(spark, alphabet, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 9))): rng.randrange(3, 60) for _ in range(250)}
    for w in list(counts)[:120]:
        at, c = rng.randrange(len(w)), rng.choice(alphabet)
        counts[rng.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])] = rng.randrange(3, 9)
    counts = {w: n for w, n in counts.items() if len(w) >= 2}
    found = got(S.grouped(spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(5)))
    assert found == brute(counts)
    assert sum(r[2] is not None for r in found.values()) > 20


def test_long_chains_and_ties(spark):
    chain = {"a" * (5 + i): 3 << i for i in range(20)}
    ties = {"zebra": 3, "zebrb": 6, "zebrc": 6, "zebré": 6}
    found = got(S.grouped(spark.createDataFrame([*chain.items(), *ties.items()], "word string, n bigint")))
    assert found == brute(chain | ties)
    assert found["aaaaa"][4] == "a" * 24 and found["zebra"][2] == "zebrb" and found["zebrb"][2] is None


def test_counts_of_slipped_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 50)
    monkeypatch.setattr(S, "HELD", 40)
    rng = random.Random(4)
    bits = ["Über", "straße", "ABC", "don't", "İstanbul", "x9y", "naïve", "×÷", "éÉ", "ſ", "\n", "a" * 130, "😀word"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(60)] + [(5, None), (6, ""), (7, "   "), (8, "b" * 700)]
    want = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = crc32(f"{'' if k is None else k}:{w}".encode())
            want[w if h % 3 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    want.pop("", None)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    assert {r["word"]: r["n"] for r in S.counted(docs, slip=3).collect()} == want
    assert sum(r["n"] for r in S.counted(docs).collect()) == sum(len(re.findall("[A-Za-zÀ-ÿ]+", t or "")) for _, t in rows)


def test_variants_of_odd_tables(spark):
    schema = "doc_id long, text string, root string, sig int"
    assert S.variants(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, "r", 1), (1, "", "r", 1), *[(2, "colour Colour four colours", "r", 1)] * 3, (3, "color color color colour colour", "r", 1)]
    out = got(S.variants(spark.createDataFrame(rows, schema)))
    assert out == brute({"colour": 8, "colours": 3, "color": 3})
    assert out["colours"][4] == "colour"
