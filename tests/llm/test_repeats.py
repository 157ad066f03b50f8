import random

import pytest

from rillworks.llm import repeats


def brute(rows, window):
    """(kept words, removed count) per row from the definition."""
    split = [(k, (t or "").encode().split()) for k, t in rows]
    least = {}
    for k, w in split:
        for i in range(len(w) - window + 1):
            run = tuple(w[i:i + window])
            if k is not None:
                least[run] = min(k, least.get(run, k))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and least[tuple(w[i:i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((k, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(gone), len(w)))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(window - 3, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(0, 4 * window))]
        for _ in range(rng.randrange(3)):
            p, at = rng.choice(passages), rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(5):]
        rows.append((i, "  ".join(w)))
    periodic = [f"p{j % 3}" for j in range(3 * window)]
    rows += [(200, " ".join(periodic)), (201, "\n".join(periodic[1:])), (202, "x " * window), (203, "x " * (window - 1)), (204, "x " * 4000), (2, rows[5][1]), rows[5],
             (90, None), (91, ""), (92, " \t"), (None, rows[5][1]), (None, "only here " * window), (1, rows[70][1]), (205, "\x1c" + rows[70][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [10, 50])
def test_equal_to_brute_force(spark, window):
    rows = corpus(window, window)
    docs = spark.createDataFrame([(k, t, 3) for k, t in rows], "doc_id long, text string, n_words int")
    got = repeats.without_repeats(docs, window=window)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "removed"]
    found = []
    for r in got.collect():
        assert r["n_removed"] == sum(b - a for a, b in r["removed"])
        found.append((r["doc_id"], " ".join((r["text"] or "").encode().decode().split(" ")) if r["n_removed"] else b" ".join((r["text"] or "").encode().split()).decode(), r["n_removed"], r["n_words"]))
    assert sorted(found, key=str) == brute(rows, window)


def test_texts_that_lose_nothing_stay_and_empty_tables_work(spark):
    schema = "doc_id long, text string"
    text = "a  b\n\nc " * 60
    rows = repeats.without_repeats(spark.createDataFrame([(1, text), (2, None)], schema)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(1, text), (2, None)]
    assert repeats.without_repeats(spark.createDataFrame([], schema)).count() == 0
