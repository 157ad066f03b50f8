import random

import numpy as np
import pytest
import xxhash

from rillworks.llm import components, near_copies


def plain(text):
    """Fingerprint bit by bit from the definition."""
    words = (text or "").encode().translate(near_copies.LOWER).split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(fps, radius=2):
    """Least index reachable over all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_planes_equal_all_pairs(radius):
    rng = random.Random(radius)
    runs = []
    for size in (1, 2, 63, 64, 65, 200, 700):
        centre = rng.getrandbits(64)
        runs.append([centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(size)])
    fps = np.array(sum(runs, []), np.uint64)
    ends = np.cumsum([len(r) for r in runs])
    label = near_copies.close_within(fps, ends - [len(r) for r in runs], ends, radius)
    at = 0
    for r in runs:
        assert (label[at:at + len(r)] - at).tolist() == brute(r, radius)
        at += len(r)


def test_masks_cover_every_pair_of_differing_bits():
    keep = near_copies.masks()
    assert len(keep) == 15
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in keep)


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))] for _ in range(40)]
    texts = []
    for words in base:
        for _ in range(rng.randrange(1, 7)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, " \t\n ", "A b", "a B", "long " * 70_000, "x\x0by\x0cz\x1cq", "ÄÖ ä"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(10 * i + 7, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    want_fp = [plain(t) for t in texts]
    want = [10 * i + 7 for i in brute(want_fp)]
    got = {r["key"]: r for r in near_copies.classes(docs.union(docs.limit(3))).collect()}
    assert [got[10 * i + 7]["fp"] & (2**64 - 1) for i in range(len(texts))] == want_fp
    assert [got[10 * i + 7]["component"] for i in range(len(texts))] == want
    assert near_copies.classes(docs.union(docs.limit(3))).count() == len(texts) + 3


def test_null_keys_and_empty_tables(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "only here in this one text"), (2, "a b c")], schema)
    rows = sorted(map(tuple, near_copies.classes(docs).select("key", "component").collect()), key=str)
    assert rows == sorted([(None, 2), (4, 2), (None, None), (2, 2)], key=str)
    assert near_copies.classes(spark.createDataFrame([], schema)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(100, 160)]
    hub = [(i, 5) for i in range(1000, 1300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain + hub, "u long, v long")).collect()))
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 5 for i in range(1000, 1300)}}
