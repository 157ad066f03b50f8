import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

from rillworks.llm import scoring, shared
from rillworks.llm.words import values

SUBWORDS = scoring.Subwords(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def naive(model, ids):
    """One id after the other, each from its own window."""
    at, scored = scoring.windows(np.array([len(ids)]))
    rows = np.concatenate([[model.begin], model.row[ids[:-1]]])
    total = 0.0
    for s, c in zip(at, scored):
        for t in range(s + c, min(len(ids), s + scoring.WINDOW)):
            logits, _ = model.forward(rows[None, s:t + 1])
            p = np.exp(logits[0, -1] - logits[0, -1].max())
            total += math.log10(p[model.band[ids[t]]] / p.sum()) + model.share[ids[t]]
    return total


def test_windows_score_each_position_once():
    for sizes in ([1], [32], [33], [31, 57, 1, 400], [56, 57]):
        at, scored = scoring.windows(np.array(sizes))
        edge = np.repeat(np.cumsum(sizes), sizes)
        seen = Counter(p for s, c in zip(at, scored) for p in range(s + c, min(edge[s], s + scoring.WINDOW)))
        assert seen == Counter(range(sum(sizes)))


def test_batched_scores_equal_naive_and_are_probabilities():
    rng = np.random.default_rng(1)
    model = scoring.Model.of_counts(rng.integers(0, 50, SUBWORDS.end + 1).astype(float))
    texts = [rng.integers(0, SUBWORDS.end, n) for n in (1, 5, 32, 33, 90, 150)]
    assert np.allclose(model.score(texts), [naive(model, t) for t in texts], atol=1e-3)
    assert math.isclose(sum(10 ** model.share[model.band == 3]), 1, rel_tol=1e-6)


def test_gradients():
    rng = np.random.default_rng(2)
    model = scoring.Model.of_counts(rng.integers(0, 50, 3000).astype(float))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rows, target = rng.integers(0, 2000, (3, 9)), rng.integers(0, scoring.CLASSES, (3, 9))

    def loss():
        x, _ = model.forward(rows)
        x = x - x.max(axis=2, keepdims=True)
        return -np.take_along_axis(x - np.log(np.exp(x).sum(axis=2, keepdims=True)), target[..., None], 2).mean()

    grads = scoring._gradients(model, rows, target)
    for name, g in grads.items():
        flat = np.argsort(-np.abs(g).reshape(-1))[:3]
        for i in flat:
            w = model.w[name].reshape(-1)
            w[i] += 1e-5
            up = loss()
            w[i] -= 2e-5
            down = loss()
            w[i] += 1e-5
            assert math.isclose((up - down) / 2e-5, g.reshape(-1)[i], rel_tol=2e-3, abs_tol=1e-7), name


def test_base_scores_and_a_model_that_learns(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(500, None), (501, ""), (502, "Never Seen wordsss"), (None, "the and of"), (503, "the " * 9000), (7, rows[7][1])]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    learn = shared.training("doc_id", 10)
    model = scoring.fit(docs, learn, SUBWORDS)
    got = scoring.scores(docs, learn, SUBWORDS, model).collect()
    known = [(k, (t or "").encode().translate(scoring.LOWER).split(), k is not None and zlib.crc32(str(k).encode()) % 10 != 0) for k, t in rows]
    counts = Counter(x for _, w, ok in known if ok for x in [*w, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), ok, len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 4)) for k, w, ok in known)
    assert sorted((str(r["key"]), r["learn"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    ids = [SUBWORDS.ids((t or "").encode()) for _, t in rows]
    assert np.allclose(sorted(r["score"] for r in got), sorted(model.score(ids)), rtol=1e-4)
    untrained = scoring.Model(model.band, model.share, model.row, scoring.Model.of_counts(np.ones(len(model.band))).w)
    untrained.w["u"][:] = 0
    untrained.w["b"][:] = np.log(np.bincount(model.band, 10**model.share, scoring.CLASSES) + 1e-9)
    held = [SUBWORDS.ids((t or "").encode()) for k, t in rows[:200] if k is not None and zlib.crc32(str(k).encode()) % 10 == 0]
    assert sum(model.score(held)) > 0.95 * sum(untrained.score(held)) and sum(untrained.score(held)) < -1000
    assert scoring.scores(docs.limit(0), learn, SUBWORDS, model).count() == 0
    assert docs.agg(F.count("*")).first()[0] == len(got)


def test_weights_learn_from_all_texts(spark, monkeypatch):
    """Texts that are not in the sample of the start, short ones too, change the weights."""
    common, other = "the and of to in a is that it was for on are as with his they at be this", "0 1 2 3 4 5 6 7 8 9"
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = []
    for n in (1, 2, 40):
        docs = frame([common] * 3 + [other] * 3 * n)
        monkeypatch.setattr(scoring.Model, "of_counts", classmethod(lambda cls, counts, seed=11, real=scoring.Model.of_counts.__func__: real(cls, np.ones(SUBWORDS.end + 1), seed)))
        got.append(scoring.fit(docs, F.lit(True), SUBWORDS, sample_docs=1))
        monkeypatch.undo()
    ids = [SUBWORDS.ids(other.encode())]
    scores = [float(m.score(ids)[0]) for m in got]
    assert scores[0] != scores[1] != scores[2] and len(ids[0]) < scoring.WINDOW


def test_a_pass_counts_each_id_once():
    rng = np.random.default_rng(3)
    model = scoring.Model.of_counts(rng.integers(0, 50, 3000).astype(float))
    texts = [rng.integers(0, 40, n) for n in (1, 31, 32, 33, 200)] * 40
    run = scoring.Pass(model)
    run.learn(texts)
    assert run.n == sum(map(len, texts)) and run.model.score(texts).sum() > model.score(texts).sum()


def test_texts_are_cut_once_and_words_hashed_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "The same \x0b words\tagain. " * 50 if i % 2 else None) for i in range(12)], "doc_id long, text string")
    learn = F.col("doc_id") > 2
    cut_rows = scoring.cut_texts(docs, learn, SUBWORDS)
    monkeypatch.setattr(scoring, "cut_texts", None)
    model = scoring.fit(docs, learn, SUBWORDS, cut_rows=cut_rows)
    got = {r["key"]: r for r in scoring.scores(docs, learn, SUBWORDS, model, cut_rows=cut_rows).collect()}
    for i in range(12):
        text = b"The same \x0b words\tagain. " * 50 if i % 2 else b""
        assert got[i]["n_tokens"] == 200 * (i % 2) + 1 and math.isclose(got[i]["score"], model.score([SUBWORDS.ids(text)])[0], rel_tol=1e-4)
    hashed = []
    monkeypatch.setattr(scoring, "hashes", lambda words, real=scoring.hashes: real(hashed.extend(words) or words))
    h, place, size = scoring._distinct([b"B a\x0cb", None, b" a\r\n", b"\t"])
    assert sorted(hashed) == [b"a", b"b"] and len(h) == 2 and size.tolist() == [3, 0, 1, 0] and place[0] == place[2] != place[1] == place[3]


def test_scores_from_a_column_on_are_those_of_whole_windows():
    rng = np.random.default_rng(4)
    model = scoring.Model.of_counts(rng.integers(0, 50, 3000).astype(float))
    rows, target = rng.integers(0, 2000, (5, scoring.WINDOW)), rng.integers(0, scoring.CLASSES, (5, scoring.WINDOW))
    whole = model.log_p(rows, target).copy()
    for since in (0, scoring.OVERLAP, scoring.WINDOW - 1):
        assert np.allclose(model.log_p(rows, target, since), whole[:, since:], atol=1e-4)
    ids = SUBWORDS.ids(b"Some text A")
    assert np.frombuffer(SUBWORDS.coded(b"Some text A"), "<u2").tolist() == ids.tolist() and SUBWORDS.ids(None).tolist() == [SUBWORDS.end]


def test_values_of_string_arrays():
    column = pa.array(["", "a", "\u00e9\u00e8", "", "b c"], pa.large_string())
    assert values(column) == [b"", b"a", "\u00e9\u00e8".encode(), b"", b"b c"] and values(column[1:3]) == [b"a", "\u00e9\u00e8".encode()]
    assert values(column[:0]) == values(pa.array([], pa.large_string())) == [] and values(pa.array(["", ""], pa.large_string())) == [b"", b""]


def test_texts_are_moved_and_cut_into_words_once(spark):
    """Base scores come from stored places of words: the plan that is left doesn't read the texts again."""
    docs = spark.createDataFrame([(i, f"some words of text {i}" if i % 3 else None) for i in range(40)], "doc_id long, text string")
    path = shared.new_path(spark)
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    rows = scoring.scores(docs, F.lit(True), SUBWORDS, scoring.Model.of_counts(np.ones(SUBWORDS.end + 1)))
    assert path.rsplit("/", 1)[1] not in rows._jdf.queryExecution().optimizedPlan().toString() and "text" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["n_tokens"] for r in rows.collect()) == [1] * 14 + [6] * 26


def test_ids_without_the_look_behind_spaces_are_the_same():
    plain, _ = scoring._encoding(SUBWORDS.path, SUBWORDS.pattern)
    for text in ("a  b", "a \n b", " a ", "\n", "a\xa0 b", "\x1c x\x85 y\u3000\u3000z", "a\r\nb", "it's 12 !? a b", "x \u2028 y"):
        assert SUBWORDS.ids(text.encode()).tolist() == [*plain.encode_ordinary(text), SUBWORDS.end]
    before = scoring._encoding.cache_info().currsize
    assert SUBWORDS.ids(b"one space each") is not None and before >= 2


def test_planes_of_numbers():
    for x in ([], [7], [0, 1, 255, 256, 70000, 2**32 - 1]):
        assert scoring._of_planes(scoring._planes(np.array(x, np.int64))).tolist() == x


def test_held_values_and_tanh():
    x = np.array([-1e9, -100, -3, -1e-4, 0, 0.5, 20, 100, 1e9], np.float32)
    got = x.copy()
    scoring._tanh(got)
    assert np.allclose(got, np.tanh(x), atol=2e-7)
    got = x.copy()
    scoring._held_exp(got)
    assert np.array_equal(got, np.exp(np.clip(x, -60, 60)))
