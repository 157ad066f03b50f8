import numpy as np
import pytest

from rillworks.llm import languages, quality, shared

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_held_out_accuracy_and_whole_texts(spark, docs):
    model = languages.fit(docs, shared.training("doc_id", 5))
    rows = languages.predict(docs, model).filter(shared.held_out("doc_id", 5)).collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["lang_score"] <= 1 for r in rows)
    english = next(r["text"] for r in rows if r["lang"] == "en" and len(r["text"]) > 500)
    german = next(r["text"] for r in rows if r["lang"] == "de" and len(r["text"]) > 500)
    odd = [(1, None), (2, ""), (3, "12 345 !?"), (4, english[:100] + " " + german * 500), (5, "ü"), (None, english), (None, english)]
    got = languages.predict(spark.createDataFrame([(*o, "x") for o in odd], "doc_id long, text string, lang_score string"), model).collect()
    assert [r["lang_pred"] for r in got[:4]] == ["und", "und", "und", "de"] and got[4]["lang_pred"] != "und" and got[5]["lang_pred"] == "en"
    assert [r["lang_score"] for r in got[:3]] == [0, 0, 0]


def test_language_model_reads_pieces_like_the_whole(monkeypatch):
    text = ("some words and Größe, 12 éte " * 60).encode()
    want = languages.profile(text)
    monkeypatch.setattr(languages, "_CHUNK", 64)
    assert np.allclose(languages.profile(text), want)


def test_no_or_one_language(spark, docs):
    nothing = languages.fit(docs.limit(0), shared.training("doc_id", 5))
    assert {r["lang_pred"] for r in languages.predict(docs.limit(5), nothing).collect()} == {"und"}
    one = languages.fit(docs.filter("lang = 'fr'"), shared.training("doc_id", 5))
    assert {(r["lang_pred"], r["lang_score"]) for r in languages.predict(docs.limit(5), one).collect()} == {("fr", 1.0)}


def test_quality_held_out_accuracy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, shared.training("doc_id", 5))
    rows = quality.score(docs, model).join(labels, "doc_id").filter(shared.held_out("doc_id", 5)).collect()
    assert len(rows) > 50 and sum((r["quality_score"] >= 0.3) == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "word " * 300_000), (None, "x")], "doc_id long, text string")
    assert all(0 <= r["quality_score"] <= 1 for r in quality.score(odd, model).collect())
    assert quality.score(docs.limit(0), quality.fit(docs, labels.limit(0), shared.training("doc_id", 5))).count() == 0


def test_quality_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.WIDTH)).astype(np.float32) for n in (1, 4, 3)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.full(3, 1 / 3)
    m = quality.train(bags, y, rounds=1)
    starts = np.array([0, 1, 5])
    loss = lambda: -float(np.mean(y * np.log(p := m.forward(np.concatenate(bags).astype(float), starts)[0]) + (1 - y) * np.log(1 - p)))
    p, state = m.forward(np.concatenate(bags).astype(float), starts)
    for name, g in zip("evuwc", quality._gradients(m, p, y, weight, state)):
        i = int(np.argmax(np.abs(g)))
        w = getattr(m, name).reshape(-1)
        w[i] += 1e-6
        up = loss()
        w[i] -= 2e-6
        assert np.isclose((up - loss()) / 2e-6, g.reshape(-1)[i], rtol=1e-3), name
        w[i] += 1e-6
