import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillworks.llm import packing, tokens
from rillworks.llm.tokens import Encoder

ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "a\tb", "\n", "it's we'll 'tis", "x y z", "x 　y", "<|endoftext|> <|startoftext|>", "x<|endoftext|>y", "a\n<|endoftext|>\nb", "a <|endoftext|>", "<|endoftext|><|endoftext|> it's", "<| endoftext|>",
       "Größe éte ́x ΣΑΣ Σ", "12 345 6.7 #$% **", "a\x1cb \x85c", "tail \n", "word " * 300 + "long" * 200, "日本 語", "🙂 🙂a", "\r\nab \r\n cd"]


@pytest.mark.parametrize("name, cuts", [("byte_bpe_50k.json", "before_space"), ("word_bpe_49k.json", "white_space")])
def test_cached_ids_are_the_ids_of_whole_texts(spark, name, cuts):
    path = public_tokenizers.path(name)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ODD + ["".join(x) for x in product([" ", "\n", "a", "#", "\t"], repeat=4)]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = Encoder(path, cuts)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want
    assert encoder.encode([None]) == [b""]


@pytest.mark.parametrize("name, cuts", [("byte_bpe_50k.json", "before_space"), ("word_bpe_49k.json", "white_space")])
def test_new_words_take_few_calls_of_the_tokenizer(name, cuts):
    """Letters are encoded once, whatever punctuation is behind them, and new ones many in one call."""
    stems = ["".join(x) for x in product("aQz", "eé", "rn", "ßt", "iou")]
    marks = ["", ".", ",%%%", "...", "<|", "_-", "'s", "'", "9"]
    texts = [" ".join(s + m + ("\n" + s if i % 5 == 0 else "") for i, s in enumerate(stems)) for m in marks] + [" ".join(marks[1:])]
    encoder = Encoder(public_tokenizers.path(name), cuts)
    plain, calls = encoder._tokenizer, []

    class Counted:
        def __getattr__(self, attribute):
            calls.append(attribute)
            return getattr(plain, attribute)

    encoder._tokenizer = Counted()
    got = [np.frombuffer(b, "<u4").tolist() for t in texts for b in encoder.encode([t])]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 40 < len(stems)


def test_memory_of_a_worker_is_bounded(spark, monkeypatch):
    """Texts come few at once, new words become Python objects few at once, and the cache of pieces is small."""
    sizes, encode = [], tokens.Encoder._words
    monkeypatch.setattr(tokens.Encoder, "_words", lambda self, words: sizes.append(len(words)) or encode(self, words))
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), "before_space")
    words = [f"{'ab' * (i % 7)}{i}" for i in range(1, 40001)]
    got = encoder.encode([" ".join(words)])[0]
    assert got == b"".join(encoder.encode([" ".join(words)])) == encoder._one(" ".join(words))
    assert sum(sizes) == 40000 and max(sizes) <= 1 << 14 and tokens.CACHED_PIECES <= 1 << 17 and tokens.CACHED_BYTES <= 1 << 24
    rows = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["id"]) for b in batches), "id long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    placed = packing.placed(rows.withColumn("length", F.lit(1)))
    assert placed.agg(F.max("id")).first()[0] <= 1024 and placed.count() == 5 and spark.conf.get(name) == before


@pytest.mark.parametrize("seed", range(6))
def test_pack_is_valid_and_not_worse_than_best_fit(seed):
    rng = random.Random(seed)
    capacity = 100
    lengths = [min(capacity, max(1, int(rng.gauss(rng.choice([20, 45, 60]), 15)))) for _ in range(400)]
    bins = packing.pack(lengths, capacity)
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert all(0 < sum(lengths[i] for i in b) <= capacity for b in bins)
    space = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in space if r >= n]
        if fit:
            space.remove(min(fit))
            space.append(min(fit) - n)
        else:
            space.append(capacity - n)
    assert -(-sum(lengths) // capacity) <= len(bins) <= len(space)


def test_exchanges_empty_a_bin_that_best_fit_leaves():
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    capacity = 61
    bins = packing.pack(lengths, capacity)
    assert len(bins) == -(-sum(lengths) // capacity)


def test_local_search_beats_best_fit_somewhere():
    better = 0
    for seed in range(40):
        rng = random.Random(seed)
        lengths = [rng.randrange(20, 70) for _ in range(60)]
        bins = packing._Bins(lengths, 100)
        for i in sorted(range(60), key=lambda i: -lengths[i]):
            bins.put(i)
        better += len(packing.pack(lengths, 100)) < len(bins.items)
    assert better


def test_pieces_and_sequences_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "many words here " * 400), (4, "many words here " * 400), (None, "no key"), (5, "x" * 3000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, offset int")
    parts = packing.pieces(docs, path, "before_space", capacity=64)
    placed = packing.placed(parts, capacity=64, group=8).cache()
    whole = {(r["sequence_id"]): list(r["ids"]) for r in packing.sequences(placed).collect()}
    texts = Tokenizer.from_file(path)
    got = []
    for r in placed.collect():
        ids = whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        got.append((str(r["key"]), r["piece"], r["start"], tuple(ids)))
    want = []
    for k, t in rows:
        ids = [*texts.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 64 + 1
        cut = [0, *range(first, len(ids) + 1, 64)]
        want += [(str(k), i, a, tuple(ids[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted(got) == sorted(want)
    sizes = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 64 for r in sizes)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "before_space")
    assert packing.placed(parts).count() == 0
