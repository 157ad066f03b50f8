import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillworks.llm import idcoder, shared, tokenfiles
from rillworks.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def streams():
    rng = random.Random(3)
    yield np.zeros(0, np.int64)
    yield np.array([49407])
    yield np.full(5000, 7)
    yield np.array([rng.randrange(49408) for _ in range(3000)])
    yield np.array([min(49407, int(rng.paretovariate(0.7))) for _ in range(9000)])
    yield np.array(list(range(40)) * 130)


@pytest.mark.parametrize("ids", list(streams()))
@pytest.mark.parametrize("block", [33, 1024])
def test_ids_come_back(ids, block):
    coded, crcs = idcoder.encode(ids, 49408, block, lanes=50)
    assert np.array_equal(idcoder.decode(coded, crcs, len(ids), 49408, block), ids)


def test_predictable_ids_take_few_bytes():
    ids = np.array([i * i % 97 * 300 for i in range(97)] * 60)
    assert sum(map(len, idcoder.encode(ids, 49408)[0])) < len(ids) / 2
    with pytest.raises(ValueError):
        idcoder.encode(np.array([5]), 5)


def test_damage_is_found():
    rows = [np.arange(i, 3 * i, dtype="<u4").tobytes() for i in (500, 1, 700)]
    frame = tokenfiles.pack_frame(rows, 5000)
    assert [r.astype("<u4").tobytes() for r in tokenfiles.unpack_frame(frame)] == rows
    for at in range(0, len(frame) - 64, 211):
        broken = bytearray(frame)
        broken[at] ^= 0x41
        with pytest.raises(idcoder.Damaged):
            tokenfiles.unpack_frame(bytes(broken))
    for n in (0, 10, 60, len(frame) - 2):
        with pytest.raises(idcoder.Damaged):
            tokenfiles.unpack_frame(frame[:n])


def test_write_and_read_whole_tables(spark):
    rows = [(5, "five words in this text"), (1, None), (9, ""), (None, "no key"), (3, "Long one " * 3000), (3, "Long one " * 3000), (-2, "minus")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    path = shared.new_path(spark)
    tokenfiles.write(docs, path, PATH, "white_space", 2, frame_ids=4000)
    got = tokenfiles.read(spark, path).collect()
    plain = Tokenizer.from_file(PATH)
    want, at = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    path = shared.new_path(spark)
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, "white_space", 2)
    assert tokenfiles.read(spark, path).count() == 0


@pytest.mark.parametrize("vocabulary", [1 << 17, (1 << 17) + 1, 1 << 23, 1 << 32])
def test_wide_ids_come_back(vocabulary):
    rng = random.Random(vocabulary)
    ids = np.array([rng.randrange(vocabulary) for _ in range(300)] * 2 + [vocabulary - 1, 0] * 50)
    coded, crcs = idcoder.encode(ids, vocabulary, 128)
    assert np.array_equal(idcoder.decode(coded, crcs, len(ids), vocabulary, 128), ids)


def test_slots_met_again_take_few_bytes():
    rng = random.Random(5)
    names = rng.sample(range(49408), 24)
    ids = np.array([x for _ in range(300) for x in (*names[:8], *rng.choices(names, k=24))][:8 * 1024])
    coded, crcs = idcoder.encode(ids, 49408)
    assert np.array_equal(idcoder.decode(coded, crcs, len(ids), 49408), ids)
    assert all(np.frombuffer(c, "<u2").size < 420 for c in coded)  # 6.6 bits an id
    for at in (0, len(coded[1]) // 2):
        broken = bytearray(coded[1])
        broken[at] ^= 0x55
        with pytest.raises(idcoder.Damaged):
            idcoder.decode([coded[0], bytes(broken), *coded[2:]], crcs, len(ids), 49408)


def test_words_of_letters_take_the_model_alone(monkeypatch):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ\xdf\xe0\xed\xe9\xff\xc0\xcd\xdc\xd8"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(2000)]
    texts = [" ".join(words[:1000]), " ".join(words[1000:]) + " ΣΩ 中 Áb \xaa\xb5"]
    plain = Tokenizer.from_file(PATH)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Encoder(PATH, "white_space").encode(texts) == want
    own = Encoder(PATH, "white_space")
    monkeypatch.setattr(own, "_tokenizer", None)
    assert own.encode(texts[:1]) == want[:1]


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 7)) for i in range(300)], "doc_id long, text string")
    path = shared.new_path(spark)
    tokenfiles.write(docs, path, PATH, "white_space", 2)
    whole, bare = tokenfiles.read(spark, path), tokenfiles.read(spark, path, with_ids=False)
    assert bare.columns == whole.columns[:-1]
    assert sorted(map(tuple, bare.collect())) == sorted(tuple(r)[:-1] for r in whole.collect())
