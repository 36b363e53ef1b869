import random

import pytest

from pepspark.llm import tokens as K

PIECES = ["a" * 400, " " * 90, "\n\n  \n", " don't they'll ", "x'r e", "日本語テキスト", "1234567", " ", "\t", "…", "é", "'ll", "<|endoftext|>", "👩‍🔬", "­", "PEPTIDEK ", "!?.,;"]


@pytest.fixture(scope="module")
def enc():
    return K.load_encoding()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def texts(n=120, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_other_library(enc, reference):
    for t in texts():
        assert K.encode_text(enc, t) == reference.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (100, 40), (1000, 300)])
def test_chunks_change_nothing(enc, chunk, overlap):
    for t in texts(seed=chunk):
        assert K.encode_text(enc, t, chunk, overlap) == enc.encode_ordinary(t)


def test_cut_points_cover_the_text():
    for t in texts(seed=9):
        cuts = K.cut_points(t, 64, 32)
        assert cuts[0] == 0 and cuts[-1] == len(t) and cuts == sorted(cuts)


def test_runs_without_boundary(enc):
    for t in ("b" * 5000, " " * 5000, "b" * 3000 + " c", "\n" * 700 + "x"):
        assert K.encode_text(enc, t, 100, 40) == enc.encode_ordinary(t)


def test_round_trip(enc):
    for t in texts(seed=4):
        assert K.decode_ids(enc, K.encode_text(enc, t, 50, 30)) == t


def test_documents(spark, enc):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, " \n", "x", 2), (4, "Hello <|endoftext|> world", "x", 25), (4, "Hello <|endoftext|> world", "x", 25), *((10 + i, t, "x", len(t)) for i, t in enumerate(texts(40, 2)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_chars bigint")
    for kwargs in ({}, {"split_chars": 200, "chunk_chars": 64, "overlap": 32}, {"split_chars": 200, "chunk_chars": 64, "overlap": 32, "length_col": "n_chars"}):
        got = K.encode_documents(df, **kwargs).collect()
        want = sorted((r[0], enc.encode_ordinary(r[1] or "")) for r in rows)
        assert sorted((r.doc_id, r.ids) for r in got) == want, kwargs
    assert K.encode_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.encode_documents(df, overlap=10)


def test_long_text_that_nowhere_meets(spark, enc):
    df = spark.createDataFrame([(1, "z" * 900), (2, "word " * 300)], "doc_id int, text string")
    got = {r.doc_id: r.ids for r in K.encode_documents(df, split_chars=200, chunk_chars=64, overlap=32).collect()}
    assert got == {1: enc.encode_ordinary("z" * 900), 2: enc.encode_ordinary("word " * 300)}


def test_repeated_and_null_ids_of_long_texts(spark, enc):
    long = ["word " * 300, "other words " * 200, "z" * 900]
    rows = [(1, long[0]), (1, long[0]), (1, long[1]), (None, long[0]), (None, long[1]), (None, long[1]), (2, long[2]), (2, long[2]), (2, long[0]), (None, long[2])]
    got = K.encode_documents(spark.createDataFrame(rows, "doc_id int, text string"), split_chars=200, chunk_chars=64, overlap=32).collect()
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((i, enc.encode_ordinary(t)) for i, t in rows), key=key)
