import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadmill.llm import bpe, records

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'sStdllmreabcde012²٣!?.,é漢😀́<|endoftext|>\x00"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n, seed):
    r = random.Random(seed)
    made = ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(n)]
    words = ["the", "of", "and", "thion", "Erth.", "naïve,", "<|endoftext|>", "x" * 30]
    return made + [" ".join(r.choice(words) for _ in range(60)) for _ in range(50)]


@pytest.mark.parametrize("kind", [bpe.ByteBpe, records.LibraryBpe])
def test_same_ids_as_the_library(library, kind):
    cases = texts(2000, 1) + ["", " ", "a", "q" * 5000, "ab" * 400 + " z"]
    for text, ids in zip(cases, kind(PATH).encode_all(cases)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert kind(PATH).decode(ids) == library.decode(want, skip_special_tokens=False) if len(text) > 4000 else True


def test_decode(library):
    b = bpe.ByteBpe(PATH)
    for text in texts(300, 2):
        assert b.decode(b.encode(text)) == text
    assert b.decode(np.array([5, 99999999], "<u4").tobytes()) == b.token[5].decode()
    assert b.decode(np.array([200], "<u4").tobytes()) == library.decode([200], skip_special_tokens=False)


def test_memo_that_overflows_changes_nothing(library):
    b = bpe.ByteBpe(PATH)
    b.memo, b.slice = 10, 200
    cases = texts(200, 3)
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode_all(cases)] == [library.encode(t, add_special_tokens=False).ids for t in cases]


def test_long_words_merge_as_short_ones():
    b = bpe.ByteBpe(PATH)
    r = random.Random(4)
    for _ in range(50):
        word = bytes(r.choice(b"abethinosr") for _ in range(150))
        assert b._merge_long([b.first[x] for x in word]) == np.frombuffer(b.merge_all([word])[0], "<u4").tolist()


def test_edges(spark, library):
    rows = [(1, None, "x", 9), (None, "a b", "y", 9), (2, "", None, 9), (2, "", None, 9), (3, "w " * 30000, "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.decoded) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert got == {(1, 0, ""), (None, 2, "a b"), (2, 0, ""), (3, len(library.encode("w " * 30000).ids), "w " * 30000)}
    assert bpe.digests(df.limit(0), PATH).count() == 0
