import os
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadmill.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    parts = [os.urandom(n) for n in (4, 5, 8, 1023, 1024, 1025, 3000)]
    assert records.crc32c(parts).tolist() == [slow_crc(p) for p in parts]


def test_frames():
    body = [os.urandom(n) for n in (9, 2000, 13)]
    data = b"".join(records.frames(body))
    assert struct.unpack_from("<Q", data)[0] == 9
    assert records.payloads(data) == (body, len(data))
    assert records.payloads(data[:-1])[0] == body[:2]
    broken = bytearray(data)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        records.payloads(bytes(broken))


def test_round_trip_in_order(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "of", "thion"]) for _ in range(r.randint(0, 60))), 5) for i in range(300)] + [(1000, None, 1), (-4, "", 2)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    t, start, want = Tokenizer.from_file(PATH), 0, []
    for i, text, _ in sorted(rows):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(x) for x in records.round_trip(df, PATH).collect()) == want
    assert records.round_trip(df.limit(0), PATH).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (7, "b"), (7, "b"), (1, "c")], "doc_id long, text string")
    got = sorted((x.start, x.doc_id, x.n_tokens) for x in records.round_trip(df, PATH).collect())
    assert got == [(0, None, 2), (2, 1, 2), (4, 7, 2), (6, 7, 2)]


def test_index_finds_records(spark, tmp_path):
    df = spark.createDataFrame([(i, "the " * i) for i in range(20)], "doc_id long, text string")
    index = records.write(df, f"file://{tmp_path}/r", PATH).collect()
    for x in index:
        data = open(f"{tmp_path}/r/{x.file}", "rb").read()[x.offset :]
        (n,) = struct.unpack_from("<Q", data)
        flags, key = struct.unpack_from("<Bq", records.payloads(data[: 16 + n])[0][0])
        assert key == x.id and (n - 9) // 2 == x.n_tokens


def test_new_words_cost_their_merges_alone():
    """The words' ids are the library's, whatever their bytes; and they cost less than the library takes for the same words as texts."""
    r = random.Random(8)
    words = sorted({" " + "".join(r.choice(["th", "er", "ion", "é", "ño", "wh", "est", "ß"]) for _ in range(r.randint(2, 7))) for _ in range(20000)})
    odd = ["\0", " a\0b", "\n", "  ", "\U0001f600", "ĠĀ", " 12", "....", "\x7f\x80", " " + "ab" * 300]
    library, bpe = Tokenizer.from_file(PATH), records._library(PATH)
    want = lambda some: [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    got = lambda some: [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_all([w.encode() for w in some])]
    plain = [w for w in odd if len(bpe.split.findall(w)) == 1]
    assert got(words) == want(words) and got(plain) == want(plain) and len(plain) > 5
    runs, encoded = ["".join(words[at : at + 256]) for at in range(0, len(words), 256)], [w.encode() for w in words]

    def seconds(f):
        begin = time.process_time()
        f()
        return time.process_time() - begin

    ours, whole = (min(seconds(f) for _ in range(5)) for f in (lambda: bpe.merge_all(encoded), lambda: library.encode_batch(runs, add_special_tokens=False)))
    assert ours < whole
