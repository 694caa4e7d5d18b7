"""Token ids as length-delimited binary records, with a separate offset index.

A file is a row of frames: the payload's length (u64), the masked CRC-32C of these 8 bytes (u32), the
payload, and its masked CRC-32C (u32), all little-endian. A payload is one document: a byte
of flags (1: ids are u32, else u16; 2: the document's id is null), the document's id (i64) and the token ids. Beside the files lies an
index, a Parquet table of part, byte offset and token count of every record, by which readers seek for shuffled reads.

Documents are in ascending order of their ids over all files, null ids first; rows that share an id stand in any
order. Files of task attempts that fail are not in the index and so never read. Null text counts as empty; every document ends with
the end id. An empty table gives an empty index and no files.
"""

from __future__ import annotations

import os
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.bpe import ByteBpe, _byte_symbols
from threadmill.llm.common import byte_slices, scratch_uri

_HEAD = "<Bq"
#: Bytes that are read from a file at once, and checked together.
READ = 8 << 20
_LANE = 1024


class LibraryBpe(ByteBpe):
    """The same memo of words, filled by the ``tokenizers`` library."""

    memo, slice = 144 << 20, 4_000_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(path)
        del self.rank, self.merged, self.pair, self.pair_rank, self.first_array, self.merged_array
        self.model = Tokenizer.from_file(path).model
        self.symbols = {byte: symbol for symbol, byte in _byte_symbols().items()}

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The library's model alone: the words are cut already, and what else the library does to a text costs more than its merges."""
        texts = b"\0".join(words).decode("latin-1").translate(self.symbols).split(self.symbols[0])
        if len(texts) != len(words):
            texts = [w.decode("latin-1").translate(self.symbols) for w in words]
        tokenize, ids, ends = self.model.tokenize, array("I"), [0]
        for text in texts:
            ids.extend([x.id for x in tokenize(text)])
            ends.append(4 * len(ids))
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


@lru_cache(1)
def _library(path: str) -> LibraryBpe:
    return LibraryBpe(path)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of CRC-32C (reflected polynomial 0x82F63B78): for 4 bytes at once, and for a state moved on by a lane of zeros."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1).astype(np.uint32)
    four = [one]
    for _ in range(3):
        four.append(one[four[-1] & 255] ^ (four[-1] >> 8))
    far = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_LANE):
        far = one[far & 255] ^ (far >> 8)
    return np.array(four[::-1]), far


def _step(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each of the byte strings (of 4 bytes or more), all strings at once: they are cut in lanes, whose states are joined afterwards."""
    four, far = _tables()
    size = np.array([len(p) for p in parts], np.int64)
    lanes = -(-size // _LANE)
    end = np.cumsum(lanes)
    data = np.zeros(int(end[-1]) * _LANE if len(end) else 0, np.uint8)
    begin = end * _LANE - size
    for p, b in zip(parts, begin.tolist()):
        data[b : b + len(p)] = np.frombuffer(p, np.uint8)
    for k in range(4):
        data[begin + k] ^= 255
    words = np.ascontiguousarray(data.view("<u4").reshape(-1, _LANE // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for w in words:
        state = _step(four, state ^ w)
    crc = np.zeros(len(parts), np.uint32)
    for k in range(int(lanes.max(initial=0))):
        r = np.flatnonzero(lanes > k)
        crc[r] = _step(far, crc[r]) ^ state[end[r] - lanes[r] + k]
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    """A frame around each payload."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [b"".join((n, h.tobytes(), p, b.tobytes())) for n, h, p, b in zip(lengths, heads.astype("<u4"), payloads, bodies.astype("<u4"))]


def payloads(data: bytes) -> tuple[list[bytes], int]:
    """The payloads of all whole frames, and the bytes these take. Raises ValueError where a checksum doesn't hold."""
    at, lengths, found, sums = 0, [], [], []
    while at + 12 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if n > READ and masked(crc32c([data[at : at + 8]]))[0] != struct.unpack_from("<I", data, at + 8)[0]:
            raise ValueError(f"length checksum differs at byte {at}")
        if at + 16 + n > len(data):
            break
        lengths.append(data[at : at + 8])
        found.append(data[at + 12 : at + 12 + n])
        sums.append((struct.unpack_from("<I", data, at + 8)[0], struct.unpack_from("<I", data, at + 12 + n)[0]))
        at += 16 + n
    if found:
        want = np.array(sums, np.uint32)
        if (masked(crc32c(lengths)) != want[:, 0]).any() or (masked(crc32c(found)) != want[:, 1]).any():
            raise ValueError("a record's checksum differs")
    return found, at


def write(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write record files below ``path``, a folder that all executors reach, and the index to ``path``/index; returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = _library(vocabulary), end_id.to_bytes(4, "little")
        wide = max(len(bpe.token) - 1, end_id) > 0xFFFF
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.records"
        store, folder = fs.FileSystem.from_uri(path)
        out, at = None, 0
        for batch in batches:
            for piece in byte_slices(batch, 1):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                made, counts = [], []
                for key, ids in zip(piece.column(0).to_pylist(), bpe.encode_all([x or "" for x in piece.column(1).to_pylist()])):
                    tokens = np.frombuffer(ids + end, "<u4")
                    counts.append(len(tokens))
                    made.append(struct.pack(_HEAD, wide + 2 * (key is None), key or 0) + (tokens if wide else tokens.astype("<u2")).tobytes())
                framed = frames(made)
                offsets = at + np.cumsum([0, *map(len, framed)])
                out.write(b"".join(framed))
                at = int(offsets[-1])
                n = len(framed)
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array([name] * n), pa.array(offsets[:-1]), pa.array(counts, pa.int64())], ["id", "part", "file", "offset", "n_tokens"])
        if out is not None:
            out.close()

    placed = df.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)
    index = placed.mapInArrow(run, "id bigint, part int, file string, offset bigint, n_tokens bigint")
    index.write.parquet(f"{path}/index")
    return df.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The id, ``start`` (token ids of all documents before it), ``n_tokens`` and ``ids`` (binary, little-endian u32) from the files; every checksum is held against its record."""
    index = spark.read.schema("id bigint, part int, file string, offset bigint, n_tokens bigint").parquet(f"{path}/index")
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = files.select("part", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with store.open_input_stream(f"{folder}/{name}") as file:
                    left = b""
                    while data := file.read(READ):
                        found, used = payloads(left := left + data)
                        left = left[used:]
                        rows = []
                        for p in found:
                            flags, key = struct.unpack_from(_HEAD, p)
                            ids = np.frombuffer(p, "<u4" if flags & 1 else "<u2", offset=struct.calcsize(_HEAD))
                            rows.append((None if flags & 2 else key, start, len(ids), ids.astype("<u4").tobytes()))
                            start += len(ids)
                        for at in range(0, len(rows), 1024):
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 1024]), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], [id_col, "start", "n_tokens", "ids"])
                    if left:
                        raise ValueError(f"{name} ends within a record")

    return tasks.repartition(max(1, files.count())).mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(df: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents to a new folder below the shared one, and read the files back."""
    spark = df.sparkSession
    path = scratch_uri(spark, "records")
    write(df, path, vocabulary)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
