"""Byte-level BPE encoding and decoding.

A vocabulary file of the ``tokenizers`` library gives the merges; the merging itself is done
here with contiguous rank arrays: a word's parts lie in a row, beside the merge ranks of neighbouring
parts. The lowest rank is scanned for, the boundary it names is deleted, and the ranks on
both sides of it are looked up anew. Words are short, so that the scans cost less than a heap would; the
distinct words of a batch are the rows of one matrix, which takes a step for all of them at once. Words
beyond ``LONG`` bytes take a heap instead, as scans grow with the square.

Defined cases: null text counts as empty and gives no ids; ids without a token decode to nothing;
repeated rows, nulls in the id column and empty tables pass through; extra input columns are not read.
Memory: texts are taken in slices of some megabytes, matrices have a bounded number of cells, and the memo of words is
bounded in bytes, so that a worker needs no more for long batches; one very long text is a slice of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from threadmill.llm.common import byte_slices

#: How the byte-level pre-tokenizer of these vocabularies splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words beyond so many bytes are merged with a heap.
LONG = 192
#: Cells of one matrix of words.
CELLS = 1 << 19
#: Bytes that an entry of the memo takes besides its word and ids.
_ENTRY = 160
_NONE, _PAD = (1 << 31) - 1, (1 << 20) - 1


def _byte_symbols() -> dict[str, int]:
    """The printable character by which the vocabulary file writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    #: Bytes beyond which the memo of words shrinks to those of the text at hand; it saves time only.
    memo = 96 << 20
    #: Characters of text whose new words are merged together.
    slice = 2_000_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, symbols = spec["model"]["vocab"], _byte_symbols()
        self.first = [0] * 256
        for symbol, byte in symbols.items():
            self.first[byte] = vocab[symbol]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.first_array, self.merged_array = np.array(self.first, np.int32), np.array(self.merged, np.int32)
        self.pair = np.array(sorted(self.rank), np.int64)
        self.pair_rank = np.array([self.rank[k] for k in self.pair.tolist()], np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.split = regex.compile(SPLIT)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for text, i in vocab.items():
            self.token[i] = bytes(symbols[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.pieces: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.held = 0

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Token ids of pre-split words, each as little-endian u32."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > LONG:
            i = order.pop()
            out[i] = np.array(self._merge_long([self.first[b] for b in words[i]]), "<u4").tobytes()
        while order:
            rows = max(1, CELLS // max(1, len(words[order[-1]])))
            self._merge_block(words, order[-rows:], out)
            del order[-rows:]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], _NONE)

    def _merge_block(self, words: list[bytes], order: list[int], out: list[bytes]) -> None:
        row, n = np.array(order), np.array([len(words[i]) for i in order])
        filled = np.arange(n.max(initial=0)) < n[:, None]
        parts = np.full(filled.shape, _PAD, np.int32)
        parts[filled] = self.first_array[np.frombuffer(b"".join(words[i] for i in order), np.uint8)]
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(row):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            lowest = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), _NONE)
            if (done := lowest == _NONE).any():
                ended, size = parts[done], n[done]
                ids, end = ended[np.arange(ended.shape[1]) < size[:, None]].astype("<u4").tobytes(), 0
                for i, k in zip(row[done].tolist(), size.tolist()):
                    out[i], end = ids[end : end + 4 * k], end + 4 * k
                row, n, at, lowest, parts, ranks = row[~done], n[~done], at[~done], lowest[~done], parts[~done], ranks[~done]
                if not len(row):
                    break
            each, column = np.arange(len(row)), np.arange(parts.shape[1] - 1)
            parts[each, at] = self.merged_array[lowest]
            parts = np.where(column <= at[:, None], parts[:, :-1], parts[:, 1:])
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            n = n - 1
            for side in (at - 1, at):
                r = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                ranks[r, side[r]] = self._ranks(parts[r, side[r]], parts[r, side[r] + 1])

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, by a heap over a linked list."""
        rank, n = self.rank, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = self.merged[r], False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and (y := right[x]) < n and (q := rank.get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (q, x, parts[x], parts[y]))
        return [p for p, kept in zip(parts, alive) if kept]

    def _cut(self, text: str) -> list[str]:
        """The pre-split words and special tokens of a text, in order."""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split.findall(text[at:])

    def _learn(self, heads: set[str], tails: set[str]) -> None:
        """Put the ids of texts, and of texts after a space, in the memos. A piece that begins with a space is kept as a tail, so that no word is kept twice."""
        cut: list[tuple[dict[str, bytes], str, list[str]]] = []
        plain = not any(x in y for x in self.special for y in ("\n".join(heads), "\n".join(tails)))
        after, alone = self.tails, self.pieces
        alone.update((k, i.to_bytes(4, "little")) for k, i in self.special.items())
        whole: list[str] = []
        for k in tails:
            if k.isalpha():
                whole.append(k)
            elif k[-1] in ".," and k[:-1].isalpha():
                cut.append((after, k, [" " + k[:-1], k[-1]]))
            else:
                cut.append((after, k, self.split.findall(" " + k) if plain else self._cut(" " + k)))
        cut += [(self.heads, k, self.split.findall(k) if plain else self._cut(k)) for k in heads]
        needed = {p for _, _, pieces in cut for p in pieces}
        spaced = {*whole, *(p[1:] for p in needed if p[0] == " " and len(p) > 1 and p[1:] not in after)}
        bare = [p for p in needed if (p[0] != " " or len(p) == 1) and p not in alone]
        order = [*spaced]
        made = self.merge_all([*((" " + p).encode() for p in order), *(p.encode() for p in bare)])
        after.update(zip(order, made))
        alone.update(zip(bare, made[len(order) :]))
        for memo, k, pieces in cut:
            memo[k] = b"".join([after[p[1:]] if p[0] == " " and len(p) > 1 else alone[p] for p in pieces])
        self.held += _ENTRY * (len(made) + len(cut)) + sum(map(len, order)) + sum(map(len, bare)) + sum(map(len, made)) + sum(len(k) + len(memo[k]) for memo, k, _ in cut if memo is after)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian u32.

        A lone space between other characters always starts a new word, so what lies between such spaces is
        looked up whole. A text in which a space has white space beside it, or lies at an end, stays in one piece.
        """
        at = 0
        while at < len(texts):
            cuts, size = [], 0
            while at < len(texts) and size < self.slice:
                head, *tails = texts[at].split(" ")
                cuts.append((head, tails))
                size, at = size + len(texts[at]), at + 1
            used = set().union(*(x for _, x in cuts))
            if self.held > self.memo:
                self.tails, self.pieces = {k: self.tails[k] for k in used if k in self.tails}, {}
                self.held = _ENTRY * len(self.tails) + sum(map(len, self.tails)) + sum(map(len, self.tails.values()))
            known = self.tails
            new = used.difference(known)
            unsafe = {k for k in new if not k.isalpha() and (not k or k[0].isspace() or k[-1].isspace())}
            for i, (head, tails) in enumerate(cuts):
                if tails and (not head or head[-1].isspace() or (unsafe and not unsafe.isdisjoint(tails))):
                    cuts[i] = (" ".join([head, *tails]), [])
            self._learn({x for x, _ in cuts}, new - unsafe)
            known = self.tails
            for head, tails in cuts:
                yield b"".join((self.heads[head], *itemgetter(*tails)(known))) if len(tails) > 1 else b"".join([self.heads[head], *(known[x] for x in tails)])
            self.heads.clear()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        token = self.token
        if (found := np.frombuffer(ids, "<u4")).size and found.max() >= len(token):
            found = found[found < len(token)]
        return b"".join(map(token.__getitem__, found.tolist())).decode("utf-8", "replace")


@lru_cache(1)
def _bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _texts(piece: pa.RecordBatch) -> list[str]:
    return [x or "" for x in piece.column(1).to_pylist()]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", memo: int = ByteBpe.memo) -> DataFrame:
    """Columns: the id, ``n_tokens`` and ``ids`` (binary, little-endian u32). ``path``: a vocabulary file that every executor has; ``memo``: bytes of words that a worker remembers. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        bpe.memo = memo
        for piece in (p for batch in batches for p in byte_slices(batch, 1)):
            ids = [*bpe.encode_all(_texts(piece))]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Takes what ``encode`` returns; adds ``decoded``, the text of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for piece in (p for batch in batches for p in byte_slices(batch, 2)):
            texts = [bpe.decode(x or b"") for x in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [id_col, "n_tokens", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every document: the id, ``n_tokens``, and the SHA-256 of its ids and of the text decoded from them. One worker encodes, decodes and hashes, so that neither ids nor texts go back to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for piece in (p for batch in batches for p in byte_slices(batch, 1)):
            rows = [(len(ids) // 4, sha(ids), sha(bpe.decode(ids).encode())) for ids in bpe.encode_all(_texts(piece))]
            n, of_ids, of_text = zip(*rows)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
