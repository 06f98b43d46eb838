"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word keeps its parts and the ranks of its adjacent pairs in two small
contiguous arrays. The smallest rank is found by scanning, the boundary between
its two parts is deleted, and the ranks left and right of the new part are
looked up again. Words of one length are rows of one matrix, so that a scan
serves thousands of words. Scanning costs less than a heap for words of a few
dozen bytes; longer words use a heap over linked parts, which stays near linear.

Defined cases: a null text counts as empty and gives no ids and an empty decoded
text. Texts are encoded whole, however long. Repeated rows give repeated rows.
Columns other than the id and text column are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import array
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

#: How the tokenizer file splits text before merging; a fixed pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: The same split in the faster standard module, for texts in which its classes
#: agree with Unicode's: no underscore, no separator control, and no number
#: outside the decimal digits (:data:`_ODD_CHARACTER` finds those).
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+").findall
_EXACT = regex.compile(PATTERN).findall
_ODD_CHARACTER = regex.compile(r"[_\x1c-\x1f\p{Nl}\p{No}]").search

#: Words up to this many bytes are merged in the rank array.
SHORT = 160
_NONE = 1 << 60
_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1


def byte_symbols() -> dict[str, int]:
    """Printable symbol of each byte in byte-level vocabularies: bytes that print stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE(dict):
    """Encoder and decoder for one tokenizer file's content.

    As a dict it remembers, up to :data:`CACHE` entries, the ids of short words
    as packed little-endian int32, so a text's ids are one join of such pieces.
    """

    CACHE = 1 << 18

    def __init__(self, content: str):
        super().__init__()
        spec = json.loads(content)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.single = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.single[symbols[token]] = i
        #: pair of ids -> rank and id of their merge, in one integer each
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << _ID_BITS | vocab[right]] = rank << _ID_BITS | vocab[left + right]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        of = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = [len(of.get(i, b"")) for i in range(max(of) + 1)]
        self.size = np.array(size, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.blob = np.frombuffer(b"".join(of.get(i, b"") for i in range(len(size))), np.uint8)

        keys = np.array(sorted(self.merges), np.int64)
        self.pair, self.merged = keys, np.array([self.merges[k] for k in keys.tolist()], np.int64)
        self.first = np.array([[self.merges.get(a << _ID_BITS | b, _NONE) for b in self.single] for a in self.single], np.int64)
        self.single_of = np.array(self.single, np.int64)

    def __missing__(self, word: str) -> bytes:
        """Words too long for the arrays."""
        return array.array("i", self._linked([self.single[b] for b in word.encode()])).tobytes()

    def learn(self, words: set[str]) -> None:
        """Merge all short words not known yet, those of one length side by side."""
        new = {w for w in words if w not in self}
        if len(self) + len(new) > self.CACHE:
            self.clear()
            new = words
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in new:
            data = word.encode()
            if len(data) <= SHORT:
                by_size.setdefault(len(data), []).append((word, data))
        for size, some in by_size.items():
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                data = np.frombuffer(b"".join([d for _, d in part]), np.uint8).reshape(len(part), size)
                for row, ids in self._arrays(data):
                    flat, step = ids.astype(np.int32).tobytes(), 4 * ids.shape[1]
                    for k, r in enumerate(row.tolist()):
                        self[part[r][0]] = flat[k * step : (k + 1) * step]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _ID_BITS | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], _NONE)

    def _arrays(self, data: np.ndarray):
        """Rank arrays of equally long words, one word a row.

        Each pass deletes one boundary in every word that still has a merge, so
        all rows keep as many parts. Yields (rows, ids) as words come to an end.
        """
        row = np.arange(len(data))
        parts, ranks = self.single_of[data], self.first[data[:, :-1], data[:, 1:]]
        while len(row) and ranks.shape[1]:
            at = ranks.argmin(1)
            here = np.arange(len(row))
            least = ranks[here, at]
            if (over := least == _NONE).any():
                yield row[over], parts[over]
                go = ~over
                row, parts, ranks, at, least = row[go], parts[go], ranks[go], at[go], least[go]
                here = np.arange(len(row))
                if not len(row):
                    return
            parts[here, at] = new = least & _ID_MASK
            column = np.arange(parts.shape[1] - 1)
            parts = np.where(column <= at[:, None], parts[:, :-1], parts[:, 1:])
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            if (some := np.flatnonzero(at > 0)).size:
                ranks[some, at[some] - 1] = self._rank(parts[some, at[some] - 1], new[some])
            if (some := np.flatnonzero(at < ranks.shape[1])).size:
                ranks[some, at[some]] = self._rank(new[some], parts[some, at[some] + 1])
        if len(row):
            yield row, parts

    def _linked(self, parts: list[int]) -> list[int]:
        get, n = self.merges.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] << _ID_BITS | parts[i + 1]))]
        heap = [(m >> _ID_BITS, i, m & _ID_MASK, a, b) for m, i, a, b in heap]
        heapq.heapify(heap)

        def propose(i: int, j: int) -> None:
            if m := get(parts[i] << _ID_BITS | parts[j]):
                heapq.heappush(heap, (m >> _ID_BITS, i, m & _ID_MASK, parts[i], parts[j]))

        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                propose(i, k)
            if before[i] >= 0:
                propose(before[i], i)
        return [p for p in parts if p >= 0]

    def split(self, text: str) -> list[str | int]:
        """Words to merge; ids where special tokens' strings stand."""
        if self.specials is not None and any(s in text for s in self.special):
            out: list[str | int] = []
            for piece in self.specials.split(text):
                out += [self.special[piece]] if piece in self.special else self._words(piece)
            return out
        return self._words(text)

    @staticmethod
    def _words(text: str) -> list[str]:
        return _EXACT(text) if _ODD_CHARACTER(text) else _FAST(text)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a text that stands there several times is encoded once."""
        words = {t: self.split(t) if t else [] for t in texts}
        known = set().union(*words.values())
        ids = {x for x in known if isinstance(x, int)}
        self.learn(known - ids)
        self.update((x, np.int32(x).tobytes()) for x in ids)
        made = {t: np.frombuffer(b"".join(map(self.__getitem__, w)), np.int32) for t, w in words.items()}
        return [made[t] for t in texts]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return ""
        where = np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])
        return self.blob[where].tobytes().decode("utf-8", "replace")


_MADE: dict[str, ByteBPE] = {}


def made(content: str) -> ByteBPE:
    """A worker's encoder, kept from task to task."""
    if content not in _MADE:
        _MADE.clear()
        _MADE[content] = ByteBPE(content)
    return _MADE[content]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", decode: bool = True) -> DataFrame:
    """``(key, n_tokens bigint, ids array<int>[, decoded string])``, one row per row of ``docs``.

    ``tokenizer`` is the path of the tokenizer file on the driver; its content, a
    vocabulary of fixed size, goes to the executors in a broadcast variable.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        bpe = made(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = bpe.encode_all(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                cols = [part.column(0), pa.array(sizes), lists]
                if decode:
                    cols.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [key, "n_tokens", "ids", "decoded"][: len(cols)])

    schema = f"`{key}` {kind}, n_tokens bigint, ids array<int>" + ", decoded string" * decode
    return in_small_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """SHA-256 of the comma-joined ids and of the decoded text."""
    return encoded.select(
        key,
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
