"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match segmentation without building a piece: a trie of the
vocabulary gets failure links, and every node the number of pieces that its
failure pops (Song et al., Fast WordPiece Tokenization, 2021). Following a
failure link adds that number, so a word of n characters costs O(n) steps
whatever the vocabulary, and only counts are kept.

A word is a run of characters other than space and \\x09-\\x0D. It is prefixed by
the vocabulary's word mark, so pieces that start a word and pieces that continue
one share the trie. A character that no piece starts with ends the match and
counts as one piece for each of its UTF-8 bytes (byte fallback).

Defined cases: a null or empty text has no words and no pieces; texts are
counted whole; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

MARK = "▁"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


class LongestMatch:
    """The automaton over a list of pieces."""

    def __init__(self, pieces):
        self.next: list[dict[str, int]] = [{}]
        #: Pieces that a node's own string counts as, 0 if it is none.
        self.own = [0]
        for piece in pieces:
            node = 0
            for c in piece:
                child = self.next[node].get(c)
                if child is None:
                    child = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.own.append(0)
                node = child
            self.own[node] = 1
        for c, child in self.next[0].items():  # a character that is no piece falls back to its bytes
            self.own[child] = self.own[child] or len(c.encode())
        #: Node of what is left once the pieces that failing here pops are gone, and their number.
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                queue.append(child)
                if self.own[child]:
                    self.pops[child] = self.own[child]
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if c in self.next[at]:
                    self.fail[child], self.pops[child] = self.next[at][c], popped
                else:  # c starts no piece: it can't follow, so the path is left as bytes
                    self.fail[child], self.pops[child] = 0, popped + len(c.encode())

    def count(self, word: str) -> int:
        total, node = 0, 0
        nexts, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while (to := nexts[node].get(c)) is None:
                if node == 0:
                    total += len(c.encode())  # no piece starts with it
                    break
                total += pops[node]
                node = fail[node]
            else:
                node = to
        while node:
            total += pops[node]
            node = fail[node]
        return total


def vocabulary(model: str) -> list[str]:
    """Pieces of a SentencePiece model file, control and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class _Counts(dict):
    LIMIT = 1 << 18

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(MARK + word)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, pieces: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_words bigint, n_tokens bigint)``, one row per row of ``docs``.

    ``pieces`` is a vocabulary of fixed size, sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        counts = _Counts(LongestMatch(shared.value))
        for batch in batches:
            words = [_WORDS(t) if t else [] for t in batch.column(1).to_pylist()]
            tokens = [sum(map(counts.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(tokens, pa.int64())], [key, "n_words", "n_tokens"])

    return in_small_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words bigint, n_tokens bigint")
