"""Approximate nearest neighbours by a forest of hash-prefix trees.

Every tree gives a vector a string of hash symbols; the strings, sorted, are the
tree: vectors that share a prefix are neighbours in the array, so a prefix is a
range of it and no node is ever stored (LSH Forest, Bawa et al., 2005). A query
descends each tree to the longest prefix that some vector shares with it. Then
all trees ascend together, one symbol at a time; a level is finished in every
tree before the next is begun, and the ascent ends after the level at which
:data:`ENOUGH` candidates are known. A candidate's votes are the symbols it
shares with the query, over all trees; the :data:`VERIFIED` candidates of most
votes are measured exactly, on the original vectors. Where the ascent ends at
prefixes of two symbols or more, the query stands in a dense group whose members
share most of their strings; votes say little there, and all candidates are
measured.

A tree's string names the axes, with their signs, on which a random rotation of
the vector is largest, in order of size: its first symbol is cross-polytope
hashing, and one rotation gives a string as long as 62 bits hold. The rotations
see the vector about the block's mean, beside its norm's distance from the median
norm, which stretches distances by a factor between 1 and sqrt(2) and parts
vectors of one direction.

The vectors are dealt once, by a hash of the id, to blocks of bounded size, each
with a forest of its own. A task reads its block's vectors first, then the
queries stream past the forest, so the memory of a task is a block and a batch.
Of equal vectors only the ``k + 1`` of smallest ids can be answers; the others
leave before the blocks are dealt, so a group of copies fills no block.

Defined cases: vectors that are null, zero, empty or hold null or non-finite
components take no part, nor do null ids; a query meets only vectors of its own
length; a query's own id is no candidate; equal distances rank by smaller id;
fewer candidates than ``k`` give fewer rows; rows that repeat an id are one
vector if they are equal, and ranked each if not; a block of at most
:data:`VERIFIED` vectors is searched exactly; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .embedding_dedup import _matrix, usable

#: Vectors of a block on average.
BLOCK = 16_384
TREES = 192
#: Candidates that end the ascent, and those measured exactly; for each query in each block.
ENOUGH = 1024
VERIFIED = 384


@cache
def _rotations(width: int, trees: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, width])
    return np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(trees)]).astype(np.float32)


class HashForest:
    """Sorted hash strings of one block of vectors, for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 5):
        self.n, width = len(vectors), vectors.shape[1] + 1
        self.base = 2 * width
        self.depth = min(width, int(62 // math.log2(self.base)))
        self.rotations = _rotations(width, trees, seed)
        self.centre = vectors.mean(0)
        self.middle = 0.0
        self.middle = float(np.median(self._placed(vectors)[:, -1]))
        placed = self._placed(vectors)
        self.order, self.sorted = [], []
        for rotation in self.rotations:
            key = self._strings(placed, rotation)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.order.append(order)
            self.sorted.append(key[order])

    def _placed(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors - self.centre
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return np.concatenate([v, norm - self.middle], axis=1).astype(np.float32)

    def _strings(self, placed: np.ndarray, rotation: np.ndarray) -> np.ndarray:
        """Symbols of a tree, first one most significant, as one integer."""
        turned = placed @ rotation
        size = np.abs(turned)
        at = np.argpartition(size, -self.depth, axis=1)[:, -self.depth :] if self.depth < size.shape[1] else np.tile(np.arange(size.shape[1]), (len(size), 1))
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(size, at, 1), axis=1, kind="stable"), 1)
        symbols = at * 2 + (np.take_along_axis(turned, at, 1) < 0)
        out = np.zeros(len(placed), np.int64)
        for k in range(self.depth):
            out = out * self.base + symbols[:, k]
        return out

    def candidates(self, queries: np.ndarray, enough: int = ENOUGH, verified: int = VERIFIED):
        """Row numbers of the most voted candidates of each query, and how many rows got a vote."""
        placed = self._placed(queries)
        strings = [self._strings(placed, r) for r in self.rotations]
        levels = []  # ranges of every tree and query that share so many symbols, the longest prefix first
        for level in range(self.depth, 0, -1):
            cut = self.base ** (self.depth - level)
            lo = np.stack([np.searchsorted(s, q // cut * cut) for s, q in zip(self.sorted, strings, strict=True)])
            hi = np.stack([np.searchsorted(s, (q // cut + 1) * cut) for s, q in zip(self.sorted, strings, strict=True)])
            levels.append((lo, hi))
        for q in range(len(queries)):
            votes, found, most = np.zeros(self.n, np.int64), 0, verified
            for length, (lo, hi) in zip(range(self.depth, 0, -1), levels, strict=True):
                trees = np.flatnonzero(lo[:, q] < hi[:, q])
                if len(trees):
                    votes += np.bincount(np.concatenate([self.order[t][lo[t, q] : hi[t, q]] for t in trees]), minlength=self.n)
                    found = int(np.count_nonzero(votes))
                    if found >= enough:
                        most = found if length > 1 else most
                        break
            # with too few of them, the empty prefix, which all share, is the last level
            yield (np.argsort(-votes, kind="stable")[: max(most, verified)] if verified < self.n else np.arange(self.n)), found


def _best(ids, exact, asked, asker, near, k):
    """Ids and distances of the ``k`` nearest of the rows ``near``."""
    near = near[ids[near] != asker]
    difference = exact[near] - asked
    distance = np.sqrt(np.einsum("ij,ij->i", difference, difference))
    best = np.lexsort((ids[near], distance))[:k]
    return ids[near][best], distance[best]


def _search(k: int, enough: int, verified: int):
    """Over rows ``(b, asks, id, vec)`` in order: a block's vectors build its forests, one for each length, and its queries are answered by them."""

    def run(batches):
        block, held, forests = None, [], None

        def forest(d: int):
            if d not in forests:
                ids = np.concatenate([i for i, v in held if v.shape[1] == d] or [np.empty(0, np.int64)])
                if len(ids):
                    order = np.argsort(ids, kind="stable")  # results do not depend on arrival
                    exact = np.concatenate([v for _, v in held if v.shape[1] == d])[order]
                    forests[d] = ids[order], exact, HashForest(exact)
                else:
                    forests[d] = None
            return forests[d]

        for batch in batches:
            b, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            start = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (asks[1:] != asks[:-1])])) if len(b) else []
            for lo, hi in zip(start, [*start[1:], len(b)], strict=True):
                if b[lo] != block:
                    block, held, forests = b[lo], [], {}
                for d in np.unique(sizes[lo:hi]):
                    rows = pa.array(lo + np.flatnonzero(sizes[lo:hi] == d))
                    ids, x = batch.column(2).take(rows).to_numpy(), _matrix(batch.column(3).take(rows)).astype(np.float64)
                    if not asks[lo]:
                        held.append((ids, x))
                    elif (known := forest(int(d))) is not None:
                        for at in range(0, len(ids), 512):
                            for row, (near, _) in enumerate(known[2].candidates(x[at : at + 512], enough, verified), at):
                                found, distance = _best(known[0], known[1], x[row], ids[row], near, k)
                                out["query_id"].append(np.full(len(found), ids[row]))
                                out["vec_id"].append(found)
                                out["score"].append(distance)
            if out["query_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], list(out))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", enough: int = ENOUGH, verified: int = VERIFIED, block: int = BLOCK) -> DataFrame:
    """``(query_id bigint, rank int, vec_id bigint, score double)``: Euclidean distances, nearest first."""
    select = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    alike = W.partitionBy("vec").orderBy("id")
    data = select(vectors).distinct().withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1)
    blocks = max(1, math.ceil(vectors.count() / block))
    # a vector is sent once, a query to every block
    held = data.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("asks"), "id", "vec")
    asked = select(queries).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("asks"), "id", "vec")
    dealt = held.unionByName(asked).repartition(blocks, "b").sortWithinPartitions("b", "asks")
    met = dealt.mapInArrow(_search(k, enough, verified), "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
