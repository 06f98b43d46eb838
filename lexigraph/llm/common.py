"""What the operators share: scratch tables, words, shingle sets, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components  # noqa: F401
from ..sources.scratch import Scratch, made, shared_dir, sweep  # noqa: F401

#: A word is a run of bytes other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch of texts, which may be long; in the JVM a batch is held once or twice for every core.
ROWS = 1024


def in_small_batches(texts: DataFrame) -> DataFrame:
    """``texts``, which the session is set to send to Python in batches of at most :data:`ROWS` rows."""
    setting, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", texts.sparkSession.conf
    if not 0 < int(conf.get(setting)) <= ROWS:
        conf.set(setting, str(ROWS))
    return texts


def gathered(batches, rows: int = 16_384):
    """The rows of narrow batches in fewer ones, of ``rows`` or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# --------------------------------------------------------------- shingle sets


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound of entries."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``width``-word shingles.

    ASCII capitals are lowered. Fewer words than ``width`` make one shingle of
    the whole sequence; no words, or no text, an empty set.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < width:
        return _mix((h * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = h[: n - width + 1] * _ODD[0]
    for k in range(1, width):
        total += h[k : n - width + 1 + k] * _ODD[k]
    return np.unique(_mix(total))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


# ------------------------------------------------------------ bounded sketches


SLICES = 16
#: Tasks whose counts one task adds up.
FAN_IN = 32


def slice_batch(counts: np.ndarray, **constant) -> pa.RecordBatch:
    """A task's counts as :data:`SLICES` rows ``(slice, item, counts)``; ``constant`` gives types of further, null columns."""
    kind = np.uint16 if counts.max(initial=0) < 65536 else np.int64
    step = len(counts) // SLICES
    blobs = [counts[i * step : (i + 1) * step].astype(kind).tobytes() for i in range(SLICES)]
    columns = [pa.nulls(SLICES, t) for t in constant.values()]
    columns += [pa.array(range(SLICES), pa.int32()), pa.array([kind().itemsize] * SLICES, pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [*constant, "slice", "item", "counts"])


def summed(parts: DataFrame, width: int, scratch: Scratch, name: str) -> np.ndarray:
    """Sum of the tasks' count arrays of ``width`` numbers, by a tree: each task adds up at most :data:`FAN_IN` of those before it.

    No task holds more than ``width`` sums and a batch, and the driver receives
    ``width`` counters in all, whatever the number of rows or of tasks.
    """
    step = width // SLICES

    def add(batches):
        total = np.zeros((SLICES, step), np.int64)
        for batch in batches:
            for k, item, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total[k] += np.frombuffer(blob, np.uint16 if item == 2 else np.int64)
        if total.any():
            yield slice_batch(total.ravel())

    now, level = scratch.save(parts.select("slice", "item", "counts").mapInArrow(add, "slice int, item int, counts binary"), f"{name}-0"), 0
    tasks = now.rdd.getNumPartitions()  # of a plain scan
    while tasks > 1:
        tasks, level = -(-tasks // FAN_IN), level + 1
        now = scratch.save(now.coalesce(tasks).mapInArrow(add, "slice int, item int, counts binary"), f"{name}-{level}", small=True)
        scratch.drop(f"{name}-{level - 1}")
    out = np.zeros(width, np.int64)
    for row in now.toLocalIterator():
        out[row["slice"] * step : (row["slice"] + 1) * step] += np.frombuffer(row["counts"], np.uint16 if row["item"] == 2 else np.int64)
    return out


def anti(rows: DataFrame, gone: DataFrame, key: str, limit: int = 4_000_000) -> DataFrame:
    """``rows`` whose key is not in the one-column ``gone``; broadcast only where ``gone`` is counted to hold at most ``limit`` ids of 8 bytes, a shuffled join beyond."""
    few = gone.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti")


def spread_join(rows: DataFrame, side: DataFrame, key: str, most: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` to ``side``, one row a key, whatever share of the rows one key holds.

    Keys that hold more than one in ``most`` of the rows, so fewer than ``most``
    keys at any size, have their side broadcast and their rows stay where they
    are; the rest is a shuffled join without a hot key. ``rows`` and ``side`` are
    read twice and should be saved. ``counts``, if known, are the rows ``_n`` of a key.
    """
    hot = counts if counts is not None else rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = hot.where(F.col("_n") > max(1.0, rows.count() / most)).select(key)
    here = rows.join(F.broadcast(side.join(F.broadcast(hot), key, "left_semi")), key)
    # a hot key without a partner stays among the rest
    known = side.join(F.broadcast(hot), key, "left_semi").select(key)
    rest = rows.join(F.broadcast(known), key, "left_anti").join(side, key, "left")
    return here.unionByName(rest)
