"""Quality scores learned from preference pairs (Bradley-Terry).

A document's strength is linear in features of its whole text. For a preferred
document i and another j the model says P(i over j) = sigmoid(s_i - s_j), so the
loss is logistic in the difference of their features; it is minimised by
Newton steps. The score quantile that matches the share of rejected documents
among the training labels becomes the threshold, and scores are a sigmoid around
it: 0.5 is the threshold itself.

The model is fitted on all labelled documents that may teach. Each of them draws
:data:`PAIRS_EACH` partners of the other class from its block of rows, so each is
in as many pairs or more; medians, spreads, gradients, the threshold and its scale
are sums over all blocks (order statistics by counts of their leading bits, exactly).
Up to :data:`FEW` rows of features (a few dozen numbers a document) are summed on
the driver; more stay in the shared folder, and the driver receives sums only, of a
size that the features' number fixes. Everything else is one pass over the texts.
Labels, language, source and id are never features.

Defined cases: null and empty texts have the features of an empty text and are
scored; texts are read whole; repeated rows give repeated rows; a document that
is labelled 0 and 1 teaches nothing, one that is labelled alike twice counts
once, as does an id with several texts, by the least of their features; equal
texts score alike, and equal strengths are no preference; other columns pass
through :func:`keep` and are ignored by :func:`score`; with labels of one class
only, or none, every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gathered, in_small_batches

#: Labelled rows whose features are brought to the driver, at most; the code that fits is the same.
FEW = 20_000
#: Binary logarithm of the rows of a block, which draw their pairs from one another.
BLOCK_BITS = 12
#: Rows of a file of blocks.
FILE = 8 << BLOCK_BITS
#: Preference pairs drawn for each labelled document.
PAIRS_EACH = 4

_SYMBOLS = b"#*%&$!|@<>{}[]_=~^+/\\"
_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 4
_KIND[128:] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 6


def features(text: bytes | None) -> list[float]:
    """Numbers that describe a text's form, not its subject."""
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    n = max(1, len(raw))
    by_byte = np.bincount(raw, minlength=256)
    by_kind = np.bincount(kind, minlength=7)
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    top = counts.most_common(5)
    lines = [x for x in text.split(b"\n") if x.strip()]
    punct = kind == 4
    letters = max(1, by_kind[1] + by_kind[2] + by_kind[5])
    share = by_byte[by_byte > 0] / n
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    return [
        np.log1p(len(words)),
        sizes.mean(),
        sizes.std(),
        (sizes > 20).mean(),
        (sizes <= 3).mean(),
        len(counts) / m,
        len(counts) / m * np.log1p(m),
        pairs / max(1, len(words) - 1),
        top[0][1] / m if top else 0.0,
        sum(c for _, c in top) / m,
        sum(map(eq, words, words[1:])) / m,
        by_kind[2] / letters,
        by_kind[3] / n,
        by_kind[4] / n,
        by_kind[5] / n,
        by_kind[6] / n,
        (punct[1:] & punct[:-1]).sum() / n,
        (punct[1:] & (raw[1:] == raw[:-1])).sum() / n,
        sum(by_byte[c] for c in _SYMBOLS) / n,
        by_byte[ord("|")] / m,
        by_byte[ord("!")] / m,
        (by_byte[ord(".")] + by_byte[ord("?")]) / m,
        by_byte[ord(",")] / m,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        float(-(share * np.log(share)).sum()),
    ]


def _expand(x: np.ndarray, model: Model) -> np.ndarray:
    """Standardised features, their squares and positive parts, all bounded."""
    z = np.clip((x - model.mean) / model.spread, -5, 5)
    return np.concatenate([z, z * z / 5, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _expand(x, self) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) / self.scale, -30, 30)))


#: Sum of what a function of the features and labels of a block gives, over all blocks; nothing for no rows.
Over = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray | None]


def _ranked(over: Over, values: Callable[[np.ndarray], np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """The values of the given ranks (from 0; a row of ranks for each column of ``values``), exactly: eleven bits of their order a pass."""
    sign = np.uint64(1 << 63)
    prefix, left = np.zeros(ranks.shape, np.uint64), ranks.astype(np.int64)
    for shift, bits in ((53, 11), (42, 11), (31, 11), (20, 11), (9, 11), (0, 9)):

        def count(x, label, shift=np.uint64(shift), bits=np.uint64(bits), prefix=prefix):
            b = (np.ascontiguousarray(values(x), np.float64) + 0.0).view(np.uint64)
            b = np.where(b & sign, ~b, b | sign) >> shift
            size = 1 << int(bits)
            head, digit = b >> bits, (b & np.uint64(size - 1)).astype(np.int64)
            return np.concatenate([np.bincount(digit[head[:, c] == prefix[t, c], c], minlength=size) for t, c in np.ndindex(prefix.shape)])

        below = over(count).reshape(*ranks.shape, -1).astype(np.int64).cumsum(axis=-1)
        digit = (below <= left[..., None]).sum(axis=-1)
        left -= np.where(digit > 0, np.take_along_axis(below, np.maximum(digit - 1, 0)[..., None], -1)[..., 0], 0)
        prefix = prefix << np.uint64(bits) | digit.astype(np.uint64)
    return np.where(prefix & sign, prefix ^ sign, ~prefix).view(np.float64)


def _step(model: Model, pools: dict[int, np.ndarray], pairs_each: int, seed: int):
    """Gradient and Hessian of a block's pairs: each row with ``pairs_each`` of the other class, whose rows come equally often.

    A block that lacks a class takes its partners from that class's pool.
    """

    def run(x, label):
        z = _expand(x, model)
        good, bad = z[label == 1], z[label == 0]
        goods, bads = len(good), len(bad)
        good, bad = good if goods else _expand(pools[1], model), bad if bads else _expand(pools[0], model)
        rng = np.random.default_rng([seed, goods, bads])
        gradient, hessian = np.zeros(z.shape[1]), np.zeros((z.shape[1], z.shape[1]))
        for _ in range(pairs_each):
            i = np.concatenate([np.arange(goods), np.resize(rng.permutation(len(good)), bads)])
            j = np.concatenate([np.resize(rng.permutation(len(bad)), goods), np.arange(bads)])
            d = good[i] - bad[j]
            p = 1 / (1 + np.exp(-np.clip(d @ model.weights, -30, 30)))
            gradient += d.T @ (p - 1)
            hessian += (d * (p * (1 - p))[:, None]).T @ d
        return np.concatenate([gradient, hessian.ravel()])

    return run


def _fit(over: Over, first: Callable[[int], np.ndarray], pairs_each: int, ridge: float, seed: int) -> Model:
    """Model from sums over all blocks; ``first`` gives up to a block of features of a class."""
    width = len(features(None))

    def tally(x, label):
        goods = int((label == 1).sum())
        return np.concatenate([[goods, len(label) - goods, goods == 0, goods == len(label)], x.sum(axis=0)])

    sums = over(tally)
    if sums is None or not (sums[0] and sums[1]):
        return Model(np.zeros(width), np.ones(width), np.zeros(4 * width))
    bads, rows = int(sums[1]), int(sums[0] + sums[1])
    pools = {label: first(label) for label, lacking in ((1, sums[2]), (0, sums[3])) if lacking}
    mean = sums[4:] / rows
    spread = np.sqrt(over(lambda x, label: ((x - mean) ** 2).sum(axis=0)) / rows)
    middle = _ranked(over, lambda x: x, np.array([[(rows - 1) // 2] * width, [rows // 2] * width])).mean(axis=0)
    model = Model(middle, np.maximum(spread, 1e-6), np.zeros(4 * width))
    for _ in range(12):
        sums = over(_step(model, pools, pairs_each, seed)) / (pairs_each * rows)
        w = model.weights
        gradient = sums[: len(w)] + ridge * w
        hessian = sums[len(w) :].reshape(len(w), -1) + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        model = replace(model, weights=w - move)
        if np.abs(move).max() < 1e-10:
            break
    # the quantile of the share to reject; midway to the next strength, so that it parts them
    threshold = float(_ranked(over, lambda x: model.strength(x)[:, None], np.array([[bads - 1], [bads]])).mean())
    mean = over(lambda x, label: model.strength(x).sum(keepdims=True)) / rows
    spread = np.sqrt(over(lambda x, label: ((model.strength(x) - mean) ** 2).sum(keepdims=True)) / rows)
    return replace(model, threshold=threshold, scale=max(float(spread[0]) / 4, 1e-9))


def fit(x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Weights from random pairs of a preferred and another document; every row is in ``pairs_each`` or more."""
    order = np.random.default_rng(seed).permutation(len(label))
    cuts = np.split(order, range(1 << BLOCK_BITS, len(order), 1 << BLOCK_BITS)) if len(order) else []
    return _fit(lambda measure: sum(measure(x[c], label[c]) for c in cuts) if cuts else None, lambda kind: x[order[label[order] == kind][: 1 << BLOCK_BITS]], pairs_each, ridge, seed)


def _fit_where_it_is(blocks: DataFrame, pairs_each: int = PAIRS_EACH, ridge: float = 1e-3, seed: int = 7) -> Model:
    """:func:`fit` of the saved rows ``(block, _label, x)``, those of a block one after the other."""
    width, most = len(features(None)), 1 << BLOCK_BITS

    def over(measure):
        def run(batches):
            total = None
            held: list[np.ndarray] = []  # block, label and features

            def add():
                nonlocal total
                rows = np.concatenate(held)
                part = np.asarray(measure(rows[:, 2:], rows[:, 1].astype(int)), np.float64)
                total = part if total is None else total + part
                held.clear()

            for batch in gathered(batches, most):
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                block = batch.column(0).to_numpy(zero_copy_only=False)
                rows = np.column_stack([np.zeros(len(x)), batch.column(1).to_numpy(zero_copy_only=False), x])
                for part, number in zip(np.split(rows, starts := np.flatnonzero(np.diff(block)) + 1), block[[0, *starts]], strict=True):
                    if held and last != number:
                        add()
                    last = number
                    held.append(part)
            if held:
                add()
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part"])

        parts = blocks.select("block", "_label", "x").mapInArrow(run, "part binary").collect()
        total = None
        for row in parts:
            part = np.frombuffer(zlib.decompress(row["part"]))
            total = part if total is None else total + part
        return total

    def first(kind):
        return np.array([r["x"] for r in blocks.where(F.col("_label") == kind).select("x").limit(most).collect()], float)

    return _fit(over, first, pairs_each, ridge, seed)


def _with_features(docs: DataFrame, text: str, key: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in column], pa.list_(pa.float64()))], [key, "x"])

    return in_small_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, x array<double>")


def held_out(key: str = "doc_id"):
    """Rows that never train: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int | None = None, text: str = "text", key: str = "doc_id", few: int = FEW) -> Model:
    """Model from the labelled rows of ``docs`` that are not held out: all, or the first ``sample`` by a hash of the id where that is asked for."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min(label).cast("int").alias("_label"), F.max(label).alias("_most"))
    known = known.where("_label = _most").drop("_most")
    if sample is not None:
        known = known.join(docs.select(key).distinct(), key, "left_semi").orderBy(F.xxhash64(key), key).limit(sample)
    known = scratch.save(known, "known", small=True)
    count = known.count()
    chosen = docs.select(key, text).where(F.col(key).isNotNull() & ~held_out(key))
    if count <= few:  # else most of the texts are taken to be labelled
        chosen = chosen.join(F.broadcast(known.select(key)), key, "left_semi")
    told = _with_features(chosen, text, key).groupBy(key).agg(F.min("x").alias("x")).join(known, key)
    if count <= few:
        rows = told.orderBy(key).toPandas()
        x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(features(None)))
        model = fit(x, rows["_label"].to_numpy())
    else:
        dealt = told.repartition(-(-count // FILE), key).sortWithinPartitions(F.xxhash64(key), key)
        blocks = dealt.select(F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"), "_label", "x")
        model = _fit_where_it_is(scratch.save(blocks, "blocks"))
    scratch.drop("known", "blocks")
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, score)`` of every row of ``docs``."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
            x = np.array([features(t) for t in column], float).reshape(len(column), -1)
            values = model.score(x) if len(column) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], [key, "score"])

    return in_small_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all their columns, that score ``least`` or more."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
            if column:
                x = np.array([features(t) for t in column], float).reshape(len(column), -1)
                yield batch.filter(pa.array(model.score(x) >= least))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
