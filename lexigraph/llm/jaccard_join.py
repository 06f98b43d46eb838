"""N-gram Jaccard join: groups of documents whose shingle sets are alike.

A document's set is its distinct five-word shingles. Two documents link when
their sets' Jaccard similarity reaches the threshold (75 / 100); the result is
every document's set size and the smallest id reachable by links. The join is
exact. It is after the set-relation skipping of Wang et al. (VLDB 2017):

* Documents with equal sets are one class from the start.
* An index list holds, for one shingle, the classes that have it among their
  rarest shingles (the prefix that two linked sets must share), ordered by its
  position there and by set size. Entries of one position and size are a block;
  whether two entries may link depends on their blocks alone, so it is asked once
  a pair of blocks, and blocks that can't are skipped whole.
* Answers, first round: each list is answered for its first two classes only,
  those in which the shingle stands earliest, so the ones with the fewest rare
  shingles, the centres of groups of copies. Links found exactly make components;
  every answer is kept. Second round: within a list only pairs of classes in
  *different* components are looked at, since a pair in one component could not
  change the result.
* A class that linked takes the set it is most like as its model. What the first
  round told of two models bounds the overlap of the classes modelled on them:
  it can exceed the models' by no more than the shingles that a class has beyond
  its model. Answers derived so need no set to be read.
* Of the pairs left, bitmaps of two bits a shingle and more bound the overlap
  before whole sets are sent to be compared.

Links inside a component are never looked at, so there are no counts of links; a
group of k copies costs about k comparisons, not k * k.

Rarity is an estimate from a counting sketch of fixed width over all documents;
any order is correct, a better one only skips more. A list expected to be longer
than :data:`LIST` is dealt to parts, whose centres meet in a list of their own;
in the second round a long list is cut into blocks of :data:`PART`, and those of
its largest component, which have nothing to ask of each other, meet only the
rest. Lists stream from a sort; no task holds more than two parts.

Classes are told by 64 bits of a 128-bit digest, and by the other 64 where two
digests agree in the first (three classes among 10^10 documents, counted and
sent to the tasks).

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is a component of its own; fewer than five words are one shingle;
texts are read whole; every row is a document of its own, so an id that repeats,
with one text or several, has a row in the component of each; rows without id
link like others, but name no component unless it has no id at all, which is
then null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, anti, as_bytes, connected_components, gathered, in_small_batches, shingle_set, slice_batch, spread_join, summed

#: Similarity, as a fraction of whole numbers.
THRESHOLD = (75, 100)
WIDTH = 5
#: Counters of the rarity sketch, and of the filter of classes to verify.
SKETCH = 1 << 19
FILTER = 1 << 20
#: Entries of a list that one task streams in the first round, and that one task compares in the second.
LIST = 1 << 16
PART = 512
_POSITION = 32


def _digests(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two signed 64-bit numbers that identify a set, the first cut to ``bits`` bits."""
    both = xxhash.xxh3_128_intdigest(s.tobytes(), seed=len(s))
    return int(np.int64(np.uint64(both & ((1 << bits) - 1)))), int(np.int64(np.uint64(both >> 64)))


class Identity:
    """Number of a set's class: the first digest, or the second where the first is shared."""

    def __init__(self, bits: int = 64, shared: frozenset[int] = frozenset()):
        self.bits, self.shared = bits, shared

    def __call__(self, s: np.ndarray) -> int:
        first, second = _digests(s, self.bits)
        return second if first in self.shared else first


def _needed(x, y, threshold):
    """Least overlap of sets of sizes x and y that links them."""
    num, den = threshold
    return -(-num * (x + y) // (num + den))


def _survey(docs: DataFrame, digest_bits: int) -> DataFrame:
    """Per row its id, set size and digests; per task the shingle counts."""

    def run(batches):
        hashes, counts = WordHashes(), np.zeros(SKETCH, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingle_set(t, hashes, WIDTH) for t in as_bytes(part.column(1))]
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                n = [len(s) for s in sets]
                digests = [_digests(s, digest_bits) if len(s) else (None, None) for s in sets]
                classes, others = ([d[k] for d in digests] for k in (0, 1))
                bits = [_bitmap(s) if len(s) else None for s in sets]
                empty = [pa.nulls(len(n), t) for t in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(others, pa.int64()), pa.array(bits, pa.binary()), *empty], ["doc_id", "n", "cls", "other", "bits", "slice", "item", "counts"])
        if counts.any():
            yield slice_batch(counts, doc_id=pa.int64(), n=pa.int64(), cls=pa.int64(), other=pa.int64(), bits=pa.binary())

    return docs.mapInArrow(run, "doc_id bigint, n bigint, cls bigint, other bigint, bits binary, slice int, item int, counts binary")


def _bitmap(s: np.ndarray) -> bytes:
    """A set's shingles by their leading bits, in at least two bits a shingle: a power of two of them."""
    k = max(3, (2 * len(s) - 1).bit_length())
    marks = np.zeros(1 << k, np.uint8)
    marks[(s >> np.uint64(64 - k)).astype(np.int64)] = 1
    return np.packbits(marks).tobytes()


def _most_shared(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """No overlap of two sets exceeds this: buckets that both fill, and the members that share a bucket with others of their set."""
    a, b = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y))
    while len(a) > len(b):
        a = a[::2] | a[1::2]
    while len(b) > len(a):
        b = b[::2] | b[1::2]
    return int(np.count_nonzero(a & b)) + min(nx - int(np.count_nonzero(a)), ny - int(np.count_nonzero(b)))


def _bounded(pairs: DataFrame, classes: DataFrame, threshold) -> DataFrame:
    """``(a, b, most, open)``: what the bitmaps let two sets share at most, and whether that leaves room for a link."""

    def run(batches):
        for batch in batches:
            a, b, nx, ny, x, y = (batch.column(k).to_pylist() for k in range(6))
            most = [_most_shared(p, n, q, m) for n, m, p, q in zip(nx, ny, x, y, strict=True)]
            left = [s >= _needed(n, m, threshold) for n, m, s in zip(nx, ny, most, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(most, pa.int64()), pa.array(left, pa.bool_())], ["a", "b", "most", "open"])

    left = pairs.select("a", "b").join(classes.select(F.col("cls").alias("a"), F.col("n").alias("nx"), F.col("bits").alias("x")), "a")
    both = left.join(classes.select(F.col("cls").alias("b"), F.col("n").alias("ny"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", "nx", "ny", "x", "y").mapInArrow(run, "a bigint, b bigint, most bigint, open boolean")


def _prefixes(docs: DataFrame, shared, threshold, identity: Identity, longest: int) -> DataFrame:
    """``(tok, part, meta, cls)``: prefix shingles, rarest first; meta is position and set size.

    ``part`` is 0, or that of the class in a list that may be longer than ``longest``.
    """
    num, den = threshold

    def run(batches):
        hashes, sketch = WordHashes(), np.frombuffer(shared.value, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                seen, toks, parts, metas, classes = set(), [], [], [], []
                for text in as_bytes(batch.column(0).slice(at, 512)):
                    s = shingle_set(text, hashes, WIDTH)
                    n = len(s)
                    if not n or (c := identity(s)) in seen:
                        continue
                    seen.add(c)
                    size = n - -(-num * n // den) + 1
                    seldom = sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    if size < n:
                        first = np.argpartition(seldom, size - 1)
                        bar = seldom[first[size - 1]]
                        first = np.flatnonzero(seldom <= bar)
                    else:
                        first = np.arange(n)
                    first = first[np.lexsort((s[first], seldom[first]))][:size]
                    toks.append(s[first].view(np.int64))
                    split = seldom[first] // longest
                    parts.append(np.where(split > 0, c % (split + 1) + 1, 0))
                    metas.append((np.arange(len(first), dtype=np.int64) << _POSITION) | n)
                    classes.append(np.full(len(first), c, np.int64))
                if toks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (toks, parts, metas, classes)], ["tok", "part", "meta", "cls"])

    return docs.select("text").mapInArrow(run, "tok bigint, part bigint, meta bigint, cls bigint")


def _possible(meta_x, meta_y, threshold):
    """Whether sizes and positions of a shared shingle let two sets link, were it the first they share."""
    mask = (1 << _POSITION) - 1
    x, y = meta_x & mask, meta_y & mask
    left = np.minimum(x - (meta_x >> _POSITION), y - (meta_y >> _POSITION))
    return (np.minimum(x, y) * threshold[1] >= np.maximum(x, y) * threshold[0]) & (left >= _needed(x, y, threshold))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that agree in all columns begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _centres(threshold):
    """First round over lists in order ``(tok, part, meta, cls)``: pairs with a list's first two classes, and the entries left over.

    Gives ``(tok, part, a, b)``: tok null and a pair of classes, or a list's
    entry with its class and meta. Of the parts of a long list all entries are
    left over, and ``part`` is 1 for their centres. Only the two centres of the
    list in hand are remembered.
    """

    def run(batches):
        held: tuple = (None, np.empty((4, 0), np.int64))  # list in hand: its shingle and part, its centres
        last = (None, None)
        for batch in gathered(batches):
            if not batch.num_rows:
                continue
            tok, part, meta, cls = (batch.column(k).to_numpy() for k in range(4))
            again = np.concatenate([[(int(tok[0]), int(cls[0])) == last], (tok[1:] == tok[:-1]) & (cls[1:] == cls[:-1])])
            last = int(tok[-1]), int(cls[-1])
            tok, part, meta, cls = (v[~again] for v in (tok, part, meta, cls))
            if not len(tok):
                continue
            old = held[1].shape[1] if held[0] == (int(tok[0]), int(part[0])) else 0
            if old:
                tok, part, meta, cls = (np.concatenate([h, v]) for h, v in zip(held[1], (tok, part, meta, cls), strict=True))
            start = _starts(tok, part)
            length = np.diff(np.append(start, len(tok)))
            of = np.repeat(np.arange(len(start)), length)
            first = start[of]
            k = np.arange(len(tok)) - first
            fresh = np.arange(len(tok)) >= old
            held = (int(tok[-1]), int(part[-1])), np.stack([v[first[-1] : first[-1] + 2] for v in (tok, part, meta, cls)])
            block = _starts(tok, part, meta)  # a position and size of one list
            wide = np.diff(np.append(block, len(tok)))
            ends = []
            for centre in (0, 1):
                # a block is asked once for all its entries; a list of one class has no second centre
                at = np.minimum(first[block] + centre, len(tok) - 1)
                rows = np.flatnonzero(np.repeat(_possible(meta[block], meta[at], threshold) & (length[of[block]] > centre), wide) & (k > centre) & fresh)
                ends.append(np.stack([cls[rows], cls[first[rows] + centre]]))
            a, b = np.concatenate(ends, axis=1)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            open_list = np.zeros(len(start), bool)  # may go on in the next batch, or has come from the last
            open_list[-1] = True
            open_list[0] |= bool(old)
            rest = fresh & ((part > 0) | ((k >= 2) & ((length >= 4) | open_list)[of]))
            top = ((part > 0) & (k < 2))[rest].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(tok[rest])]),
                    pa.array(np.concatenate([np.zeros(len(pairs), np.int64), top])),
                    pa.array(np.concatenate([pairs[:, 0], cls[rest]])),
                    pa.array(np.concatenate([pairs[:, 1], meta[rest]])),
                ],
                ["tok", "part", "a", "b"],
            )

    return run


def _dealt(placed: DataFrame, part: int, scratch: Scratch) -> DataFrame:
    """Entries ``(tok, i, j, block, meta, cls, component)`` of the lists that hold several components, once for each pair of blocks in which they have a partner to meet."""
    shares = placed.groupBy("tok", "component").agg(F.count("*").alias("k"))
    lists = shares.groupBy("tok").agg(F.sum("k").alias("n"), F.count("*").alias("components"), F.max(F.struct("k", "component")).alias("main")).where("components > 1")
    of = lambda n: F.ceil(n / part).cast("int")
    lists = lists.select("tok", "n", F.col("main.component").alias("main"), (F.col("n") <= part).alias("whole"), of(F.col("main.k")).alias("mains"), of(F.col("n") - F.col("main.k")).alias("others"))
    lists = scratch.save(lists, "lists", small=True)
    rows = spread_join(placed, lists.drop("n"), "tok", counts=lists.select("tok", F.col("n").alias("_n"))).where("main is not null")
    rows = rows.withColumn("own", F.xxhash64("cls")).withColumn("in_main", F.col("component") == F.col("main"))
    block = F.when(F.col("whole"), F.lit(0)).when(F.col("in_main"), F.pmod("own", "mains").cast("int")).otherwise(F.col("mains") + F.pmod("own", "others").cast("int"))
    rows = rows.withColumn("block", block)
    among_others = F.sequence(F.col("mains"), F.col("mains") + F.col("others") - 1)
    meets = F.when(F.col("whole"), F.array(F.lit(0))).when(F.col("in_main"), among_others).otherwise(F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1))
    rows = rows.withColumn("other", F.explode(meets))
    return rows.select("tok", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "meta", "cls", "component")


def _crossings(threshold, step: int = 1_000_000):
    """Second round over groups in order ``(tok, i, j, block, meta, cls, component)``: possible pairs of classes in different components, and their sizes."""
    mask = (1 << _POSITION) - 1

    def expanded(x: np.ndarray, y: np.ndarray, sx: np.ndarray, nx: np.ndarray, sy: np.ndarray, ny: np.ndarray):
        """Entries of pairs of blocks x, y that start at sx, sy and are nx, ny long."""
        size = nx[x] * ny[y]
        at = 0
        ends = np.cumsum(size)
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            n = size[at:to]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(ny[y[at:to]], n)
            yield np.repeat(sx[x[at:to]], n) + k // width, np.repeat(sy[y[at:to]], n) + k % width
            at = to

    def answers(i, j, block, meta, cls, component):
        if len(cls) < 2 or (component == component[0]).all():
            return
        sides = (0, len(cls)), (0, len(cls))
        if i != j:  # two blocks, one after the other
            cut = int(np.searchsorted(block, j))
            sides = (0, cut), (cut, len(cls))
        (sx, nx), (sy, ny) = ((lo + (s := _starts(meta[lo:hi])), np.diff(np.append(s, hi - lo))) for lo, hi in sides)
        if not (len(sx) and len(sy)):
            return
        rows = max(1, step // len(sy))
        for lo in range(0, len(sx), rows):
            x, y = np.nonzero(_possible(meta[sx[lo : lo + rows], None], meta[None, sy], threshold))
            x += lo
            if i == j:  # meets are symmetric
                x, y = x[x <= y], y[x <= y]
            for p, q in expanded(x, y, sx, nx, sy, ny):
                far = component[p] != component[q]
                if i == j:
                    far &= p < q
                p, q = p[far], q[far]
                swap = cls[p] > cls[q]
                p, q = np.where(swap, q, p), np.where(swap, p, q)
                yield np.stack([cls[p], cls[q], meta[p] & mask, meta[q] & mask], axis=1)

    def run(batches):
        held = None
        found: list[np.ndarray] = []

        names = ["a", "b", "na", "nb"]

        def told():
            pairs = np.concatenate(found)
            found.clear()
            return pa.table([pairs[:, k] for k in range(4)], names).group_by(names).aggregate([]).select(names).combine_chunks().to_batches()

        def group(columns):
            tok, i, j, *rest = columns
            yield from answers(int(i[0]), int(j[0]), *rest)

        for batch in gathered(batches):
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(7)]
            if held is not None:
                columns = [np.concatenate([h, v]) for h, v in zip(held, columns, strict=True)]
            start = np.append(_starts(*columns[:3]), len(columns[0]))
            for lo, hi in zip(start[:-2], start[1:-1], strict=True):
                found.extend(group([v[lo:hi] for v in columns]))
                if sum(map(len, found)) > step:
                    yield from told()
            held = [v[start[-2] :].copy() for v in columns]
            if found:
                yield from told()
        if held is not None:
            for part in group(held):
                found.append(part)
                if sum(map(len, found)) > step:
                    yield from told()
        if found:
            yield from told()

    return run


def _underived(crossing: DataFrame, links: DataFrame, answers: DataFrame, classes: DataFrame, threshold) -> DataFrame:
    """``crossing(a, b, na, nb)`` without the pairs that what is known of their models excludes.

    A class's model is the linked class that leaves the fewest of its shingles
    out. ``answers(a, b, most)`` tell what two sets share at most.
    """
    num, den = threshold
    size = classes.select("cls", "n")
    ends = links.select(F.col("a").alias("cls"), F.col("b").alias("model"), "both").unionByName(links.select(F.col("b").alias("cls"), F.col("a").alias("model"), "both"))
    beyond = ends.join(size, "cls").groupBy("cls").agg(F.min(F.struct((F.col("n") - F.col("both")).alias("beyond"), "model")).alias("m"))
    models = beyond.select("cls", "m.model", "m.beyond")
    rows = crossing
    for end in ("a", "b"):
        rows = rows.join(models.select(F.col("cls").alias(end), F.col("model").alias(f"model_{end}"), F.col("beyond").alias(f"beyond_{end}")), end, "left")
        rows = rows.withColumn(f"model_{end}", F.coalesce(f"model_{end}", end)).withColumn(f"beyond_{end}", F.coalesce(f"beyond_{end}", F.lit(0)))
    rows = rows.withColumn("x", F.least("model_a", "model_b")).withColumn("y", F.greatest("model_a", "model_b"))
    rows = rows.join(answers.select(F.col("a").alias("x"), F.col("b").alias("y"), "most"), ["x", "y"], "left")
    needed = F.ceil(num * (F.col("na") + F.col("nb")) / F.lit(num + den))
    out = rows.where(F.col("most").isNull() | (F.col("most") + F.col("beyond_a") + F.col("beyond_b") >= needed))
    return out.select("a", "b")


def _sets(docs: DataFrame, wanted, identity: Identity) -> DataFrame:
    """``(cls, members)`` of the documents whose ids pass the filter of those wanted; only their texts are read into sets."""

    def run(batches):
        hashes, some = WordHashes(), np.unpackbits(np.frombuffer(wanted.value, np.uint8))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out, part = {}, batch.slice(at, 512)
                ids = part.column(0)
                here = ids.is_null().to_numpy(zero_copy_only=False) | (some[ids.fill_null(0).to_numpy() & (FILTER - 1)] == 1)
                for text in as_bytes(part.column(1).filter(pa.array(here))):
                    s = shingle_set(text, hashes, WIDTH)
                    if len(s):
                        out[identity(s)] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["cls", "members"])

    return docs.mapInArrow(run, "cls bigint, members binary").dropDuplicates(["cls"])


def _filter(ids: DataFrame, scratch: Scratch) -> bytes:
    """One bit for each of :data:`FILTER` residues of the ids."""

    def run(batches):
        counts = np.zeros(FILTER, np.int64)
        for batch in batches:
            counts[np.unique(batch.column(0).to_numpy() & (FILTER - 1))] = 1
        if counts.any():
            yield slice_batch(counts)

    marked = summed(ids.mapInArrow(run, "slice int, item int, counts binary"), FILTER, scratch, "filter")
    return np.packbits(marked > 0).tobytes()


def _links(pairs: DataFrame, sets: DataFrame, threshold) -> DataFrame:
    """``(a, b, both, linked)``: the exact overlap of the pairs' sets."""
    num, den = threshold

    def run(batches):
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            told, keep = [], []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = _overlap(p, q)
                told.append(both)
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.int64()), pa.array(keep, pa.bool_())], ["a", "b", "both", "linked"])

    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint, both bigint, linked boolean")


def _overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int(np.count_nonzero(q[at] == p))


def _labelled(docs: DataFrame, scratch: Scratch, threshold, digest_bits: int = 64, longest: int = LIST, part: int = PART) -> tuple[DataFrame, Identity]:
    """``(doc_id, n, cls, root, label)`` of every row of ``docs(doc_id, text)``: its component by number, and by smallest id; how classes are told."""
    spark = docs.sparkSession
    survey = scratch.save(_survey(docs, digest_bits), "survey")
    counts = summed(survey.where("slice is not null"), SKETCH, scratch, "counts")
    sketch = spark.sparkContext.broadcast(counts.tobytes())
    rows = survey.where("slice is null").select("doc_id", "n", "cls", "other", "bits")
    shared = frozenset(r["cls"] for r in rows.where("cls is not null").groupBy("cls").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("cls").toLocalIterator())
    identity = Identity(digest_bits, shared)
    if shared:
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(*shared), F.col("other")).otherwise(F.col("cls")))
    classes = scratch.save(rows.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("rep")), "classes", small=True)

    met_schema = "tok bigint, part bigint, a bigint, b bigint"
    lists = _prefixes(docs, sketch, threshold, identity, longest).repartition("tok", "part").sortWithinPartitions("tok", "part", "meta", "cls")
    met = scratch.save(lists.mapInArrow(_centres(threshold), met_schema), "met")
    met_pairs = met.where("tok is null").select("a", "b")
    entries = met.where("tok is not null").select("tok", F.col("b").alias("meta"), F.col("a").alias("cls"))
    if counts.max() >= longest:
        tops = met.where("tok is not null and part = 1").select("tok", F.lit(0).cast("bigint").alias("part"), F.col("b").alias("meta"), F.col("a").alias("cls"))
        tops = tops.repartition("tok").sortWithinPartitions("tok", "part", "meta", "cls").mapInArrow(_centres(threshold), met_schema)
        met_pairs = met_pairs.unionByName(tops.where("tok is null").select("a", "b"))
    bounds = scratch.save(_bounded(met_pairs.distinct(), classes, threshold), "bounds", small=True)
    sets = _verify_sets(docs, bounds.where("open"), classes, scratch, "sets-1", identity)
    exact = scratch.save(_links(bounds.where("open"), sets, threshold), "exact", small=True)
    scratch.drop("sets-1")
    links = exact.where("linked")
    first = scratch.save(connected_components(links, scratch, "first"), "first", small=True)

    placed = entries.join(first.withColumnRenamed("node", "cls"), "cls", "left")
    placed = scratch.save(placed.select("tok", "meta", "cls", F.coalesce("component", "cls").alias("component")), "placed")
    dealt = _dealt(placed, part, scratch).repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j", "block", "meta", "cls")
    crossing = dealt.mapInArrow(_crossings(threshold), "a bigint, b bigint, na bigint, nb bigint").distinct()
    crossing = scratch.save(crossing.join(bounds, ["a", "b"], "left_anti"), "crossing", small=True)
    scratch.drop("met", "placed")
    found = first
    if not crossing.isEmpty():
        known = bounds.join(exact, ["a", "b"], "left").select("a", "b", F.coalesce("both", "most").alias("most"))
        doubtful = _underived(crossing, links, known, classes, threshold)
        doubtful = scratch.save(_bounded(doubtful, classes, threshold).where("open"), "doubtful", small=True)
        if not doubtful.isEmpty():
            sets = _verify_sets(docs, doubtful, classes, scratch, "sets-2", identity)
            more = scratch.save(_links(doubtful, sets, threshold).where("linked"), "more", small=True)
            scratch.drop("sets-2")
            if not more.isEmpty():
                edges = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))
                found = scratch.save(connected_components(edges, scratch, "second"), "found", small=True)

    reps = classes.select("cls", "rep")
    named = found.withColumnsRenamed({"node": "cls", "component": "root"}).join(reps, "cls")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    labels = spread_join(named, least, "root").select("cls", "root", "least")
    labels = reps.join(labels, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("label"))
    labels = scratch.save(labels, "labels", small=True)
    return spread_join(rows.select("doc_id", "n", "cls"), labels, "cls"), identity


def components(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, text: str = "text", key: str = "doc_id", **sizes) -> DataFrame:
    """``(key, n_shingles bigint, component_id bigint)`` for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = in_small_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows, _ = _labelled(docs, scratch, threshold, **sizes)
    out = rows.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("label")).alias("component_id"))
    return scratch.last(out)


def _verify_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, scratch: Scratch, name: str, identity: Identity) -> DataFrame:
    """Sets of the pairs' classes, from one document each (all those without id, if a class has no other)."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    named = ends.join(classes.select("cls", "rep"), "cls").where("rep is not null").select("rep")
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(named, scratch))
    return scratch.save(_sets(docs, wanted, identity), name)


def keep_first(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, text: str = "text", key: str = "doc_id", **sizes) -> DataFrame:
    """One row of each group of ``docs``, that of smallest id; all columns stay.

    Ids need not be unique: each row is judged by the group of its own text. Of a
    group's rows that share its smallest id, or have none, one stays, the first
    by the texts' and other columns' digest. Rows without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    some = in_small_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows, identity = _labelled(some, scratch, threshold, **sizes)
    rows = scratch.save(rows.where("cls is not null"), "rows")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 or doc_id is null").select("doc_id")
    if not repeated.count():
        gone = scratch.last(rows.where("doc_id <> label").select(F.col("doc_id").alias(key)), "gone")
        return anti(docs, gone, key)
    return _keep_first_of_repeated(docs, rows, repeated, identity, scratch, text, key)


def _keep_first_of_repeated(docs, rows, repeated, identity: Identity, scratch: Scratch, text: str, key: str) -> DataFrame:
    """:func:`keep_first` where ids repeat or are null: rows of such ids are told by their texts' classes."""
    odd = F.col("doc_id").eqNullSafe(F.col("odd"))
    repeated = scratch.save(repeated.select(F.col("doc_id").alias("odd")), "repeated")
    plain = rows.join(repeated, odd, "left_anti").where("label is null or doc_id <> label").select(F.col("doc_id").alias(key))
    # a group keeps one of its repeated rows only if its smallest id is such a one
    groups = rows.join(repeated, odd, "left_semi").where(F.col("doc_id").eqNullSafe(F.col("label"))).select("cls", "root").distinct()
    groups = scratch.save(groups, "groups")

    at, columns = docs.columns.index(text), [f"c{k}" for k in range(len(docs.columns))]

    def classed(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes, WIDTH) for t in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([identity(s) if len(s) else None for s in sets], pa.int64())], [*columns, "cls"])

    here = F.col(f"`{key}`").cast("bigint").eqNullSafe(F.col("odd"))
    mine = docs.join(repeated, here, "left_semi").toDF(*columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mine.schema)
    told = scratch.save(mine.mapInArrow(classed, f"{kinds}, cls bigint"), "told")
    wordless = told.where("cls is null").select(*columns)
    order = F.struct(F.col(f"c{docs.columns.index(key)}").isNull().alias("none"), F.col(f"c{docs.columns.index(key)}").alias("id"), F.xxhash64(*columns).alias("digest"), *columns)
    one = told.join(groups, "cls").groupBy("root").agg(F.min(order).alias("row")).select(*[F.col(f"row.{c}").alias(c) for c in columns])
    stay = wordless.unionByName(one).toDF(*docs.columns)
    rest = docs.join(repeated, here, "left_anti")
    return anti(rest, scratch.save(plain, "gone"), key).unionByName(stay)
