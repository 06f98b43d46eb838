"""Hit rate at k and mean reciprocal rank, overall and by group."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Passages that are sent to every task at once.
PASSAGES = 50_000


def first_hits(predictions: DataFrame, truth: DataFrame, key: str = "issue_id", item: str = "file_path", suffix: bool = False, roots: tuple[str, ...] = ()) -> DataFrame:
    """``(key, rank)`` of the first prediction that is right, null if none, for every key of ``truth``.

    With ``suffix`` a path also matches one that it ends with, or that ends with
    it; such pairs share their last segment, which is what they are joined on.
    Paths on both sides lose what stands up to one of ``roots`` before they meet.
    """
    if roots:
        predictions, truth = (df.withColumn(item, T.normal_path(F.col(item), list(roots))) for df in (predictions, truth))
    told, right = predictions.select(key, F.col(item).alias("p"), "rank"), truth.select(key, F.col(item).alias("t"))
    if suffix:
        last = lambda c: F.element_at(F.split(c, "/"), -1)
        joined = told.withColumn("last", last(F.col("p"))).join(right.withColumn("last", last(F.col("t"))), [key, "last"]).where(F.endswith("p", F.col("t")) | F.endswith(F.col("t"), F.col("p")))
    else:
        joined = told.join(right.withColumnRenamed("t", "p"), [key, "p"])
    return truth.select(key).distinct().join(joined.groupBy(key).agg(F.min("rank").alias("rank")), key, "left")


def first_function_hits(predictions: DataFrame, truth: DataFrame, key: str = "issue_id") -> DataFrame:
    """``(key, rank)`` of the first file, matched by suffix, one of whose ``top_functions`` is the right one, for every key with a function in ``truth``.

    ``truth`` is ``(key, file_path, function)``; a file without functions counts
    as a rank but never as right.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    right = truth.where("coalesce(file_path, '') <> '' and coalesce(function, '') <> ''").select(key, F.col("file_path").alias("t"), "function", last(F.col("file_path")).alias("last"))
    told = predictions.select(key, "rank", F.col("file_path").alias("p"), last(F.col("file_path")).alias("last"), F.explode(F.transform("top_functions", lambda f: f["name"])).alias("function"))
    joined = told.join(right, [key, "last", "function"]).where(F.endswith("p", F.col("t")) | F.endswith(F.col("t"), F.col("p")))
    return right.select(key).distinct().join(joined.groupBy(key).agg(F.min("rank").alias("rank")), key, "left")


def holding(docs: DataFrame, passages: DataFrame, key: str = "item_id", item: str = "doc_id", width: int = 4) -> DataFrame:
    """``(key, item)``: documents whose text has a passage's whole ``text`` in it.

    Inner words of a passage are whole words of every text that has it, so its
    first ``width`` of them are looked up at each position of the documents where
    the first stands, and whole passages are compared on what meets. Passages of
    fewer words are compared with every document. All passages are sent to every
    task; those above :data:`PASSAGES` go in turns.
    """
    asked = passages.where("text is not null").select(F.col(key).alias("k"), "text").toArrow()
    kind, of = passages.schema[key].dataType.simpleString(), docs.schema[item].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` {of}"
    parts = [_holding(docs.select(item, "text"), asked.slice(at, PASSAGES), schema, width) for at in range(0, asked.num_rows, PASSAGES)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _holding(docs: DataFrame, asked: pa.Table, schema: str, width: int) -> DataFrame:
    """The rows of :func:`holding` for some passages ``(k, text)``."""
    short, starts, firsts = [], {}, set()
    for n, passage in enumerate(asked["text"].to_pylist()):
        words = passage.split(" ")
        if len(words) < width + 2:
            short.append((n, passage))
        else:
            starts.setdefault(tuple(words[1 : width + 1]), []).append((n, passage))
            firsts.add(words[1])
    shared = docs.sparkSession.sparkContext.broadcast((short, starts, firsts, asked["k"].combine_chunks()))

    def find(batches):
        short, starts, firsts, keys = shared.value
        for batch in batches:
            row, held = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                words, near = text.split(" "), list(short)
                if not firsts.isdisjoint(words):
                    for run in {tuple(words[i : i + width]) for i, w in enumerate(words) if w in firsts}:
                        near += starts.get(run, ())
                mine = [n for n, passage in near if passage in text]
                held += mine
                row += [at] * len(mine)
            if row:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(held)), batch.column(0).take(pa.array(row))], ["k", "d"])

    return docs.mapInArrow(find, schema)


def summary(hits: DataFrame, k: int = 10, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """``n, hit_rate, mrr, top1`` per group; with ``rollup`` also over all."""
    good = (F.col("rank") <= k) & F.col("rank").isNotNull()
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    groups = (hits.rollup(*by) if rollup else hits.groupBy(*by)) if by else hits.groupBy()
    return groups.agg(F.count("*").alias("n"), rate(good).alias("hit_rate"), F.round(F.avg(F.when(good, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"), rate(good & (F.col("rank") == 1)).alias("top1"))


def compared(ours: DataFrame, theirs: DataFrame, by: DataFrame, k: int = 10, key: str = "issue_id", group: str = "type") -> DataFrame:
    """Per group, hits of two methods and how often each is better."""
    rows = by.join(ours.select(key, F.col("rank").alias("a")), key).join(theirs.select(key, F.col("rank").alias("b")), key)
    rank = lambda c: F.coalesce(F.when(F.col(c) <= k, F.col(c)), F.lit(k + 1))
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return rows.groupBy(group).agg(F.count("*").alias("n"), count(rank("a") <= k, "hits_a"), count(rank("b") <= k, "hits_b"), count(rank("a") == 1, "top1_a"), count(rank("b") == 1, "top1_b"), count(rank("a") < rank("b"), "better_a"), count(rank("b") < rank("a"), "better_b"))
