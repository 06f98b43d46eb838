"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a target in words; a document's expected copies are its
source's target over its source's size. Whole copies are certain. The fractions
are rounded dependently: two documents meet, words' worth of probability moves
from one to the other, in a random direction that keeps both expectations,
until one fraction is 0 or 1; the other goes on to meet the next. Each move
keeps the expected words of the pair, so a source's taken words differ from its
target by less than the one document whose fraction is left at the end.

Documents are dealt to bounded groups by a hash; each group is rounded in one
array fold and hands on its one open document. The open documents of a source
are dealt anew, a tree of constant fan-in, until each source has one, which is
rounded by itself. Random numbers are hashes of ids and seed: reruns agree. Rows
that agree in id, source and size are numbered apart, so that any number of them
is dealt to as many groups as other rows.

Sources may be many (hosts): their order comes from a range-partitioned sort, and
the water level of their targets from sums, round by round; neither gathers them.

Defined cases: a null text has size 0; texts are read whole; documents of size 0
take 0 words; a null source is a source of its own, last in order; repeated rows
are documents of their own, as are rows with a null id; other columns stay as
they are in :func:`repeat`, whatever their names, and are ignored elsewhere; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)
#: Words taken, over words there are.
SHARE = 1.5
#: Copies of a source at most.
CAP = 2.0
#: Documents a group holds on average.
FAN_IN = 128


def _in_order(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with ``place``, their number from 0 by code point, null last; no task sees more than a range of them."""
    placed = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id())
    placed = scratch.save(placed, "sources", small=True).withColumn("range", F.shiftright("id", 33))
    # one row a range of the sort, so as many as shuffle partitions at most
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy("range").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
    placed = placed.join(F.broadcast(before.select("range", "before")), "range")
    return placed.withColumn("place", F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).drop("id", "range", "before")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code point order, null last, weigh ``weights`` in turn. What a
    capped source can't take is shared again by weight until none is above its
    cap: that is the water level at which sum(min(level * weight, cap * size)) is
    all words to take. Each round is one aggregate; sums of sizes and of weights
    are whole numbers, so every run finds the same level.
    """
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = scratch.save(_in_order(sources, scratch).withColumn("weight", turn), "ranked", small=True)
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("source_size") * cap <= F.col("weight") * level
        taken, weight = ranked.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            level = None  # every source gives all it may
            break
        after = (total - cap * (taken or 0)) / weight
        if after <= level:
            break
        level = after
    most = F.col("source_size") * cap
    target = most if level is None else F.least(most, F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def _round(group: Column, seed: int) -> Column:
    """Fold a non-empty sorted array of documents: ``done`` have whole copies, ``open`` is left."""
    first = F.element_at(group, 1)
    rest = F.slice(group, 2, F.greatest(F.size(group) - 1, F.lit(0)))
    start = F.struct(F.slice(group, 1, 0).alias("done"), first.alias("open"))

    def meet(state: Column, new: Column) -> Column:
        old = state["open"]
        # words of probability that may move to the old one, and to the new one
        to_old = F.least((1.0 - old["p"]) * old["size"], new["p"] * new["size"])
        to_new = F.least(old["p"] * old["size"], (1.0 - new["p"]) * new["size"])
        u = _uniform(old["tag"], new["tag"], F.lit(seed))
        forward = u * (to_old + to_new) < to_new
        # whichever limit was met makes that document's fraction exactly 0 or 1
        old_p = F.when(forward, F.when(to_old == (1.0 - old["p"]) * old["size"], 1.0).otherwise(old["p"] + to_old / old["size"])).otherwise(
            F.when(to_new == old["p"] * old["size"], 0.0).otherwise(old["p"] - to_new / old["size"])
        )
        new_p = F.when(forward, F.when(to_old == new["p"] * new["size"], 0.0).otherwise(new["p"] - to_old / new["size"])).otherwise(
            F.when(to_new == (1.0 - new["p"]) * new["size"], 1.0).otherwise(new["p"] + to_new / new["size"])
        )
        a, b = old.withField("p", old_p), new.withField("p", new_p)
        settled = (old_p == 0.0) | (old_p == 1.0)
        return F.struct(F.array_append(state["done"], F.when(settled, a).otherwise(b)).alias("done"), F.when(settled, b).otherwise(a).alias("open"))

    return F.aggregate(rest, start, meet)


def _groups(level: int, fan_in: int) -> Column:
    """So many groups that each holds ``fan_in`` on average."""
    return F.ceil(F.col("n") / F.lit(float(fan_in) ** level))


def _group(level: int, seed: int, fan_in: int) -> Column:
    return F.pmod(F.xxhash64("d.tag", F.lit(seed + level)), _groups(level, fan_in))


def _documents(folded: DataFrame, column: str, names: list[str]) -> DataFrame:
    return folded.select(F.explode(column).alias("d")).select(*[f"d.{c}" for c in names])


def _numbered(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """``sized`` with ``nth``, which tells apart rows that agree in id, source and size.

    Rows are counted in each part of the saved table, and the parts' counts are
    added up, so a row that stands there a billion times is numbered by as many
    tasks as hold it.
    """
    alike = ["doc_id", "source", "size"]
    again = sized.groupBy(*alike).agg(F.count("*").alias("times")).where("times > 1").select(*[F.col(c).alias(f"again_{c}") for c in alike])
    again = scratch.save(again, "again", small=True)
    if again.isEmpty():
        return sized.withColumn("nth", F.lit(0).cast("bigint"))
    is_again = [F.col(c).eqNullSafe(F.col(f"again_{c}")) for c in alike]
    alone = sized.join(again, is_again, "left_anti").withColumn("nth", F.lit(0).cast("bigint"))
    many = sized.join(again, is_again, "left_semi").withColumn("part", F.shiftright("row", 33))
    local = many.withColumn("local", F.row_number().over(W.partitionBy(*alike, "part").orderBy("row")))
    ahead = W.partitionBy(*alike).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = many.groupBy(*alike, "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"again_{c}") for c in alike], F.col("part").alias("of"), "before")
    many = local.join(before, [*is_again, F.col("part") == F.col("of")]).withColumn("nth", F.col("before") + F.col("local"))
    return alone.unionByName(many.select(*alone.columns))


def mix(sized: DataFrame, scratch: Scratch, seed: int = 1, fan_in: int = FAN_IN, **weights) -> DataFrame:
    """``(row, doc_id, source, size, source_size, target, copies)`` for every row of the saved ``(row, doc_id, source, size)``; ``row`` is a monotonically increasing id."""
    sizes = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), "sizes", small=True)
    goal = targets(sizes.select("source", "source_size"), scratch, **weights).withColumnRenamed("source", "s")
    count = sizes.select(F.col("source").alias("c"), "source_rows")
    goal = goal.join(count, F.col("s").eqNullSafe(F.col("c"))).drop("c")
    rows = _numbered(sized, scratch).join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    # ties in size are broken by a hash, so that runs of like documents are dealt evenly
    rows = rows.withColumn("tag", F.xxhash64("doc_id", "size", "nth", F.lit(seed)))
    settled = rows.where("size = 0 or p = 0").withColumn("p", F.lit(0.0))
    kept = ["row", "doc_id", "source", "size", "source_size", "target", "whole", "p", "tag", "source_rows"]
    item = F.struct(F.negative("size").alias("order"), "tag", *[c for c in kept if c != "tag"])
    done = [settled.select(*kept)]
    now = rows.where("size > 0 and p > 0").select(item.alias("d"), F.col("source").alias("s"), F.col("source_rows").alias("n"))
    now = now.withColumn("g", _group(1, seed, fan_in))
    # one group of each source waits for the end, when its many small documents absorb what the last large ones leave open
    waiting = now.where("g = 0").select("d", "s")
    now, level = now.where("g > 0"), 1
    while True:
        dealt = now.groupBy("s", "g").agg(F.sort_array(F.collect_list("d")).alias("ds"), F.first("n").alias("n"))
        folded = scratch.save(dealt.select("s", "n", _round(F.col("ds"), seed + level).alias("r")), f"mix-{level}", small=True)
        done.append(_documents(folded, "r.done", kept))
        level += 1
        widest = folded.agg(F.max(_groups(level, fan_in))).first()[0]
        now = folded.select(F.col("r.open").alias("d"), "s", "n").withColumn("g", _group(level, seed, fan_in))
        if widest is None or widest <= 1:
            break
    ending = now.select("d", "s").unionByName(waiting).groupBy("s").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    folded = scratch.save(ending.select(_round(F.col("ds"), seed).alias("r")), "mix-end", small=True)
    done.append(_documents(folded, "r.done", kept))
    now = folded.select(F.col("r.open").alias("d"))
    last = now.select(*[f"d.{c}" for c in kept]).withColumn("p", (_uniform("tag", F.lit(seed)) < F.col("p")).cast("double"))
    out = last
    for part in done:
        out = out.unionByName(part)
    return out.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("bigint").alias("copies"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col(text)).alias("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """:func:`mix` of documents by the number of words in ``text``; texts are read once."""
    scratch = Scratch(docs.sparkSession, "mix")
    out = mix(scratch.save(_sized(docs), "sized"), scratch, **options)
    return scratch.last(out.drop("row"))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, row by row, whatever ids repeat.

    The rows are written once with a number, which their copies are joined by.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    names = [f"c{k}" for k in range(len(docs.columns))]
    held = docs.toDF(*names).withColumn("row", F.monotonically_increasing_id())
    held = scratch.save(held, "held")
    named = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text")}
    sized = scratch.save(held.select("row", named["doc_id"].alias("doc_id"), named["source"].alias("source"), word_count(named["text"]).alias("size")), "sized")
    taken = mix(sized, scratch, **options).where("copies > 0").select("row", "copies")
    rows = held.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*names).toDF(*docs.columns)
