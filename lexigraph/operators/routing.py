"""Kinds of issues, and rankings fused by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words
from ..functions.text import subdomain
from .ranking import scaled_to_max, top


def classify(issues: DataFrame, text: Column, rules=words.ROUTER_RULES, ignore_case: bool = False, key: str = "issue_id") -> DataFrame:
    """``(key, category, confidence, scores)``: rule weights added up to 1 at most, first category of the largest sum.

    The text is lower-cased, so rules that ask for capitals never fire unless
    ``ignore_case`` is set.
    """
    low = F.lower(text)
    names = list(dict.fromkeys(c for c, _, _ in rules))
    score = {}
    for name in names:
        total = F.lit(0.0)
        for category, pattern, weight in rules:
            if category == name:
                total = total + F.when(low.rlike(("(?i)" if ignore_case else "") + pattern), weight).otherwise(0.0)
        score[name] = F.least(T.half_even(total, 6), F.lit(1.0))
    rows = issues.select(F.col(key), F.array(*[F.struct(F.lit(n).alias("category"), score[n].alias("score")) for n in names]).alias("scores"))
    rows = rows.withColumn("most", F.array_max(F.transform("scores", lambda s: s["score"])))
    first = F.get(F.filter("scores", lambda s: s["score"] == F.col("most")), F.lit(0))["category"]
    general, doubt = words.GENERAL
    return rows.select(
        key,
        F.when(F.col("most") > 0, first).otherwise(general).alias("category"),
        F.when(F.col("most") > 0, F.col("most")).otherwise(doubt).alias("confidence"),
        F.map_from_entries(F.filter("scores", lambda s: s["score"] > 0)).alias("scores"),
    )


def issue_types(issues: DataFrame, text: Column, types=None, key: str = "issue_id") -> DataFrame:
    """``(key, type)``: every type with a matching pattern, else ``other``."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in (types or words.ISSUE_TYPES).items()]))
    return issues.select(F.col(key), F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))).alias("type"))


def lexical_first(category: Column) -> Column:
    return category.isin(*words.LEXICAL_FIRST)


def focus(category: Column, file: Column, known=None) -> Column:
    """Whether a file lies in a directory that a category is about."""
    place = subdomain(file, known)
    out = F.lit(False)
    for name, places in words.FOCUS.items():
        out = F.when(category == name, place.isin(*places)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def weighted_fusion(graph: DataFrame, lexical: DataFrame, category: DataFrame | None = None, k: int = 10, alpha: float | None = None, bonus: float = 1.15, digits: int = 4, key: str = "issue_id") -> DataFrame:
    """Both rankings' scores over their largest, blended; alpha is the lexical share, by category unless given."""
    scaled = lambda df, name: df.select(key, "file_path", scaled_to_max("score", [key]).alias(name))
    both = scaled(graph, "g").join(scaled(lexical, "l"), [key, "file_path"], "full").na.fill(0.0, ["g", "l"])
    share, raised = F.lit(alpha if alpha is not None else 0.4), F.lit(1.0)
    if category is not None:
        both = both.join(category.select(key, "category"), key, "left")
        share = F.when(lexical_first(F.col("category")), 0.85).otherwise(0.40) if alpha is None else share
        raised = F.when(focus(F.col("category"), F.col("file_path")), bonus).otherwise(1.0)
    rows = both.select(key, "file_path", T.half_even((share * F.col("l") + (1 - share) * F.col("g")) * raised, digits).alias("score"))
    return top(rows, [key], [F.desc("score"), "file_path"], k)


def reciprocal_rank_fusion(graph: DataFrame, lexical: DataFrame, alpha: float = 0.6, k: int = 10, c: int = 60, missing: int = 50, key: str = "issue_id", category: DataFrame | None = None, bonus: float = 1.10) -> DataFrame:
    """alpha / (c + lexical rank) + (1 - alpha) / (c + graph rank); a file missing from one side ranks ``missing`` there.

    With ``category(key, category)`` alpha is the category's, and files in the
    directories that the category is about are raised by ``bonus``.
    """
    share, raised = F.lit(alpha), F.lit(1.0)
    both = graph.select(key, "file_path", F.col("rank").alias("g")).join(lexical.select(key, "file_path", F.col("rank").alias("l")), [key, "file_path"], "full").na.fill(missing, ["g", "l"])
    if category is not None:
        both = both.join(category.select(key, "category"), key, "left")
        by_name = F.create_map(*[F.lit(x) for kv in words.CATEGORY_ALPHA.items() for x in kv])
        share = F.coalesce(F.try_element_at(by_name, F.col("category")), F.lit(0.5))
        raised = F.when(focus(F.col("category"), F.col("file_path")), bonus).otherwise(1.0)
    rows = both.select(key, "file_path", T.half_even((share / (c + F.col("l")) + (1 - share) / (c + F.col("g"))) * raised, 8).alias("score"))
    return top(rows, [key], [F.desc("score"), "file_path"], k)
