"""Changed files and functions of unified diffs, and ground truth made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_DEFINED = r"^[+ ]\s*(?:async\s+def|def|class)\s+([A-Za-z_]\w*)"
_HUNK = r"^@@[^@]*@@.*?(?:async\s+def|def|class)\s+([A-Za-z_]\w*)"


def parsed(patches: DataFrame, key: str = "issue_id", patch: str = "patch", suffix: str = ".py") -> DataFrame:
    """``(key, file, function)`` from diff lines; function is null in the row that names a changed file.

    The file of a line is the last ``+++ b/`` header at or before it. Functions
    come from hunk headers and from added or unchanged definitions, never from
    removed lines; other kinds of files are left out.
    """
    lines = patches.select(F.col(key), F.posexplode(F.split(patch, "\n")).alias("pos", "line"))
    header = F.regexp_extract("line", r"^\+\+\+ b/(.+)$", 1)
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("file", F.last(F.nullif(header, F.lit("")), ignorenulls=True).over(upto)).where(F.endswith("file", F.lit(suffix)))
    named = F.coalesce(F.nullif(F.regexp_extract("line", _HUNK, 1), F.lit("")), F.when(~F.startswith("line", F.lit("+++")), F.nullif(F.regexp_extract("line", _DEFINED, 1), F.lit(""))))
    files = rows.where(F.startswith("line", F.lit("+++ b/"))).select(key, "file", F.lit(None).cast("string").alias("function"))
    return files.unionByName(rows.select(key, "file", named.alias("function")).where("function is not null")).distinct()


def ground_truth(issues: DataFrame, key: str = "issue_id") -> DataFrame:
    """Issues with a patch of the wanted kind: text, sorted files and functions."""
    found = parsed(issues.where("coalesce(patch, '') <> ''"), key)
    files = found.groupBy(key).agg(F.array_sort(F.collect_set("file")).alias("changed_files"), F.array_sort(F.collect_set(F.when(F.col("function").isNotNull(), F.struct("file", "function")))).alias("changed_functions"))
    text = F.coalesce(F.nullif("problem_statement", F.lit("")), F.concat_ws("\n", F.col("title"), F.col("body")))
    return issues.join(files, key).select(key, text.alias("text"), "changed_files", "changed_functions")


def fixes(text: Column) -> Column:
    """Numbers of the issues that a text says it fixes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?)\s+#(\d+)"), F.lit(1))


def merged_changes(issues: DataFrame, timeline: DataFrame, pull_files: DataFrame, contains: str = "", suffix: str = ".py") -> DataFrame:
    """``(issue_number, pr_number, changed_files)``: closed issues, their first fixing merged pull request, its files of a kind."""
    real = issues.where("not is_pull_request and state = 'closed'").select("issue_number")
    fixing = timeline.where("merged").groupBy("issue_number").agg(F.min("pr_number").alias("pr_number"))
    files = pull_files.where(F.contains("file", F.lit(contains)) & F.endswith("file", F.lit(suffix)))
    files = files.groupBy("pr_number").agg(F.array_sort(F.collect_set("file")).alias("changed_files"))
    return real.join(fixing, "issue_number").join(files, "pr_number").select("issue_number", "pr_number", "changed_files")
