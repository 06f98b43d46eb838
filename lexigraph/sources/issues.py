"""An issue tracker's REST pages as Spark data sources.

``spark.dataSource.register(IssuePages)``, then
``spark.read.format("issue_pages").option("url", ...).option("pages", n).load()``:
one partition a page, read by the executors, retried while the server asks to
wait. ``issue_timelines``, ``pull_requests`` and ``pull_files`` read what belongs
to the ``numbers`` given, a few of them a partition; :func:`fixing_changes` joins
the four to the files that an issue's merged change touched.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.diffs import merged_changes


class _Part(InputPartition):
    def __init__(self, numbers: list[int]):
        self.numbers = numbers


class _Reader(DataSourceReader):
    """Rows of pages; ``each`` numbers are a partition."""

    each = 20

    def __init__(self, options):
        self.url, self.token, self.tries = options["url"].rstrip("/"), options.get("token"), int(options.get("tries", 5))
        self.numbers = [int(n) for n in (options.get("numbers") or "").split(",") if n.strip()]

    def partitions(self):
        return [_Part(self.numbers[at : at + self.each]) for at in range(0, len(self.numbers), self.each)] or [_Part([])]

    def get(self, path: str):
        """A page's JSON; None where there is none."""
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url + path, headers=headers), timeout=60) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code not in (403, 429) or k == self.tries - 1:
                    raise
                time.sleep(min(120, int(e.headers.get("Retry-After") or 2**k)))

    def pages(self, path: str):
        """Items of all pages of a list, to the first that isn't full."""
        joiner, page = "&" if "?" in path else "?", 1
        while found := self.get(f"{path}{joiner}per_page=100&page={page}"):
            yield from found
            if len(found) < 100:
                return
            page += 1


class _IssueReader(_Reader):
    def __init__(self, options):
        super().__init__(options)
        self.count = int(options.get("pages", 1))

    def partitions(self):
        return [_Part([k + 1]) for k in range(self.count)]

    def read(self, part: _Part):
        for page in part.numbers:
            for issue in self.get(f"/issues?state=closed&per_page=100&page={page}") or []:
                yield issue["number"], issue.get("title"), issue.get("body"), issue.get("state"), "pull_request" in issue


class _TimelineReader(_Reader):
    def read(self, part: _Part):
        for number in part.numbers:
            for at, event in enumerate(self.pages(f"/issues/{number}/timeline")):
                source = (event.get("source") or {}).get("issue") or {}
                if event.get("event") == "cross-referenced" and "pull_request" in source:
                    yield number, at, source["number"]


class _PullReader(_Reader):
    def read(self, part: _Part):
        for number in part.numbers:
            if pull := self.get(f"/pulls/{number}"):
                yield number, bool(pull.get("merged"))


class _PullFileReader(_Reader):
    def read(self, part: _Part):
        for number in part.numbers:
            for file in self.pages(f"/pulls/{number}/files"):
                yield number, file.get("filename", "")


def _source(title: str, columns: str, kind: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return title

        def schema(self):
            return columns

        def reader(self, schema):
            return kind(self.options)

    return Source


IssuePages = _source("issue_pages", "issue_number bigint, title string, body string, state string, is_pull_request boolean", _IssueReader)
IssueTimelines = _source("issue_timelines", "issue_number bigint, ordinal int, pr_number bigint", _TimelineReader)
PullRequests = _source("pull_requests", "pr_number bigint, merged boolean", _PullReader)
PullFiles = _source("pull_files", "pr_number bigint, file string", _PullFileReader)


def register(spark: SparkSession) -> None:
    for source in (IssuePages, IssueTimelines, PullRequests, PullFiles):
        spark.dataSource.register(source)


def fixing_changes(spark: SparkSession, url: str, pages: int = 5, holds: str = "", suffix: str = ".py", token: str | None = None) -> DataFrame:
    """``(issue_number, pr_number, changed_files)`` of closed issues, by the first merged change that refers to each.

    The numbers asked for are what a tracker's ``pages`` of 100 issues lead to,
    so they fit on the driver, which deals them to partitions.
    """
    register(spark)
    options = {"url": url} | ({"token": token} if token else {})
    read = lambda name, numbers: spark.read.format(name).options(**options).option("numbers", ",".join(map(str, sorted(set(numbers))))).load()
    issues = spark.read.format("issue_pages").options(**options).option("pages", pages).load().persist()
    lines = read("issue_timelines", [r[0] for r in issues.where("not is_pull_request").select("issue_number").collect()]).persist()
    pulls = read("pull_requests", [r[0] for r in lines.select("pr_number").collect()]).persist()
    fixing = lines.join(pulls.where("merged"), "pr_number").groupBy("issue_number").agg(F.min_by(F.struct("pr_number"), F.struct("ordinal", "pr_number")).alias("p")).select("issue_number", "p.pr_number").withColumn("merged", F.lit(True)).persist()
    files = read("pull_files", [r[0] for r in fixing.select("pr_number").collect()])
    return merged_changes(issues, fixing, files, holds, suffix)
