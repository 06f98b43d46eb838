"""Language of web pages by Bayesian fusion of several kinds of evidence.

* Text: byte-trigram likelihoods of the visible text, learned from labelled
  documents. Trigrams overlap, so their log-likelihood counts at
  :data:`TEMPER` per trigram, at most :data:`TRUST` trigrams' worth.
* Markup: the language that ``<html lang>`` declares, through the chance of each
  declaration given each language, learned by grouped aggregation.
* Address: a prior for the host from the other pages of the host, smoothed by
  its registered domain, that by its address suffix, that by all pages:
  (count + K * parent) / (total + K) at each level. Counts are sums of the
  pages' text posteriors, and a page's own share is taken out of its prior.

Sums are combined before their shuffle, and the pages of a host that holds more
than a thousandth of all stay where they are when its sums come back to them, so
a host with a third of all pages is no task of its own.

Defined cases: a page with null or empty markup has no text and no declaration
and takes its host's prior; a null or odd address has host, domain and suffix
''; repeated rows count each; no labelled documents give a null language;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, in_small_batches, spread_join

#: Labelled documents that the trigram model is fitted on, at most.
SAMPLE = 20_000
GRAMS = 1 << 16
TEMPER, TRUST = 0.25, 400
#: Pages' worth of belief that each level takes from the level above.
K = 4.0

_DROP = re.compile(r"<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\".*?</div>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible(page: str | None) -> str:
    return entities.unescape(_TAG.sub(" ", _DROP.sub(" ", page))) if page else ""


def declared(page: str | None) -> str:
    """Language of the first ``<html>`` tag that names one, wherever it stands; each character is read at most twice."""
    for tag in _HTML.finditer(page or ""):
        if found := _LANG.search(tag[0], 5):
            return found[1].lower()
    return ""


def grams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text."""
    a = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    return (((a[:-2] * 65599 + a[1:-1]) * 65599 + a[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of every trigram in each (languages x :data:`GRAMS`)."""
    chosen = docs.where("lang is not null and lang <> '' and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where("lang is not null and lang <> ''").select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                total = counts.setdefault(lang, np.zeros(GRAMS, np.int64))
                np.add.at(total, grams(text or b""), 1)
        for lang, total in counts.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(total[seen])], ["lang", "gram", "n"])

    # bounded by the sample: a gram of a language is a row, added up before and after the shuffle
    sums = in_small_batches(rows).mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model: dict[str, np.ndarray] = {r["lang"]: np.zeros(GRAMS, np.int64) for r in rows.select("lang").distinct().collect()}
    told = sums.toPandas()
    for lang, some in told.groupby("lang"):
        model[lang][some["gram"].to_numpy()] = some["n"].to_numpy()
    langs = sorted(model)
    table = np.stack([np.log((model[x] + 0.5) / (model[x].sum() + 0.5 * GRAMS)) for x in langs]) if langs else np.zeros((0, GRAMS))
    return langs, table


def _host(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"\.$", "")


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """Per page its address levels, declaration, and tempered text log-likelihoods."""
    shared = pages.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(batches):
        for batch in batches:
            said, marks = [], []
            for page in batch.column(2).to_pylist():
                marks.append(declared(page))
                g = grams(visible(page).encode())
                ll = shared.value[:, g].sum(1, dtype=np.float64) * TEMPER if len(g) else np.zeros(len(langs))
                said.append(ll * min(1.0, TRUST / max(1, len(g))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.string()), pa.array(said, pa.list_(pa.float64()))], ["page_id", "host", "declared", "ll"])

    out = in_small_batches(pages).select("page_id", _host(F.col("url")).alias("host"), "html").mapInArrow(run, "page_id bigint, host string, declared string, ll array<double>")
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host"))
    return out.withColumn("domain", domain).withColumn("suffix", F.element_at(labels, -1))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def identify(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``(page_id, lang, confidence, text_lang, declared, host)`` for every page."""
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("declared"), _host(F.col("url")).alias("host"))
    scratch = Scratch(pages.sparkSession, "language")
    rows = evidence(pages, langs, table).withColumn("p", _softmax(F.col("ll")))
    rows = scratch.save(rows, "evidence")
    each = range(len(langs))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in each]

    def counted(*by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[i]) for i in each]).alias(f"{by[0]}_sum"))

    total = rows.agg(*sums).first()
    overall = F.array(*[F.lit(float(total[i] or 0.0)) for i in each])
    hosts = counted("host", "domain", "suffix").join(counted("domain", "suffix"), ["domain", "suffix"]).join(counted("suffix"), "suffix")
    hosts = scratch.save(hosts.select("host", "host_sum", "domain_sum", "suffix_sum"), "hosts")
    # a declaration is two or three letters or none, so there are at most 26 ** 2 + 26 ** 3 + 1
    joined = spread_join(rows, hosts, "host").join(F.broadcast(counted("declared")), "declared")

    def smoothed(parent: Column, sums: Column) -> Column:
        """(count + K parent) / (total + K), without the page's own share."""
        less = F.zip_with(sums, F.col("p"), lambda s, p: F.greatest(s - p, F.lit(0.0)))
        whole = F.aggregate(less, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(less, parent, lambda s, q: (s + K * q) / (whole + K))

    even = F.array(*[F.lit(1.0 / len(langs))] * len(langs))
    prior = even
    for sums_at in (overall, F.col("suffix_sum"), F.col("domain_sum"), F.col("host_sum")):
        joined = joined.withColumn("prior", smoothed(prior, sums_at))
        prior = F.col("prior")
    # chance of the declaration given the language: its share of that language's pages; as a factor over all pages
    given = F.zip_with(F.zip_with("declared_sum", F.col("p"), lambda s, p: F.greatest(s - p, F.lit(0.0))), overall, lambda s, t: (s + 0.1) / (t + 1.0))
    fused = F.zip_with(F.zip_with("ll", "prior", lambda x, p: x + F.log(p)), F.transform(given, lambda g: F.log(g)), lambda x, g: x + g)
    posterior = _softmax(fused)
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    joined = joined.withColumn("posterior", posterior)
    return joined.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), best(F.col("p")).alias("text_lang"), "declared", "host")
