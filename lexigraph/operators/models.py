"""Calls to language and embedding models, and the caches around them.

A provider is a plain class with one method on lists of texts. It is built once
per task and sees Arrow batches. The defaults are offline stand-ins: the same
text gives the same answer everywhere. Answers are remembered in a table keyed
by the text's hash; only misses are asked.
"""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.cache import CacheTable
from ..sources.lineage import cut
from .graph import impact, shortest_paths, undirected
from .ranking import classes, few, top

log = logging.getLogger(__name__)


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Writer(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class HashedEmbedder:
    """Unit vectors of signed hashes of a text's words."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().replace("_", " ").split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                row[h % self.width] += 1 if h >> 40 & 1 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class TemplateWriter:
    """Answers that repeat the prompt's last line, or judge by shared words."""

    def answer(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            last = prompt.strip().splitlines()[-1] if prompt.strip() else ""
            if last.startswith("SAME?"):
                a, _, b = last.removeprefix("SAME?").partition("|")
                shared = set(a.lower().replace("_", " ").split()) & set(b.lower().replace("_", " ").split())
                out.append(f"YES\nshares {', '.join(sorted(shared))}" if shared else "NO\nnothing shared")
            else:
                out.append(last)
        return out


class RateLimit:
    """Token bucket; a task's share is the whole rate over the number of tasks."""

    def __init__(self, rate: float, burst: int = 1):
        self.rate, self.burst, self.have, self.at = rate, burst, float(burst), time.monotonic()

    def take(self) -> None:
        now = time.monotonic()
        self.have = min(self.burst, self.have + (now - self.at) * self.rate)
        self.at = now
        if self.have < 1:
            time.sleep((1 - self.have) / self.rate)
            self.have, self.at = 1.0, time.monotonic()
        self.have -= 1


def retried(call: Callable, tries: int = 3, wait: float = 1.0):
    """A call repeated with doubling waits."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


def embedded(texts: DataFrame, make: Callable[[], Embedder] = HashedEmbedder, text: str = "text", batch: int = 64) -> DataFrame:
    """``texts`` with a column ``emb``."""

    def run(batches):
        model = make()
        for rows in batches:
            said = [t or "" for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
            found = [v for at in range(0, len(said), batch) for v in retried(lambda at=at: model.embed(said[at : at + batch]))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.list_(pa.float64()))], [*rows.schema.names, "emb"])

    return texts.mapInArrow(run, _with(texts, "emb array<double>"))


def answered(prompts: DataFrame, make: Callable[[], Writer] = TemplateWriter, prompt: str = "prompt", rate: float | None = None, tasks: int = 1, batch: int = 16) -> DataFrame:
    """``prompts`` with a column ``answer``. A model is asked ``batch`` prompts at a time; calls that keep failing give empty answers and a line in the task's log."""

    def run(batches):
        model, limit = make(), RateLimit(rate / tasks, batch) if rate else None
        for rows in batches:
            said, found = [p or "" for p in rows.column(rows.schema.get_field_index(prompt)).to_pylist()], []
            for at in range(0, len(said), batch):
                some = said[at : at + batch]
                for _ in some if limit else ():
                    limit.take()
                try:
                    found += retried(lambda some=some: model.answer(some))
                except Exception as e:
                    log.warning("%d prompts without an answer: %s", len(some), e)
                    found += [""] * len(some)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], [*rows.schema.names, "answer"])

    return prompts.mapInArrow(run, _with(prompts, "answer string"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def through_cache(prompts: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame] = answered, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """(``prompts`` with answers, rows to add to the cache). The cache is ``(key, answer)``; each new prompt is asked once, and only answers that are not empty are kept.

    New answers are written by ``keep`` before either result is read, so using
    both asks nobody twice. A key that the cache holds twice has its smallest answer.
    """
    keyed = prompts.withColumn("key", T.cache_key(F.col("prompt")))
    said = cache.groupBy("key").agg(F.min("answer").alias("answer"))
    misses = keyed.select("key", "prompt").join(said.hint("merge"), "key", "left_anti").groupBy("key").agg(F.first("prompt").alias("prompt"))
    fresh = keep(ask(misses).where("answer <> ''").select("key", "answer"))
    # as many answers as prompts, which estimates from small inputs would have broadcast
    out = keyed.join(said.unionByName(fresh).hint("merge"), "key", "left")
    return out.drop("key"), fresh


def remembered(prompts: DataFrame, cache: CacheTable | None = None, ask: Callable[[DataFrame], DataFrame] = answered, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``prompts`` with answers; new ones are added to ``cache``, where given."""
    known = cache.read() if cache else prompts.sparkSession.createDataFrame([], "key string, answer string")
    out, fresh = through_cache(prompts, known, ask, keep)
    if cache:
        cache.add(fresh)
    return out


def remembered_vectors(texts: DataFrame, cache: CacheTable | None, make: Callable[[], Embedder] = HashedEmbedder, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``texts`` with a column ``emb``, of which ``cache`` (key, emb) gives what it has; each new text is embedded once and added."""
    if cache is None:
        return embedded(texts, make)
    keyed = texts.withColumn("key", T.cache_key(F.coalesce("text", F.lit(""))))
    known = cache.read().groupBy("key").agg(F.min("emb").alias("emb"))
    misses = keyed.select("key", "text").join(known.hint("merge"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    fresh = keep(embedded(misses, make).select("key", "emb"))
    cache.add(fresh)
    return keyed.join(known.unionByName(fresh).hint("merge"), "key", "left").drop("key")


DEFINE = "Say in one sentence what the name means in its domain, not what the code does.\nName: {name}\nIdentifier: {raw}\nFile: {file}, line {line}\nClass: {cls}\nFunction: {fn}\nBlock: {block}\nCode:\n{code}\nThe {kind} {raw}"
JUDGE = "Do the two names mean the same?\n{a}: {a_def} ({a_raw})\n{b}: {b_def} ({b_raw})\nSAME? {a} | {b}"


def definition_prompts(occurrences: DataFrame) -> DataFrame:
    """Occurrences with the question of what each means; missing parts read ``(none)``."""
    given = {"name": "split_name", "raw": "raw_identifier", "file": "file_path", "line": "line_number", "cls": "class_name", "fn": "function_name", "block": "block_type", "code": "code_snippet"}
    fields = {part: F.col(c) if c in occurrences.columns else F.lit(None).cast("string") for part, c in given.items()}
    return occurrences.withColumn("prompt", T.prompt(DEFINE, kind=F.replace(F.col("identifier_type"), F.lit("_"), F.lit(" ")), **fields))


def judge_prompts(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Pairs ``(i, j, a, b)`` by name, with the question of whether they mean the same."""
    info = concepts.select("canonical_name", "definition", F.array_join(F.slice("all_raw_identifiers", 1, 5), ", ").alias("raws"))
    out = pairs.join(info.select(F.col("canonical_name").alias("a"), F.col("definition").alias("a_def"), F.col("raws").alias("a_raw")), "a", "left").join(info.select(F.col("canonical_name").alias("b"), F.col("definition").alias("b_def"), F.col("raws").alias("b_raw")), "b", "left")
    return out.withColumn("prompt", T.prompt(JUDGE, **{c: F.col(c) for c in ("a", "b", "a_def", "b_def", "a_raw", "b_raw")}))


def verdicts(answers: DataFrame) -> DataFrame:
    return answers.select("i", "j", T.says_yes(F.col("answer")).alias("yes"), T.reason_of(F.col("answer")).alias("reason"))


RANK = "Which of these files must change for the issue? Answer with a JSON array of paths, most likely first.\nIssue:\n{issue}\nFiles:\n{files}\nPaths:"
EXPLAIN = "Sum up in under 300 words which concepts of the issue were found, which files most likely change and why, and any indirect path worth knowing. Name files and concepts.\n{report}"
CARD = "Describe the module as JSON with the fields responsibility, layer and key_concepts.\nFile: {file}\nDefines: {symbols}\nImports: {imports}\nJSON:"


def ranking_prompts(issues: DataFrame, files: DataFrame, most: int = 6000, key: str = "issue_id") -> DataFrame:
    """``(key, prompt)`` that ask a model alone to rank files: the baseline without a graph. The listing of ``files(file_path)`` stands whole in every prompt, so it is one row."""
    listing = files.select("file_path").distinct().agg(F.array_join(F.array_sort(F.collect_list("file_path")), "\n").alias("files"))
    return issues.crossJoin(listing).select(key, T.prompt(RANK, issue=F.substring("text", 1, most), files=F.col("files")).alias("prompt"))


def ranked_answers(answers: DataFrame, k: int = 10, key: str = "issue_id") -> DataFrame:
    """``(key, rank, file_path)``: the first ``k`` paths of each answer."""
    found = answers.select(key, F.posexplode(F.slice(T.listed_paths(F.col("answer")), 1, k)).alias("at", "file_path"))
    return found.select(key, (F.col("at") + 1).alias("rank"), "file_path")


def told(explanations: DataFrame, ask: Callable[[DataFrame], DataFrame] = answered, key: str = "issue_id") -> DataFrame:
    """``(key, summary)`` of each issue's explanations by a model; the explanations themselves where it has no answer."""
    line = F.struct("file_path", F.concat_ws("\n", F.concat(F.lit("file: "), "file_path"), "explanation").alias("t"))
    report = explanations.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n\n").alias("report"))
    said = ask(report.withColumn("prompt", T.prompt(EXPLAIN, report=F.col("report"))))
    return said.select(key, F.coalesce(F.nullif("answer", F.lit("")), "report").alias("summary"))


def described(found: DataFrame, ask: Callable[[DataFrame], DataFrame] = answered) -> DataFrame:
    """``(file_path, responsibility, layer, key_concepts)`` of modules ``(file_path, symbols, imports)`` by a model; what its JSON doesn't say is empty, and the layer ``utility``."""
    prompts = found.withColumn("prompt", T.prompt(CARD, file=F.col("file_path"), symbols=F.array_join("symbols", ", "), imports=F.array_join("imports", ", ")))
    said = ask(prompts).withColumn("said", F.from_json(T.embedded_json(F.col("answer")), "responsibility string, layer string, key_concepts array<string>"))
    return said.select("file_path", F.coalesce("said.responsibility", F.lit("")).alias("responsibility"), F.coalesce("said.layer", F.lit("utility")).alias("layer"), F.coalesce("said.key_concepts", F.array().cast("array<string>")).alias("key_concepts"))


def success(definitions: DataFrame) -> DataFrame:
    """One row: definitions asked for, given, and their share."""
    got = F.when(F.coalesce("answer", F.lit("")) != "", 1).otherwise(0)
    return definitions.agg(F.count("*").alias("asked"), F.sum(got).cast("bigint").alias("given"), F.round(F.avg(got.cast("double")), 6).alias("rate"))


class DefinitionsFailed(RuntimeError):
    """Too few definitions came back."""


def require(definitions: DataFrame, least: float = 0.5) -> None:
    row = success(definitions).first()
    if row["asked"] and row["rate"] < least:
        raise DefinitionsFailed(f"{row['given']} of {row['asked']} definitions")


def suggested(terms: DataFrame, edges: DataFrame, concept_file: DataFrame, each: int = 3, most: int = 10, key: str = "issue_id") -> DataFrame:
    """``(key, concept)``: the first neighbours by name of every known term, known terms left out, ``most`` a key."""
    asked = terms.select(key, F.lower("term").alias("term")).distinct()
    known = asked.join(concept_file.select(F.col("concept").alias("term")).distinct(), "term", "left_semi")
    near = known.join(undirected(edges), F.col("term") == F.col("node")).select(key, "term", F.col("nbr").alias("concept"))
    first = top(near, [key, "term"], ["concept"], each, "r").select(key, "concept").distinct()
    new = first.join(known.withColumnRenamed("term", "concept"), [key, "concept"], "left_anti")
    return top(new, [key], ["concept"], most, "r").select(key, "concept")


def diagnosed(terms: DataFrame, edges: DataFrame, concept_file: DataFrame, k: int = 10, key: str = "issue_id") -> dict[str, DataFrame]:
    """What a model's terms ``(key, term)`` lead to: terms known and not, files ranked, and how far to trust it.

    A known concept weighs 1, its neighbours one half; a file scores the sum of
    weight times idf of the distinct concepts that it holds.
    """
    asked = terms.select(key, F.lower("term").alias("term")).distinct()
    said = cut(asked.select(F.col("term").alias("concept")).distinct())
    names = cut(concept_file.join(few(said, said.count()), "concept", "left_semi").select(F.col("concept").alias("term")).distinct())
    known, unknown = asked.join(names, "term", "left_semi"), asked.join(names, "term", "left_anti")
    # keys of the same known terms lead to the same files
    firsts, members = classes(known, key, ["term"])
    near = firsts.join(undirected(edges), F.col("term") == F.col("node")).select(key, F.col("nbr").alias("concept"), F.lit(0.5).alias("weight"))
    weights = cut(firsts.select(key, F.col("term").alias("concept"), F.lit(1.0).alias("weight")).unionByName(near).groupBy(key, "concept").agg(F.max("weight").alias("weight")))
    n = weights.count()
    each = lambda df: members.join(df.withColumnRenamed(key, "of"), "of").drop("of")
    held = concept_file.join(few(weights.select("concept").distinct(), n), "concept", "left_semi").select("concept", "file").distinct()
    total = concept_file.select("file").distinct().agg(F.count("*").alias("n"))
    df = held.groupBy("concept").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # total: one row
    scored = held.join(few(weights.join(df, "concept"), n), "concept").groupBy(key, "file").agg(F.round(F.sum(F.col("weight") * T.idf(F.col("n"), F.col("df"))), 4).alias("score"))
    share = asked.join(known.withColumn("k", F.lit(1)), [key, "term"], "left").groupBy(key).agg(F.avg(F.coalesce("k", F.lit(0))).alias("share"))
    trust = share.select(key, F.round("share", 6).alias("share"), F.when(F.col("share") >= 0.6, "high").when(F.col("share") >= 0.3, "medium").otherwise("low").alias("confidence"))
    files = top(scored, [key], [F.desc("score"), "file"], k)
    return {"known": known, "unknown": unknown, "files": each(files), "confidence": trust, "weights": each(weights)}


def reasons(diagnosis: dict[str, DataFrame], edges: DataFrame, concept_file: DataFrame, each: int = 3, hops: int = 3, key: str = "issue_id") -> DataFrame:
    """``(key, file, source, target, path)``: of every file of a diagnosis one path from a known term to a concept that the file holds.

    The first ``each`` terms and concepts by name are tried, in order; files that none reaches are left out.
    """
    first = top(diagnosis["known"], [key], ["term"], each, "s").select(key, "s", F.col("term").alias("source"))
    held = diagnosis["files"].select(key, "file").join(concept_file.select("file", "concept").distinct(), "file").join(diagnosis["weights"].select(key, "concept"), [key, "concept"])
    ends = top(held, [key, "file"], ["concept"], each, "t").select(key, "file", "t", F.col("concept").alias("target"))
    tried = ends.join(first, key)
    found = tried.join(shortest_paths(tried, edges, hops), ["source", "target"])
    return top(found, [key, "file"], ["s", "t"], 1, "r").select(key, "file", "source", "target", "path")


def consequences(diagnosis: dict[str, DataFrame], edges: DataFrame, concept_file: DataFrame, first: int = 3, most: int = 20, key: str = "issue_id") -> DataFrame:
    """``(key, file, direct, shared)``: what changing the ``first`` files of every issue would affect, those files left out."""
    changed = diagnosis["files"].where(F.col("rank") <= first).select(key, F.col("file").alias("changed"))
    hit = changed.join(impact(changed.select("changed").distinct(), edges, concept_file), "changed").groupBy(key, "file").agg(F.bool_or("direct").alias("direct"), F.max("shared").alias("shared"))
    hit = hit.join(changed.withColumnRenamed("changed", "file"), [key, "file"], "left_anti")
    return top(hit, [key], [F.desc("direct"), F.desc("shared"), "file"], most, "r").drop("r")
