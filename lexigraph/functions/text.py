"""Text and path functions on columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

_PART = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|$)"
_TOKEN = r"[A-Za-z_][A-Za-z0-9_]+"
_TOKEN_RE = re.compile(_TOKEN)
_SUFFIXES = (("ing", ""), ("ies", "y"), ("ied", ""), ("es", ""), ("s", ""), ("ed", ""))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_identifier(name: Column) -> Column:
    """Lower-case parts of an identifier: at underscores and at case changes. A segment without letter runs stays whole."""

    def parts(segment: Column) -> Column:
        found = F.regexp_extract_all(segment, F.lit(_PART), F.lit(0))
        return F.when(F.size(found) > 0, F.transform(found, F.lower)).otherwise(F.array(F.lower(segment)))

    segments = F.filter(F.split(name, "_"), lambda s: F.length(s) > 0)
    return F.flatten(F.transform(segments, parts))


def filter_tokens(tokens: Column, blocked=None, keep_upper=tuple(words.ABBREVIATIONS), min_length: int = 2) -> Column:
    """Tokens that may be concepts. Blocked ones go before the abbreviations are looked at; those stay upper case."""
    block = _strings(words.blocklist() if blocked is None else blocked)
    kept = F.filter(tokens, lambda t: (F.length(t) >= min_length) & ~F.array_contains(block, F.lower(t)) & ~t.rlike("^[0-9]+$"))
    return F.transform(kept, lambda t: F.when(F.upper(t).isin(*keep_upper), F.upper(t)).otherwise(F.lower(t)) if keep_upper else F.lower(t))


def concept_name(identifier: Column, **options) -> Column:
    """Kept tokens joined by underscores; empty when none is kept."""
    return F.array_join(filter_tokens(split_identifier(identifier), **options), "_")


def is_noun_like(token: Column) -> Column:
    return ~F.lower(token).isin(*words.VERBS)


def issue_tokens(text: Column, stopwords=tuple(words.STOPWORDS)) -> Column:
    """Lower-case word tokens of an issue, repeats and order kept, function words dropped."""
    stop = _strings(stopwords)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def code_tokens(text: Column) -> Column:
    """Lower-case tokens of code: each whole, then its parts at underscores."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0)), F.lower)
    parts = lambda t: F.when(F.contains(t, F.lit("_")), F.filter(F.split(t, "_"), lambda p: F.length(p) >= 2)).otherwise(F.slice(F.array(t), 1, 0))
    return F.flatten(F.transform(found, lambda t: F.concat(F.array(t), parts(t))))


def code_words(text: str | None) -> list[str]:
    """The tokens of :func:`code_tokens`, outside of a plan."""
    found = " ".join(_TOKEN_RE.findall(text or "")).lower().split()
    if not any("_" in t for t in found):
        return found
    return [w for t in found for w in (t, *((p for p in t.split("_") if len(p) >= 2) if "_" in t else ()))]


def light_stem(token: Column) -> Column:
    """Strip the first suffix that leaves three letters; short tokens stay."""
    t = F.lower(token)
    out = t
    for suffix, instead in reversed(_SUFFIXES):
        fits = F.endswith(t, F.lit(suffix)) & (F.length(t) >= len(suffix) + 3)
        out = F.when(fits, F.concat(F.substring(t, F.lit(1), F.length(t) - len(suffix)), F.lit(instead))).otherwise(out)
    return F.when(F.length(t) <= 3, t).otherwise(out)


def enriched_title(title: Column, body: Column, least: int = 5) -> Column:
    """A title of few words gets the body's first line that is neither empty nor a heading put before it."""
    long_words = F.size(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: F.length(w) >= 3))
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), F.trim), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.when((long_words < least) & (F.size(lines) > 0), F.concat(F.get(lines, F.lit(0)), F.lit("\n\n"), title)).otherwise(title)


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def after_first_line(text: Column) -> Column:
    return F.when(F.instr(text, "\n") > 0, F.trim(F.substring(text, F.instr(text, "\n") + 1, F.length(text)))).otherwise("")


def normal_path(path: Column, roots=()) -> Column:
    """Forward slashes; everything through the first of ``roots`` cut."""
    out = F.regexp_replace(path, r"\\", "/")
    for root in roots:
        out = F.regexp_replace(out, "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return out


def subdomain(path: Column, known=None, other: str = "other") -> Column:
    """First directory of a path; with ``known``, only those count."""
    first = F.regexp_replace(F.split_part(path, F.lit("/"), F.lit(1)), r"\.py$", "")
    return F.when(first.isin(*known), first).otherwise(other) if known else F.when(first == "", other).otherwise(first)


def glob_regex(pattern: str) -> str:
    """Shell pattern as a regular expression in which ``*`` crosses slashes."""
    turned = reduce(lambda s, c: s + {"*": ".*", "?": "."}.get(c, re.escape(c)), pattern, "")
    return f"^{turned}$"


def idf(files: Column, df: Column) -> Column:
    """ln(1 + N / max(1, df))."""
    return F.log(1.0 + files.cast("double") / F.greatest(df, F.lit(1)))


def says_yes(answer: Column) -> Column:
    return F.coalesce(F.startswith(F.upper(first_line(F.trim(answer))), F.lit("YES")), F.lit(False))


def reason_of(answer: Column) -> Column:
    """Second line of a judge's answer, or all of it."""
    lines = F.split(F.trim(answer), "\n")
    return F.when(F.size(lines) > 1, F.trim(F.get(lines, F.lit(1)))).otherwise(F.trim(answer))


def embedded_json(text: Column) -> Column:
    """First braced span of a text that may be fenced."""
    bare = F.regexp_replace(text, r"```[a-z]*", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def listed_paths(text: Column) -> Column:
    """Texts of the first JSON array of a text, or else the quoted source paths in it."""
    bare = F.trim(F.regexp_replace(text, r"```[a-z]*", ""))
    whole = F.when(F.startswith(bare, F.lit("[")) & F.endswith(bare, F.lit("]")), F.from_json(bare, "array<string>"))
    part = F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\[.*?\]", 0), F.lit("")), "array<string>")
    found = F.regexp_extract_all(bare, F.lit(r'"([\w.-]+(?:/[\w.-]+)*\.py)"'), F.lit(1))
    return F.array_compact(F.coalesce(whole, part, found, F.array().cast("array<string>")))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def half_up(value: Column, digits: int) -> Column:
    """``value`` times the power of ten, rounded half away from zero and divided again, as SQL's ``round`` of a double."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def prompt(template: str, **fields: Column) -> Column:
    """Template filled from columns; nulls and empty texts read ``(none)``."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("(none)")))
    return out


def path_text(hops: Column) -> Column:
    """``a ~[syn]~> b ~[cooc]~> c`` of an array of (concept, edge_type); the first has no edge."""
    step = lambda h: F.concat(F.when(h["edge_type"].isNull(), "").otherwise(F.concat(F.lit(" ~["), F.when(h["edge_type"] == "synonym", "syn").otherwise("cooc"), F.lit("]~> "))), h["concept"])
    return F.array_join(F.transform(hops, step), "")
