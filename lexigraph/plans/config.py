"""Settings: defaults, then a file, then the environment."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from functools import partial

from ..operators.models import HashedEmbedder, TemplateWriter
from ..sources.clients import WRITERS, HttpEmbedder, LocalEmbedder


@dataclass(frozen=True)
class Extraction:
    min_length: int = 2
    max_file_ratio: float = 0.5
    context_lines: int = 3


@dataclass(frozen=True)
class Relations:
    similarity: float = 0.55
    naming: float = 0.85
    judge_low: float = 0.55
    judge_high: float = 0.85
    per_concept: int = 20
    min_count: int = 3
    normalization: str = "jaccard"
    threshold: float = 0.05
    cross_factor: float = 0.3
    sense_eps: float = 0.55
    sense_occurrences: int = 5
    sense_files: int = 3


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 10
    seeds: int = 50
    semantic: float = 0.7
    lexical: float = 0.3
    floor: float = 0.15
    hops: int = 3
    min_weight: float = 0.01
    max_file_ratio: float = 0.30
    density: float = 0.4


@dataclass(frozen=True)
class Models:
    """Which models answer and embed; ``template`` and ``hashed`` are the offline stand-ins."""

    writer: str = "template"
    writer_url: str = ""
    writer_model: str = ""
    writer_key: str = ""
    embedder: str = "hashed"
    embedder_url: str = ""
    embedder_model: str = ""
    embedder_key: str = ""
    cache: str = ""


@dataclass(frozen=True)
class Server:
    """The graph server to load."""

    uri: str = ""
    user: str = ""
    password: str = ""
    database: str = ""


@dataclass(frozen=True)
class Settings:
    extraction: Extraction = field(default_factory=Extraction)
    relations: Relations = field(default_factory=Relations)
    retrieval: Retrieval = field(default_factory=Retrieval)
    models: Models = field(default_factory=Models)
    server: Server = field(default_factory=Server)


def _read(path: str) -> dict:
    """A settings file: YAML by its ending, where a reader for it is installed, else JSON."""
    with open(path, encoding="utf-8") as f:
        if not path.endswith((".yaml", ".yml")):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the yaml package; JSON ones don't") from e
        return yaml.safe_load(f) or {}


def writer(settings: Settings):
    """What makes the writer that the settings name; a key is named by its environment variable, never sent itself."""
    m = settings.models
    return TemplateWriter if m.writer == "template" else partial(WRITERS[m.writer], m.writer_url, m.writer_model, m.writer_key or None)


def embedder(settings: Settings):
    """What makes the embedder that the settings name, or None for ``none``."""
    m = settings.models
    if m.embedder == "none":
        return None
    if m.embedder == "hashed":
        return HashedEmbedder
    return partial(LocalEmbedder, m.embedder_model) if m.embedder == "local" else partial(HttpEmbedder, m.embedder_url, m.embedder_model, m.embedder_key or None)


def load(path: str | None = None, prefix: str = "LEXIGRAPH_", environ=os.environ) -> Settings:
    """Settings of a JSON or YAML file over the defaults, environment names such as LEXIGRAPH_RETRIEVAL_TOP_K over both; unknown keys are ignored."""
    given = {}
    if path:
        given = _read(path)
    parts = {}
    for part in dataclasses.fields(Settings):
        kind, values = part.default_factory, dict(given.get(part.name) or {})
        known = {f.name: type(f.default) for f in dataclasses.fields(kind)}
        for name, cast in known.items():
            if (said := environ.get(f"{prefix}{part.name}_{name}".upper())) is not None:
                values[name] = cast(said)
        parts[part.name] = kind(**{k: known[k](v) for k, v in values.items() if k in known})
    return Settings(**parts)
