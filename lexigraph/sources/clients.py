"""Models behind HTTP, and one that runs in the task, for :mod:`lexigraph.operators.models`.

A client is made by the task that uses it, so only its settings are sent. A
server that is busy is asked again after doubling waits; one that refuses the
key gives empty answers.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

BUSY = (429, 500, 502, 503, 504, 529)


def post(url: str, body: dict, headers: dict[str, str], tries: int = 3, wait: float = 1.0, timeout: float = 120.0) -> dict | None:
    """The JSON reply, or None where the key is refused; a busy server is asked ``tries`` times."""
    data = json.dumps(body).encode()
    for k in range(tries):
        request = urllib.request.Request(url, data, {"Content-Type": "application/json"} | headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code == 401:
                return None
            if e.code not in BUSY or k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    return None


class _Server:
    def __init__(self, url: str, model: str, key_name: str | None = None, at_once: int = 8, wait: float = 1.0):
        self.url, self.model, self.key_name, self.at_once, self.wait = url.rstrip("/"), model, key_name, at_once, wait

    def _key(self) -> str:
        return os.environ.get(self.key_name, "") if self.key_name else ""


class ChatWriter(_Server):
    """Answers of a server that speaks the common chat-completions form."""

    system, tokens, temperature = "", 1000, 0.0

    def _one(self, prompt: str) -> str:
        messages = [{"role": "system", "content": self.system}] if self.system else []
        body = {"model": self.model, "messages": [*messages, {"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.tokens}
        reply = post(f"{self.url}/chat/completions", body, {"Authorization": f"Bearer {self._key()}"}, wait=self.wait)
        return (reply["choices"][0]["message"]["content"] or "") if reply else ""

    def answer(self, prompts: list[str]) -> list[str]:
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(self._one, prompts))


class MessagesWriter(ChatWriter):
    """Answers of a server that speaks the messages form, whose replies are lists of text blocks."""

    def _one(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.tokens}
        reply = post(f"{self.url}/messages", body | ({"system": self.system} if self.system else {}), {"x-api-key": self._key()}, wait=self.wait)
        return "".join(part.get("text", "") for part in reply["content"]) if reply else ""


class HttpEmbedder(_Server):
    """Vectors of a server that speaks the common embeddings form, 100 texts a call."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for at in range(0, len(texts), 100):
            reply = post(f"{self.url}/embeddings", {"model": self.model, "input": texts[at : at + 100]}, {"Authorization": f"Bearer {self._key()}"}, wait=self.wait)
            if reply is None:
                raise PermissionError("the embedding server refuses the key")
            out += [row["embedding"] for row in sorted(reply["data"], key=lambda row: row["index"])]
        return out


class LocalEmbedder:
    """Vectors of a sentence model in the task, loaded when the first texts come."""

    def __init__(self, model: str, batch: int = 64):
        self.name, self.batch, self.model = model, batch, None

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise RuntimeError("a local embedder needs the sentence_transformers package") from e
            self.model = SentenceTransformer(self.name)
        return self.model.encode(texts, batch_size=self.batch).tolist()


WRITERS = {"chat": ChatWriter, "messages": MessagesWriter}
EMBEDDERS = {"http": HttpEmbedder, "local": LocalEmbedder}
