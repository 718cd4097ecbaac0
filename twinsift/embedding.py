"""Embedders: the plug-in contract, a deterministic local one, and one for a local model service."""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import subprocess
import time
import urllib.parse
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .functions.scalars import max_input_bytes
from .session import ship

BATCH = 32

# Names and numbers of the service's contract.
PREFERRED = ["nomic-embed-code", "nomic-embed-text"]
QUERY_PREFIX_MODELS, QUERY_PREFIX = "nomic-embed", "search_query: "
DEFAULT_TIER, SERVE = "7b", ["ollama", "serve"]
ATTEMPTS, PAUSE_S, TIMEOUT_S, CONNECT_S = 3, 0.5, 120, 10
START_CHECKS, START_PAUSE_S = 20, 0.5


class EmbedderError(RuntimeError):
    """The model can't be asked or answers wrongly."""


class Embedder(Protocol):
    """Anything picklable that turns texts into vectors of one width."""

    model: str
    dimensions: int
    max_bytes: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def cut(text: str, limit: int) -> str:
    """At most limit bytes of UTF-8, ending between characters."""
    data = text.encode()
    return text if len(data) <= limit else data[:limit].decode(errors="ignore")


@lru_cache(maxsize=1 << 18)
def _gram_hash(gram: str) -> int:
    """32 bits for a place, and one for a sign above them."""
    return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest()[:5], "little") & 0x1FFFFFFFF


@dataclass
class HashingEmbedder:
    """Unit vectors of hashed words and their pairs: near texts get near vectors, equal texts equal ones."""

    dimensions: int = 64
    model: str = "hashing-64"
    max_bytes: int = 16_000

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
            counts = Counter([*words, *map(" ".join, zip(words, words[1:], strict=False))] or [""])
            hashed = np.array([_gram_hash(gram) for gram in counts], dtype=np.int64)
            signed = np.where(hashed >> 32 & 1, 1.0, -1.0) * np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
            vector = np.bincount((hashed & 0xFFFFFFFF) % self.dimensions, weights=signed, minlength=self.dimensions)
            norm = np.sqrt((vector * vector).sum())
            out.append((vector / norm if norm else np.eye(self.dimensions)[0]).tolist())
        return out


@dataclass
class ServiceEmbedder:
    """A model service on the network: batches by POST; only failures of transport are tried again."""

    model: str
    host: str = "http://localhost:11434"
    dimensions: int = 0
    max_bytes: int = 16_000
    query_prefix: str = ""

    @property
    def tier(self) -> str:
        """The model's tag, which says its size."""
        return self.model.partition(":")[2].replace("latest", "") or DEFAULT_TIER

    def _ask(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        place = urllib.parse.urlsplit(self.host if "://" in self.host else f"http://{self.host}")
        kind = http.client.HTTPSConnection if place.scheme == "https" else http.client.HTTPConnection
        for attempt in range(ATTEMPTS):
            connection = kind(place.hostname, place.port, timeout=CONNECT_S)
            try:
                connection.connect()
                connection.sock.settimeout(TIMEOUT_S)
                connection.request("GET" if data is None else "POST", place.path.rstrip("/") + path, data, {"Content-Type": "application/json"})
                answer = connection.getresponse()
                if answer.status >= 400:
                    raise EmbedderError(f"the model service answers {answer.status}")
                return json.loads(answer.read())
            except ValueError as error:
                raise EmbedderError("the model service's answer is no JSON") from error
            except (OSError, http.client.HTTPException) as error:
                if attempt == ATTEMPTS - 1:
                    raise EmbedderError(f"the model service at {self.host} can't be reached: {error}") from error
                time.sleep(PAUSE_S)
            finally:
                connection.close()
        raise EmbedderError("no attempt was made")

    def healthy(self) -> bool:
        try:
            self.models()
        except EmbedderError:
            return False
        return True

    def start(self) -> bool:
        """Start the service on this machine, where it outlives this program, and wait until it answers."""
        try:
            subprocess.Popen(SERVE, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        except OSError:
            return False
        for _ in range(START_CHECKS):
            time.sleep(START_PAUSE_S)
            if self.healthy():
                return True
        return False

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = self._ask("/api/embed", {"model": self.model, "input": texts}).get("embeddings")
        if not isinstance(found, list) or len(found) != len(texts):
            raise EmbedderError("the model service returned another number of vectors")
        return found

    def models(self) -> list[str]:
        return [m["name"] for m in self._ask("/api/tags").get("models", [])]

    def metadata(self) -> tuple[int | None, int | None]:
        """(context length, vector width) of the model."""
        details = self._ask("/api/show", {"model": self.model}).get("model_info", {})
        arch = details.get("general.architecture", "")
        return details.get(f"{arch}.context_length"), details.get(f"{arch}.embedding_length")


def choose_model(explicit: str | None, installed: list[str], env: str | None = None) -> str:
    """The named model, or the environment's, or the first of the preferred ones that is installed under any tag."""
    if explicit or env:
        return explicit or env
    for name in PREFERRED:
        exact = next((m for m in installed if m in (name, f"{name}:latest")), None)
        if found := exact or next((m for m in installed if m.startswith(f"{name}:")), None):
            return found
    raise EmbedderError("no embedding model is installed")


def query_prefix(explicit: str | None, model: str) -> str:
    """What goes before texts that are searched for: as given, or as the environment says, or as the model is used to."""
    if explicit is not None:
        return explicit
    return os.environ.get("TWINSIFT_QUERY_PREFIX", QUERY_PREFIX if model.startswith(QUERY_PREFIX_MODELS) else "")


def as_query(embedder: Embedder, text: str) -> str:
    """A text to be searched for, cut, with the embedder's prefix."""
    return f"{getattr(embedder, 'query_prefix', '')}{cut(text, embedder.max_bytes)}"


def resolve(model: str | None = None, host: str | None = None, dimensions: int | None = None, context: int | None = None, max_bytes: int | None = None, prefix: str | None = None) -> Embedder:
    """The embedder that settings and environment ask for; the local one unless a service is named."""
    host, named = host or os.environ.get("TWINSIFT_HOST") or os.environ.get("OLLAMA_HOST"), model or os.environ.get("TWINSIFT_MODEL")
    env = lambda name: int(os.environ[name]) if os.environ.get(name) else None
    width = dimensions or env("TWINSIFT_DIMENSIONS")
    if not host:
        return HashingEmbedder(width or 64, f"hashing-{width or 64}", max_bytes or env("TWINSIFT_MAX_BYTES") or 16_000)
    service = ServiceEmbedder("", host)
    if not service.healthy() and not (urllib.parse.urlsplit(host if "://" in host else f"http://{host}").hostname in ("localhost", "127.0.0.1") and service.start()):
        raise EmbedderError(f"the model service at {host} doesn't answer")
    service.model = choose_model(model, [] if named else service.models(), os.environ.get("TWINSIFT_MODEL"))
    known_context, known_width = service.metadata()
    service.dimensions = width or known_width or len(service.embed(["probe"])[0])
    service.max_bytes = max_bytes or env("TWINSIFT_MAX_BYTES") or max_input_bytes(context or env("TWINSIFT_CONTEXT") or known_context)
    service.query_prefix = query_prefix(prefix, service.model)
    return service


def embed_texts(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """(content_hash, embedding) of rows (content_hash, source_text)."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                yield pd.DataFrame({"content_hash": part["content_hash"], "embedding": embedder.embed([cut(t, embedder.max_bytes) for t in part["source_text"]])})

    return rows.select("content_hash", "source_text").mapInPandas(run, "content_hash string, embedding array<float>")
