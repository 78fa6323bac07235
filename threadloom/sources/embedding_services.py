"""Clients of embedding services that speak HTTP, as ``Embedder``s. They are made on the driver and called in tasks, a batch at a time."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from threadloom.config import Embeddings
from threadloom.operators.vectors import Embedder, HashingEmbedder, checked

Post = Callable[[str, dict, dict, float], tuple[int, str]]
TIMEOUT, READY_TIMEOUT = 60.0, 3.0


class ServiceError(RuntimeError):
    pass


def http_post(url: str, body: dict, headers: dict, timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def http_get(url: str, timeout: float) -> tuple[int, str]:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.status, answer.read().decode("utf-8", "replace")


def base_url(address: str) -> str:
    """The service's root, from a host, an ``/api`` root or an embedding address."""
    address = address.strip().rstrip("/")
    if not re.match(r"https?://", address, re.I):
        address = "http://" + address
    return re.sub(r"/api(?:/embed(?:dings)?)?\Z", "", address)


def parsed(text: str) -> dict:
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def answer_vectors(body: dict) -> list[list[float]]:
    """Vectors of any of the customary answers: ``embeddings``, ``embedding``, or ``data`` with an index for each."""
    if isinstance(body.get("embeddings"), list):
        return body["embeddings"]
    if isinstance(body.get("embedding"), list):
        return [body["embedding"]]
    if isinstance(body.get("data"), list):
        rows = sorted(enumerate(body["data"]), key=lambda x: x[1].get("index", x[0]))
        return [r["embedding"] for _, r in rows]
    raise ServiceError("the answer has no embeddings")


def error_text(body: dict, status: int) -> str:
    for key in ("error", "detail", "message"):
        value = body.get(key)
        if isinstance(value, dict):
            value = value.get("message")
        if isinstance(value, str) and value:
            return value
    return f"status {status}"


def with_prefix(text: str, input_type: str, model: str) -> str:
    """The text with the prefix that a family of models expects; the same as ``textops.embedding_text``."""
    lower = model.lower()
    if "embed" in lower and "qwen" in lower:
        return f"Instruct: Retrieve relevant documents for the given query\nQuery: {text}" if input_type == "query" else text
    if "embeddinggemma" in lower or "nomic" in lower:
        return ("task: search result | query: " if input_type == "query" else "title: none | text: ") + text
    return text


@dataclass
class OllamaEmbedder:
    model: str
    dimensions: int
    endpoint: str = "http://127.0.0.1:11434"
    post: Post = http_post

    @property
    def model_key(self) -> str:
        return f"ollama:{self.model}"

    def embed(self, texts: Sequence[str], input_type: str = "document") -> np.ndarray:
        body = {"model": self.model, "input": [with_prefix(t, input_type, self.model) for t in texts]}
        status, text = self.post(f"{base_url(self.endpoint)}/api/embed", body, {}, TIMEOUT)
        if status != 200:
            raise ServiceError(error_text(parsed(text), status))
        return checked(np.array(answer_vectors(parsed(text)), np.float32), len(texts), self.dimensions)

    def ready(self, get: Callable[[str, float], tuple[int, str]] = http_get) -> tuple[bool, str]:
        try:
            status, text = get(f"{base_url(self.endpoint)}/api/tags", READY_TIMEOUT)
        except OSError as e:
            return False, f"the service can't be reached: {e}"
        names = {m.get("name", "").removesuffix(":latest") for m in parsed(text).get("models", []) if isinstance(m, dict)}
        if status != 200 or self.model.removesuffix(":latest") not in names:
            return False, f"the service doesn't have the model {self.model}"
        return True, ""


@dataclass
class LlamaServerEmbedder:
    """A llama.cpp server with an embedding model loaded, by its OpenAI-like interface."""

    model: str
    dimensions: int
    endpoint: str = "http://127.0.0.1:8080"
    post: Post = http_post

    @property
    def model_key(self) -> str:
        return f"llama:{self.model}"

    def embed(self, texts: Sequence[str], input_type: str = "document") -> np.ndarray:
        body = {"model": self.model, "input": [with_prefix(t, input_type, self.model) for t in texts]}
        status, text = self.post(f"{base_url(self.endpoint)}/v1/embeddings", body, {}, TIMEOUT)
        if status != 200:
            raise ServiceError(error_text(parsed(text), status))
        return checked(np.array(answer_vectors(parsed(text)), np.float32), len(texts), self.dimensions)

    def ready(self, get: Callable[[str, float], tuple[int, str]] = http_get) -> tuple[bool, str]:
        try:
            status, _ = get(f"{base_url(self.endpoint)}/health", READY_TIMEOUT)
        except OSError as e:
            return False, f"the llama.cpp server can't be reached: {e}"
        return (True, "") if status == 200 else (False, f"the llama.cpp server isn't ready: status {status}")


@dataclass
class VoyageEmbedder:
    model: str
    dimensions: int
    api_key: str
    endpoint: str = "https://api.voyageai.com/v1/embeddings"
    post: Post = http_post

    @property
    def model_key(self) -> str:
        return self.model

    def embed(self, texts: Sequence[str], input_type: str = "document") -> np.ndarray:
        body = {"model": self.model, "input": list(texts), "input_type": input_type, "output_dimension": self.dimensions}
        status, text = self.post(self.endpoint, body, {"Authorization": f"Bearer {self.api_key}"}, TIMEOUT)
        if status != 200:
            raise ServiceError(error_text(parsed(text), status))
        return checked(np.array(answer_vectors(parsed(text)), np.float32), len(texts), self.dimensions)


def make_embedder(settings: Embeddings, endpoint: str | None = None):
    """The client that the settings name. Models run in a service, local ones too; for one inside the process give an ``Embedder`` of your own."""
    if not settings.configured:
        raise ServiceError("embeddings are disabled, or the service's key is missing")
    more = {"endpoint": endpoint} if endpoint else {}
    if settings.provider == "voyage":
        return VoyageEmbedder(settings.model, settings.dimensions, settings.api_key, **more)
    if settings.provider == "ollama":
        return OllamaEmbedder(settings.model, settings.dimensions, **more)
    if settings.provider == "hashing":
        return HashingEmbedder(settings.dimensions, settings.model_key)
    return LlamaServerEmbedder(settings.model, settings.dimensions, **more)


def ready_embedder(settings: Embeddings, endpoint: str | None = None) -> tuple[Embedder | None, str]:
    """(the client, "") where it can be used now, else (None, why not and what would help)."""
    try:
        embedder = make_embedder(settings, endpoint)
    except ServiceError as e:
        return None, f"{e}; search is by keywords only"
    ok, why = embedder.ready() if hasattr(embedder, "ready") else (True, "")
    return (embedder, "") if ok else (None, f"{why}; start it, or choose another with THREADLOOM_EMBEDDING_PROVIDER; search is by keywords only")
