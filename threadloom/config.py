"""Settings, with the values they have where nothing else is said, and their environment variables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

MODELS = {
    "llama": ("hf:ggml-org/embeddinggemma-300M-GGUF/embeddinggemma-300M-Q8_0.gguf", 768),
    "ollama": ("embeddinggemma", 768),
    "voyage": ("voyage-code-3", 1024),
    "hashing": ("words", 64),  # no model at all: hashed words
}


@dataclass(frozen=True)
class Embeddings:
    provider: str = "llama"
    model: str | None = None
    dimensions: int | None = None
    batch_size: int = 32
    redact_before_send: bool = True
    enabled: bool = True
    api_key: str | None = None

    def __post_init__(self):
        provider = "ollama" if self.provider == "local" else self.provider
        if provider not in MODELS:
            raise ValueError(f"unknown embedding provider {self.provider!r}")
        object.__setattr__(self, "provider", provider)
        object.__setattr__(self, "model", self.model or MODELS[provider][0])
        object.__setattr__(self, "dimensions", self.dimensions or MODELS[provider][1])

    @property
    def configured(self) -> bool:
        return self.enabled and (self.provider != "voyage" or bool(self.api_key))

    @property
    def model_key(self) -> str:
        return self.model if self.provider == "voyage" else f"{self.provider}:{self.model}"

    @property
    def label(self) -> str:
        return {"llama": "local (llama.cpp)", "ollama": "local Ollama", "voyage": "Voyage", "hashing": "hashed words"}[self.provider]


@dataclass(frozen=True)
class Config:
    roots: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "claude": ("~/.claude/projects",),
            "codex": ("~/.codex/sessions",),
            "pi": ("~/.pi/agent/sessions",),
        }
    )
    chunk_tokens: int = 512
    chunk_overlap_tokens: int = 96
    max_chunks_per_session: int = 40
    default_limit: int = 20
    include_subagents: bool = False
    recency_half_life_days: float = 30.0
    prefer_pi_session_id: bool = False
    embeddings: Embeddings = field(default_factory=Embeddings)

    def shown(self) -> dict:
        """The settings as plain values, without the key."""
        made = {f.name: getattr(self, f.name) for f in fields(self)}
        made["embeddings"] = {f.name: getattr(self.embeddings, f.name) for f in fields(Embeddings)}
        made["embeddings"]["api_key"] = "set" if self.embeddings.api_key else None
        return made


def env_text(name: str) -> str | None:
    value = os.environ.get(name, "").strip()
    return value or None


def env_flag(name: str) -> bool | None:
    value = (env_text(name) or "").lower()
    return True if value in ("1", "true", "yes", "on") else False if value in ("0", "false", "no", "off") else None


def env_int(name: str) -> int | None:
    value = env_text(name)
    return int(value) if value and value.lstrip("-").isdigit() else None


#: Environment variables, each with the setting that it stands for; those of embeddings are named so.
_ENV_TEXT = {"provider": "THREADLOOM_EMBEDDING_PROVIDER", "model": "THREADLOOM_EMBEDDING_MODEL", "api_key": "VOYAGE_API_KEY"}
_ENV_INT = {"dimensions": "THREADLOOM_EMBEDDING_DIMENSIONS", "batch_size": "THREADLOOM_EMBEDDING_BATCH"}
_ENV_FLAG = {"redact_before_send": "THREADLOOM_REDACT", "enabled": "THREADLOOM_EMBEDDINGS"}
_OWN_INT = {
    "chunk_tokens": "THREADLOOM_CHUNK_TOKENS",
    "chunk_overlap_tokens": "THREADLOOM_CHUNK_OVERLAP_TOKENS",
    "max_chunks_per_session": "THREADLOOM_MAX_CHUNKS",
    "default_limit": "THREADLOOM_LIMIT",
}
_OWN_FLAG = {"include_subagents": "THREADLOOM_INCLUDE_SUBAGENTS", "prefer_pi_session_id": "THREADLOOM_PI_SESSION_ID"}


def load(path: str | None = None) -> Config:
    """Settings from a JSON file, where there is one, and the environment, which goes before it.

    The file is ``path``, $THREADLOOM_CONFIG, or ~/.config/threadloom/config.json; its keys are those of ``Config``, with ``roots`` by
    provider and ``embeddings`` as an object. A provider is switched off by ``false`` for its roots, and by an empty variable
    THREADLOOM_<PROVIDER>_ROOTS in the environment, which else holds folders with colons between. Unknown keys raise a ValueError.
    """
    file = os.path.expanduser(path or env_text("THREADLOOM_CONFIG") or "~/.config/threadloom/config.json")
    said: Mapping = {}
    if os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            said = json.load(f)
    elif path:
        raise ValueError(f"there is no settings file {file}")
    known = {f.name for f in fields(Config)}
    inner = {f.name for f in fields(Embeddings)}
    odd = [k for k in said if k not in known] + [f"embeddings.{k}" for k in said.get("embeddings", {}) if k not in inner]
    if odd:
        raise ValueError(f"settings that aren't known: {', '.join(odd)}")
    model = {**said.get("embeddings", {})}
    for names, get in ((_ENV_TEXT, env_text), (_ENV_INT, env_int), (_ENV_FLAG, env_flag)):
        model |= {k: v for k, name in names.items() if (v := get(name)) is not None}
    own = {k: v for k, v in said.items() if k not in ("roots", "embeddings")}
    for names, get in ((_OWN_INT, env_int), (_OWN_FLAG, env_flag)):
        own |= {k: v for k, name in names.items() if (v := get(name)) is not None}
    base = Config()
    roots = dict(base.roots)
    for provider in roots:
        given = said.get("roots", {}).get(provider)
        if given is not None:
            roots[provider] = tuple(given or ()) if not isinstance(given, str) else (given,)
        if (value := os.environ.get(f"THREADLOOM_{provider.upper()}_ROOTS")) is not None:
            roots[provider] = tuple(x for x in value.split(":") if x.strip())
    return replace(base, roots=roots, embeddings=Embeddings(**model), **own)
