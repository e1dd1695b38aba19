"""Settings with their defaults, read from environment variables, and their checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from graphloom.errors import InvalidRequest


def _read(kind: type, text: str):
    if kind is bool:
        return text.strip().lower() in ("1", "true", "yes", "on")
    return kind(text)


@dataclass(frozen=True)
class Settings:
    """Base: PREFIX_NAME in the environment overrides a field; text that doesn't parse is an error, not a default."""

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None):
        environ = os.environ if environ is None else environ
        kinds = {"int": int, "float": float, "bool": bool, "str": str}
        found = {}
        for f in fields(cls):
            name = f"{cls.PREFIX}_{f.name.upper()}"
            if name in environ:
                try:
                    found[f.name] = _read(kinds[f.type if isinstance(f.type, str) else f.type.__name__], environ[name])
                except ValueError as e:
                    raise InvalidRequest(f"{name}: {e}") from e
        out = cls(**found)
        out.check()
        return out

    def check(self) -> None:
        pass

    def _need(self, good: bool, what: str) -> None:
        if not good:
            raise InvalidRequest(f"{type(self).__name__}: {what}")


@dataclass(frozen=True)
class IngestionSettings(Settings):
    PREFIX = "INGESTION"
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100
    max_file_size: int = 50 << 20
    allowed: str = "txt,md,pdf,png,jpg,jpeg"

    def check(self) -> None:
        self._need(self.chunk_size > 0, "chunk_size must be positive")
        self._need(0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be below chunk_size")
        self._need(0 <= self.min_chunk_size <= self.chunk_size, "min_chunk_size must not exceed chunk_size")


@dataclass(frozen=True)
class CacheSettings(Settings):
    PREFIX = "CACHE"
    capacity: int = 1000
    ttl_seconds: float = 3600.0
    embedding_capacity: int = 5000
    embedding_ttl_seconds: float = 86400.0
    track_metrics: bool = True

    def check(self) -> None:
        self._need(self.capacity > 0 and self.embedding_capacity > 0, "capacities must be positive")


@dataclass(frozen=True)
class RemSettings(Settings):
    PREFIX = "REM"
    start_hour: int = 2
    end_hour: int = 5
    batch_size: int = 10
    max_nodes: int = 100
    link_threshold: float = 0.7

    def check(self) -> None:
        self._need(0 <= self.start_hour < 24 and 0 <= self.end_hour < 24, "hours lie in 0 to 23")
        self._need(0 <= self.link_threshold <= 1, "link_threshold lies in 0 to 1")


@dataclass(frozen=True)
class ModelSettings(Settings):
    PREFIX = "LLM"
    provider: str = "mock"
    model: str = "mock"
    temperature: float = 0.7
    top_p: float = 1.0
    api_key: str = ""

    def check(self) -> None:
        self._need(0 <= self.temperature <= 2, "temperature lies in 0 to 2")
        self._need(0 <= self.top_p <= 1, "top_p lies in 0 to 1")
        self._need(self.provider in ("mock", "local") or bool(self.api_key), "a remote provider needs an api_key")


@dataclass(frozen=True)
class WebSearchSettings(Settings):
    PREFIX = "WEB_SEARCH"
    provider: str = "mock"
    api_key: str = ""
    base_url: str = ""
    timeout_seconds: float = 30.0
    max_results: int = 10

    def check(self) -> None:
        self._need(self.max_results > 0 and self.timeout_seconds > 0, "max_results and timeout_seconds must be positive")


@dataclass(frozen=True)
class EmbeddingSettings(Settings):
    PREFIX = "EMBEDDING"
    model: str = "nomic-ai/nomic-embed-text-v1.5"
    batch_size: int = 32
    normalize: bool = True

    def check(self) -> None:
        self._need(self.batch_size > 0, "batch_size must be positive")


@dataclass(frozen=True)
class ChatSettings(ModelSettings):
    PREFIX = "CHAT"
    max_tokens: int = 2048

    def check(self) -> None:
        super().check()
        self._need(self.max_tokens > 0, "max_tokens must be positive")


@dataclass(frozen=True)
class SummarizerSettings(ChatSettings):
    PREFIX = "SUMMARIZER"
    temperature: float = 0.3
    max_tokens: int = 512


@dataclass(frozen=True)
class StoreSettings(Settings):
    """url: a folder that all executors reach; a store is namespace/database below it."""

    PREFIX = "STORE"
    url: str = ""
    namespace: str = "graphloom"
    database: str = "knowledge"

    def check(self) -> None:
        self._need(bool(self.url), "url is missing")
        self._need(not set("/\\") & set(self.namespace + self.database) and bool(self.namespace and self.database), "namespace and database are names of folders")
