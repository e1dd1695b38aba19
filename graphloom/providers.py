"""Replaceable parts: embedders, chat, summaries, web search and decoders, by name. Embedders and decoders turn a column into a column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import NotFound, ProviderFailed
from graphloom.functions.text import shorten
from graphloom.functions.vectors import mock_embedding
from graphloom.operators.summary import central


@dataclass
class Registry:
    """Providers of one kind by name. An unknown name is an error, or the fallback where there is one."""

    kind: str
    fallback: str | None = None
    known: dict[str, Callable] = field(default_factory=dict)
    local: set[str] = field(default_factory=set)

    def add(self, name: str, provider: Callable, local: bool = False) -> Callable:
        self.known[name] = provider
        if local:
            self.local.add(name)
        return provider

    def get(self, name: str) -> Callable:
        found = self.known.get(name) or self.known.get(self.fallback or "")
        if found is None:
            raise NotFound(f"no {self.kind} named {name}")
        return found


EMBEDDERS = Registry("embedder")
SUMMARIZERS = Registry("summarizer")
SEARCHES = Registry("search provider", fallback="mock")
EMBEDDERS.add("mock", lambda text, dimension=768: mock_embedding(text, dimension), local=True)
SUMMARIZERS.add("first", lambda text, most=500: shorten(text, most), local=True)
SUMMARIZERS.add("central", lambda text, most=500: central(text, most), local=True)


def _mock_search(queries):
    from graphloom.plans.api import mock_search

    return mock_search(queries)


SEARCHES.add("mock", _mock_search, local=True)


@dataclass(frozen=True)
class Brain:
    """The chosen providers. All of them are tried at the start, and any failure ends it."""

    embedder: str = "mock"
    summarizer: str = "first"
    search: str = "mock"
    dimension: int = 768

    def check(self, spark) -> None:
        row = spark.range(1).select(self.embed(F.lit("probe")).alias("v"), self.summarize(F.lit("probe")).alias("s")).first()
        if row.v is None or len(row.v) != self.dimension or row.s is None:
            raise ProviderFailed("a provider gave nothing, or a vector of another dimension")

    def embed(self, text: Column) -> Column:
        """A vector of each text that isn't blank, else null."""
        return F.when(F.trim(text) != "", EMBEDDERS.get(self.embedder)(text, self.dimension))

    def summarize(self, text: Column) -> Column:
        return SUMMARIZERS.get(self.summarizer)(text)

    @property
    def is_local(self) -> bool:
        return self.embedder in EMBEDDERS.local and self.summarizer in SUMMARIZERS.local and self.search in SEARCHES.local
