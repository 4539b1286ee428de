"""What others may plug in: embeddings of queries and texts, and handlers of stages."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame

from tidemark.functions import vector


class EmbeddingProvider(Protocol):
    """Turns a text column into a column of vectors."""

    def __call__(self, text: Column) -> Column: ...


class StageInput(Protocol):
    """What a stage works on: the columns that make its result, and so its idempotency key."""

    def payload(self) -> Mapping[str, Column]: ...


#: Works on all due runs of a stage at once.
StageHandler = Callable[[DataFrame], DataFrame]

PROVIDERS: dict[str, EmbeddingProvider] = {"dummy": vector.dummy_embedding}
HANDLERS: dict[str, StageHandler] = {}


def provider(name: str) -> EmbeddingProvider:
    """A registered provider, whatever the case of its name; an unknown name is an error."""
    if (found := PROVIDERS.get(name.lower())) is None:
        raise ValueError(f"no embedding provider {name}; there are {', '.join(sorted(PROVIDERS))}")
    return found


def run_stage(name: str, runs: DataFrame) -> DataFrame:
    """Hand a stage's runs to its handler; a stage without one is an error."""
    if (handler := HANDLERS.get(name)) is None:
        raise ValueError(f"no handler for stage {name}")
    return handler(runs)
