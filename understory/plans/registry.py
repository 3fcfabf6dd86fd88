"""Query registry: a name, a function of the inputs, and the oracle SQL if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from understory.plans.fixtures import Inputs, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, fn, with_views(oracle).replace("AS STRING)", "AS VARCHAR)") if oracle else None)
        return fn
    return register
