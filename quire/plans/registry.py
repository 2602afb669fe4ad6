"""Registry of named queries: each Spark plan sits next to its DuckDB oracle.

``@query("t8_chinese_run_count", oracle=SQL)`` registers a callable
``(spark, sf_dir) -> DataFrame``. Queries without an exact SQL formulation
(models, iterative or randomised operators) register ``oracle=None`` and are
checked by properties in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every plan module so its queries register."""
    from quire.plans import (  # noqa: F401
        q_sources, q_clean, q_measures, q_flags, q_items, q_groups, q_ordered,
        q_encode, q_ngrams, q_embed, q_models, q_stack, q_lexicon, q_stemming,
    )
    return REGISTRY
