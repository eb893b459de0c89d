"""Named queries: each key maps to a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where the semantics are plain SQL, an independent DuckDB SQL twin.

All registered queries run over the whole fixture tables with the reporting
date pinned to ``AS_OF``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from upkeep.plans.views_sql import with_views
from upkeep.sources import fixtures as fx


@dataclass(frozen=True)
class Registered:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    raw_sql: str | None = None   # the query before fixture views are inlined


REGISTRY: dict[str, Registered] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Registered(key, fn, with_views(sql) if sql else None, sql)
        return fn
    return deco


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [fx.view(spark, sf_dir, n) for n in names]


def _load_all() -> None:
    # Importing the modules fills REGISTRY.
    from upkeep.plans import q_analytics, q_detail, q_builder, q_worklists  # noqa: F401
    from upkeep.plans import q_snapshots, q_archive, q_ingest  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: r.build for k, r in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: r.sql for k, r in REGISTRY.items() if r.sql}
