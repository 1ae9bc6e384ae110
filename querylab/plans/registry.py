"""Registry of named queries: a Spark builder plus (optionally) the DuckDB
oracle SQL that must give the same rows.

A plan module declares::

    @query("R_F1_compare", sql="SELECT ...", ids=("F-1",))
    def f1(t: Tables) -> DataFrame: ...

``t`` is a :class:`querylab.tables.Tables` bound to the scale-factor folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from querylab.tables import Tables


@dataclass
class QuerySpec:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    ids: tuple[str, ...] = field(default_factory=tuple)
    bench: bool = True

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, QuerySpec] = {}


def query(name: str, sql: str | None = None, ids: tuple[str, ...] = (), bench: bool = True):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, tuple(ids), bench)
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    """Import every plan module so its queries register."""
    from querylab.plans import (  # noqa: F401
        relational, compare, workload, scoring, catalog, textsim, io, streaming_plans,
    )
    return REGISTRY
