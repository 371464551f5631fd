"""Registered queries: (name, builder, SQL) triples from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import timestamps
from . import cleaning_queries, eval_queries, scalar_queries, search_queries, state_queries

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MODULES = (scalar_queries, cleaning_queries, search_queries, eval_queries, state_queries)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "p3_found": lambda s, d: timestamps.found_instants(_t(s, d, "episodes"), _t(s, d, "shows"), _t(s, d, "click_log"), _t(s, d, "feed_zones")),
    }
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.SQL
    return out
