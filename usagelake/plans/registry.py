"""The query registry: a Spark query and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelake.plans import twins

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: tuple[str, ...] = (), oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the twins its oracle starts from."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            body = twins.duck(oracle.strip())
            if uses:
                if body.upper().startswith("WITH "):
                    body = body[5:]
                    ORACLES[name] = f"WITH {twins.ctes(*uses)},\n{body}"
                else:
                    ORACLES[name] = f"WITH {twins.ctes(*uses)}\n{body}"
            else:
                ORACLES[name] = body
        return function

    return add


def load() -> None:
    """Import every module that registers queries."""
    from usagelake.plans import (  # noqa: F401
        chain_queries,
        context_queries,
        gateway_queries,
        matching_queries,
        pricing_queries,
        stream_queries,
        usage_queries,
    )
