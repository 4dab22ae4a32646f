"""Named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Fixture under a name, with the SQL that must give the same rows."""
    def wrap(fn):
        from gapcube.plans.fixtures import fixture
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(fixture(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap
