"""Named queries over the test tables, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import tune
from ..testbed import Testbed, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, inputs: tuple[str, ...] | str = ()):
    """Decorator: make `fn(testbed)` a named query; `sql` sees the inputs as in_<name>."""
    if isinstance(inputs, str):
        inputs = tuple(inputs.split())

    def add(fn: Callable[[Testbed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Testbed(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = with_inputs(inputs, sql)
        return fn

    return add


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded output column, keeping its name."""
    out = F.round(F.col(c) if isinstance(c, str) else c, digits)
    label = name or (c if isinstance(c, str) else None)
    return out.alias(label) if label else out


def fine(c: str | Column, digits: int, name: str | None = None) -> Column:
    """Rounded output, two places finer than `digits`, exact halves upwards; `sqltext.fine` does the same steps."""
    value, unit = F.col(c) if isinstance(c, str) else c, float(10 ** (digits + 2))
    label = name or (c if isinstance(c, str) else None)
    out = F.floor(value * unit + 0.5) / unit
    return out.alias(label) if label else out


def load() -> None:
    """Import every group of queries."""
    from . import catalogue, grids, inversion, measures, nodes, storage  # noqa: F401
