"""Query registry. A plan module registers a Spark callable and, where SQL can express it, the oracle text."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.plans.oracle import with_views
from keelson.session import prepare

MODULES = ["pointintime", "peers", "market", "text", "reviews", "scoring", "serving", "monitoring", "intake", "modelling", "streams"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable, with the oracle body over tables and proxy views."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = with_views(oracle)
        return run

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"keelson.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    load_all()
    return dict(_ORACLES)
