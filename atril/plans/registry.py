"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atril.plans.views import Inputs, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Register `fn`; columns named in `rounded` are compared to six decimals."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Inputs(spark, sf_dir))
            return df.withColumns({c: F.round(c, 6) for c in rounded}) if rounded else df

        run.__name__ = key
        assert key not in QUERIES, key
        QUERIES[key] = run
        if sql is not None:
            text = oracle(sql)
            if rounded:
                shown = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in rounded)
                text = f"SELECT * REPLACE ({shown}) FROM ({text})"
            ORACLES[key] = text
        return fn

    return register


def load() -> None:
    import importlib
    import pkgutil

    import atril.plans as here

    for module in sorted(m.name for m in pkgutil.iter_modules(here.__path__)):
        if module.endswith("_queries"):
            importlib.import_module(f"atril.plans.{module}")
