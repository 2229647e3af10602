"""Query registry: a Spark callable and, where SQL can say it, the DuckDB text it must equal."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.bindings import ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = "", rounds: str = "", digits: int = 6):
    """Register a query. ``rounds`` names the double columns both engines round, since the order of
    a floating-point sum is not fixed."""
    cols = rounds.split()

    def keep(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(spark, sf)
            if not cols:
                return df
            return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in cols})

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            head = ctes(*needs.split())
            body = sql.strip()
            if body.upper().startswith("WITH "):
                again = "RECURSIVE " if body[5:].startswith("RECURSIVE ") else ""
                body, head = body[5 + len(again):], head + ",\n" if head else ""
                inner = f"WITH {again}{head}{body}"
            else:
                inner = f"WITH {head}\n{body}" if head else body
            if cols:
                fixed = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
                inner = f"SELECT * REPLACE ({fixed}) FROM ({inner}) q"
            ORACLES[name] = inner
        return fn

    return keep
