"""Registered queries: one per operator of the inventory, each (spark, sf_dir) ->
DataFrame over the driver tables, with its DuckDB oracle where SQL can say it.

Doubles are rounded to ``PLACES`` decimals on both sides with the same IEEE
arithmetic, floor(x * 10^p + 0.5) / 10^p, so both engines break ties alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 4
SCALE_SQL = f"CAST({10 ** PLACES} AS DOUBLE)"


def half_up(c):
    scale = F.lit(float(10 ** PLACES))
    return F.floor(c * scale + F.lit(0.5)) / scale


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    round_cols: list[str] = field(default_factory=list)
    ids: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, round_cols=(), ids: str = ""):
    def wrap(fn):
        cols = list(round_cols)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if cols:
                df = df.withColumns({c: half_up(F.col(c)) for c in cols})
            return df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql, cols, ids)
        return fn
    return wrap


def oracle(q: Query) -> str | None:
    if q.sql is None:
        return None
    if not q.round_cols:
        return q.sql
    repl = ", ".join(f"floor({c} * {SCALE_SQL} + 0.5) / {SCALE_SQL} AS {c}"
                     for c in q.round_cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{q.sql}\n) AS q"
