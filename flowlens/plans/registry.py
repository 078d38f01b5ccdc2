"""The list of registered queries: name, Spark form, DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, the form in which results are compared."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, oracle: str | None = None, exact: bool = False):
    """Register a query; ``exact`` leaves its doubles as they are."""

    def add(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(Tables(spark, sf_dir))
            return out if exact else rounded(out)

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return build

    return add
