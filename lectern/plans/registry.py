"""Registry of queries: a name, a function of the tables, and oracle SQL where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.exprs import q, rounded
from lectern.plans.tables import Tables

Query = Callable[[Tables], DataFrame]


DIGITS = 6


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole numbers that may be missing, as doubles, so that both engines show them alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits: sums differ in their last bits with the order of addition."""
    return df.select(
        *[
            rounded(q(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(q(f.name))
            for f in df.schema.fields
        ]
    )


@dataclass
class Registry:
    runs: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)
    digits: dict[str, int] = field(default_factory=dict)

    def add(self, name: str, run: Query, sql: str | None = None, digits: int = DIGITS) -> None:
        if name in self.runs:
            raise ValueError(f"query {name} exists")
        self.runs[name] = run
        self.digits[name] = digits
        if sql is not None:
            self.sql[name] = sql

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(name: str, run: Query) -> Callable[[SparkSession, str], DataFrame]:
            return lambda spark, folder: comparable(run(Tables(spark, folder)), self.digits[name])

        return {name: bind(name, run) for name, run in self.runs.items()}
