"""User functions: scalars, aggregates and table functions registered for SQL, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_sql(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """CREATE FUNCTION name(parameters) RETURNS returns RETURN body: an expression, inlined by the optimizer."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def register_scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str, n_arguments: int = 1) -> None:
    """f gets the arguments as series and returns one of the same length."""
    one = {1: lambda a: f(a), 2: lambda a, b: f(a, b), 3: lambda a, b, c: f(a, b, c)}[n_arguments]
    one.__annotations__ = {**dict.fromkeys(("a", "b", "c")[:n_arguments], pd.Series), "return": pd.Series}
    spark.udf.register(name, F.pandas_udf(one, returns))


def register_aggregate(spark: SparkSession, name: str, f: Callable[..., object], returns: str, n_arguments: int = 1) -> None:
    """A user aggregate: f gets a group's arguments as series and returns one value.

    A group is held in memory, as Spark has it for such functions; where it may be large, aggregate
    partial states with built-in functions first.
    """
    one = {1: lambda a: f(a), 2: lambda a, b: f(a, b), 3: lambda a, b, c: f(a, b, c)}[n_arguments]
    one.__annotations__ = {**dict.fromkeys(("a", "b", "c")[:n_arguments], pd.Series), "return": float}
    spark.udf.register(name, F.pandas_udf(one, returns))


def register_table(spark: SparkSession, name: str, f: Callable[..., Iterable[tuple]], returns: str) -> None:
    """A user table function: f yields rows, as tuples, for its arguments; callable in FROM and LATERAL."""

    class Rows:
        def eval(self, *arguments: object) -> Iterable[tuple]:
            yield from f(*arguments)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))
