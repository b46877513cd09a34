"""Registry of queries: each a Spark plan and, where SQL can state it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curvine.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(ship(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


# --- SQL building blocks -----------------------------------------------------

E_SQL = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def sq_l2_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def softmax_sql(a: str) -> str:
    exps = f"list_transform({a}, lambda x: exp(x - list_max({a})))"
    return f"list_transform({exps}, lambda x: x / list_sum({exps}))"
