"""Catalogue of runnable queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy access to the Parquet tables of one data directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(self.path(name))
        setattr(self, name, df)
        return df


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


CATALOG: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None):
    def register(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, ops, fn, sql)
        return fn
    return register
