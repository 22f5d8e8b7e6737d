"""Small helpers shared by the registered queries."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import derive
from plumbline.sources.staging import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def with_views(sql: str, *names: str, extra: str = "") -> str:
    """A statement that may read derived views; ``extra`` adds more ``WITH`` items."""
    head = derive.ctes(*names) if names else "WITH"
    if extra:
        head += (",\n" if names else " ") + extra
    return f"{head if names or extra else ''}\n{sql}"


@dataclass
class Registry:
    """Queries of a module, and the SQL that gives the same rows."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register
