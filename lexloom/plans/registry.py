"""Registry of queries: name, operators it covers, DataFrame plan, SQL answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import oracle
from lexloom.plans.inputs import Workbench, workbench


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Workbench], DataFrame]
    answer: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(workbench(spark, folder))


QUERIES: dict[str, Query] = {}


def query(covers: str, answer: str | None = None):
    """Register a plan under its function name; ``covers`` lists operator ids."""

    def add(plan: Callable[[Workbench], DataFrame]) -> Callable[[Workbench], DataFrame]:
        name = plan.__name__
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, tuple(covers.split()), plan, oracle.sql(answer) if answer else None)
        return plan

    return add
