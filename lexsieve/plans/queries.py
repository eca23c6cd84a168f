"""Driver queries: each plan in Spark SQL over the tables of a folder, and in DuckDB SQL as its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK
from ..functions.terms import Seeing
from . import structure
from .clauses import INNER
from .clauses import PLANS as CLAUSE_PLANS

#: Every plan that has an oracle.
PLANS = CLAUSE_PLANS | structure.PLANS
CLAUSES_A_TASK = 50_000
TABLES = ("orders", "customer", "region", "documents")


def bound(spark: SparkSession, plan: Callable[..., str], *base: str) -> str:
    """The Spark text of a plan. If it is over clauses with their words looked up, they have one column more, `seen`."""
    D = Seeing()
    text = plan(D, *base)
    return D.bound(spark, text) if Seeing.MARK in text else plan(SPARK, *base)


def run(spark: SparkSession, sf_dir: str, plan: str) -> DataFrame:
    """A plan over the Parquet tables in sf_dir. Tables are named in the text by their paths, so that nothing is registered in the session."""
    text = bound(spark, (PLANS | INNER)[plan])
    if SPARK.TASKS in text:
        # A clause costs far more than its row: neither input splits nor a join's partitions, which go by bytes, would keep all cores busy to the end.
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
        text = text.replace(SPARK.TASKS, str(max(spark.sparkContext.defaultParallelism, -(-rows // CLAUSES_A_TASK))))
    for table in TABLES:
        path = f"parquet.`{sf_dir}/{table}.parquet`"
        text = re.sub(rf"\b(FROM|JOIN) {table}\b", lambda m, p=path: f"{m[1]} {p}", text)
    return spark.sql(text).drop("seen")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, plan=name) for name in PLANS}


def oracle_sql() -> dict[str, str]:
    return {name: plan(DUCK) for name, plan in PLANS.items()}
