"""Counted drops: one row per repository, stage and code, with a first example."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_warnings(
    rows: DataFrame, stage: str, code: Column | str, detail: Column, order: Column
) -> DataFrame:
    """Count rows per code and keep the detail of the first row by ``order``."""
    code = F.lit(code) if isinstance(code, str) else code
    tagged = rows.select(
        "repo_id",
        F.lit(stage).alias("stage"),
        code.alias("code"),
        detail.alias("detail"),
        order.alias("_order"),
    )
    return (
        tagged.groupBy("repo_id", "stage", "code")
        .agg(
            F.count("*").alias("count"),
            F.min(F.struct("_order", "detail")).alias("_first"),
        )
        .select("repo_id", "stage", "code", "count", F.col("_first.detail").alias("detail"))
    )


def union_warnings(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
