"""Fuzzy path search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitloom.functions import fixed_values as fv
from commitloom.functions import text


def search(
    nodes: DataFrame, queries: Sequence[str], limit: int = fv.SEARCH_LIMIT
) -> DataFrame:
    """The best matches per repository and query, ties by path.

    The queries are a list typed by a user; blank ones give no rows, as
    does a null path. A path is repeated only for the queries that it may match, so
    characters are placed and scored for few pairs. Ranks are cut inside each map task
    first, so a broad query stays cheap.
    """
    wanted = [q.strip() for q in dict.fromkeys(queries) if q.strip()]
    if not wanted:
        wanted_rows = nodes.limit(0).withColumn("query", F.lit(""))
    else:
        fitting = F.array(*[F.when(text.may_match(F.col("path"), q), F.lit(q)) for q in wanted])
        wanted_rows = nodes.withColumn("query", F.explode(F.array_compact(fitting)))
    scored = (
        wanted_rows.select("repo_id", "query", "id", "path")
        .withColumn("positions", text.match_positions(F.col("path"), F.col("query")))
        .where(F.col("positions").isNotNull())
        .withColumn(
            "score",
            text.match_score(F.col("path"), F.col("query"), F.col("positions")) / 100.0,
        )
    )
    order = Window.partitionBy("repo_id", "query").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= limit
    )
