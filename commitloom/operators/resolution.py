"""What both import languages share: outcomes, edges, module weights, rates.

``resolutions(repo_id, source, specifier, ord, outcome, target)`` has one row
per file and distinct specifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.functions import fixed_values as fv
from commitloom.operators.warnings import count_warnings, union_warnings

EDGE = "edge"
EXTERNAL = "external-import"
OUTSIDE = "outside-universe-import"
UNRESOLVED = "unresolved-import"
UNPARSABLE = "unparsable-file"


def file_edges(resolutions: DataFrame) -> DataFrame:
    """Distinct file pairs, weight 1."""
    return (
        resolutions.where(F.col("outcome") == EDGE)
        .select("repo_id", "source", "target")
        .distinct()
        .select(
            "repo_id", "source", "target",
            F.lit("import").alias("kind"), F.lit(1).cast("long").alias("weight"),
        )
    )


def module_edges(file_edge_rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Edges between modules; the weight counts the file pairs beneath."""
    parents = universe.where((F.col("kind") == "file") & F.col("parent").isNotNull())
    sources = parents.select("repo_id", F.col("id").alias("source"), F.col("parent").alias("sm"))
    targets = parents.select("repo_id", F.col("id").alias("target"), F.col("parent").alias("tm"))
    pairs = file_edge_rows.select("repo_id", "source", "target").distinct()
    with_source = pairs.join(sources, ["repo_id", "source"])
    with_both = with_source.join(targets, ["repo_id", "target"])
    return (
        with_both.where(F.col("sm") != F.col("tm"))
        .groupBy("repo_id", F.col("sm").alias("source"), F.col("tm").alias("target"))
        .agg(F.count("*").alias("weight"))
        .select("repo_id", "source", "target", F.lit("import").alias("kind"), "weight")
    )


def all_edges(resolutions: DataFrame, universe: DataFrame) -> DataFrame:
    files = file_edges(resolutions)
    return files.unionByName(module_edges(files, universe))


def import_warnings(resolutions: DataFrame, unparsable: DataFrame | None = None) -> DataFrame:
    """Dropped specifiers per outcome, and files that do not parse."""
    dropped = resolutions.where(F.col("outcome") != EDGE)
    rows = count_warnings(
        dropped, "deps", F.col("outcome"),
        F.concat_ws(" in ", "specifier", "source"),
        F.struct("source", "ord", "specifier"),
    )
    if unparsable is None:
        return rows
    broken = count_warnings(
        unparsable, "deps", UNPARSABLE, F.col("source"), F.col("source")
    )
    return union_warnings(rows, broken)


def resolution_rate(resolutions: DataFrame, limit: float = fv.MAX_UNRESOLVED_RATE) -> DataFrame:
    """Unresolved share of what could be an edge, and of all specifiers."""
    counts = resolutions.groupBy("repo_id").agg(
        *[
            F.count_if(F.col("outcome") == outcome).alias(name)
            for outcome, name in (
                (EDGE, "resolved"), (EXTERNAL, "external"),
                (OUTSIDE, "outside"), (UNRESOLVED, "unresolved"),
            )
        ],
        F.count("*").alias("specifiers"),
    )
    capable = F.col("resolved") + F.col("unresolved")
    rate = F.when(capable > 0, F.col("unresolved") / capable).otherwise(0.0)
    of_all = F.when(
        F.col("specifiers") > 0, F.col("unresolved") / F.col("specifiers")
    ).otherwise(0.0)
    return counts.withColumns(
        {"rate": rate, "rate_of_all": of_all, "within_limit": rate <= F.lit(limit)}
    )
