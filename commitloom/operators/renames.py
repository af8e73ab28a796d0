"""Rename chains over a commit log whose order is ``seq`` (0 = newest)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.session import checkpoint


def newest_renames(changes: DataFrame) -> DataFrame:
    """For each old path the first rename in log order; older ones lose."""
    key = F.struct("seq", "pos", "path")
    return (
        changes.where((F.col("status") == "R") & F.col("old_path").isNotNull())
        .groupBy("repo_id", "old_path")
        .agg(F.min(key).alias("r"))
        .select(
            "repo_id",
            F.col("old_path").alias("old"),
            F.col("r.seq").alias("seq"),
            F.col("r.pos").alias("pos"),
            F.col("r.path").alias("target"),
        )
    )


def _link(renames: DataFrame) -> DataFrame:
    """Add ``link``: the old path whose alias continues this one, or null.

    A chain goes on only through an alias that was already known, that is one
    with a smaller ``(seq, pos)``. The links therefore form a forest.
    """
    following = renames.select(
        "repo_id",
        F.col("old").alias("target"),
        F.struct("seq", "pos").alias("_next_key"),
    )
    known = F.col("_next_key") < F.struct("seq", "pos")
    return renames.join(following, ["repo_id", "target"], "left").select(
        "repo_id", "old", "seq", "target",
        F.when(known, F.col("target")).alias("link"),
    )


def _follow(rows: DataFrame) -> DataFrame:
    """Every open row jumps to the end of the row it links to."""
    ends = rows.select(
        "repo_id",
        F.col("old").alias("link"),
        F.col("target").alias("_target"),
        F.col("link").alias("_link"),
    )
    moved = (
        rows.where(F.col("link").isNotNull())
        .join(ends, ["repo_id", "link"])
        .select(
            "repo_id", "old", "seq",
            F.col("_target").alias("target"), F.col("_link").alias("link"),
        )
    )
    return rows.where(F.col("link").isNull()).unionByName(moved)


def close_chains(renames: DataFrame) -> DataFrame:
    """``aliases(repo_id, old, seq, target)`` with every chain followed to its end.

    Pointer doubling, two jumps per stored round: a chain of n renames needs
    log4(n) rounds.
    """
    rows = checkpoint(_follow(_link(renames)))
    while not rows.where(F.col("link").isNotNull()).isEmpty():
        rows = checkpoint(_follow(_follow(rows)))
    return rows.drop("link")


def aliases(changes: DataFrame) -> DataFrame:
    return close_chains(newest_renames(changes))
