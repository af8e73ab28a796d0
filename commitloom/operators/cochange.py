"""Files and modules that change in the same commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitloom.functions import fixed_values as fv
from commitloom.operators.skew import placed, ranked
from commitloom.options import Options


def _lists(touched: DataFrame, options: Options) -> DataFrame:
    """Per commit and kind the sorted ids that can be in a pair, bulk commits left out.

    Ranking one past the limit tells a bulk commit from a small one while no
    task ever holds more than that many rows per commit and part. An id that
    fewer commits than the least pair count name is in no pair; it goes before
    any pair is made, but after its commit was judged by all its paths.
    """
    limit, commit = options.bulk_paths, ["place", "repo_id", "seq"]
    paths = placed(touched.select("repo_id", "seq", "path", "id", "module"), ["repo_id", "seq"])
    first = ranked(paths, commit, ["path"], limit + 1, "_n", spread=["path"])
    small = first.withColumn("_paths", F.max("_n").over(Window.partitionBy(*commit))).where(F.col("_paths") <= limit)
    named = F.array(
        F.struct(F.lit("file").alias("kind"), F.col("id").alias("id")),
        F.struct(F.lit("module").alias("kind"), F.col("module").alias("id")),
    )
    members = small.select("repo_id", "seq", F.inline(named)).where("id IS NOT NULL")
    # a module counts once for each of its files, which keeps more than needed and drops none
    frequent = members.groupBy("repo_id", "kind", "id").agg(F.count("*").alias("_commits")).where(
        F.col("_commits") >= options.min_pair_count
    )
    key = ["repo_id", "kind", "id"]
    kept = placed(members, key).join(placed(frequent.drop("_commits"), key), ["place", *key], "left_semi").drop("place")
    return kept.groupBy("repo_id", "seq", "kind").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def paired_commits(touched: DataFrame, options: Options) -> DataFrame:
    """Per commit its sorted file and module ids that can be in a pair, bulk commits left out."""
    of_kind = lambda kind: F.coalesce(
        F.max(F.when(F.col("kind") == kind, F.col("ids"))), F.array().cast("array<string>")
    )
    return _lists(touched, options).groupBy("repo_id", "seq").agg(
        of_kind("file").alias("files"), of_kind("module").alias("modules")
    )


def pair_counts(touched: DataFrame, options: Options) -> DataFrame:
    """Shared commits of every same-kind pair that reaches the minimum."""
    first = _lists(touched, options).where(F.size("ids") > 1).select(
        "repo_id", "kind", "ids", F.posexplode("ids").alias("at", "a")
    )
    return (
        first.select("repo_id", "kind", "a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
        .groupBy("repo_id", "kind", "a", "b")
        .agg(F.count("*").alias("count"))
        .where(F.col("count") >= options.min_pair_count)
    )


def strongest_pairs(pairs: DataFrame, limit: int = fv.MAX_PAIRS_PER_KIND) -> DataFrame:
    """The strongest pairs per repository and kind: count, then ids."""
    order = [F.desc("count"), "a", "b"]
    return ranked(pairs, ["repo_id", "kind"], order, limit, "_n", spread=["a", "b"]).drop("_n")


def cochanges(touched: DataFrame, options: Options) -> DataFrame:
    return strongest_pairs(pair_counts(touched, options), options.max_pairs)


def partners(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Pairs seen from both ends: ``(repo_id, kind, id, partner, count)``.

    With ``nodes``, only partners of the node's own kind remain.
    """
    seen = pairs.select("repo_id", F.col("a").alias("id"), F.col("b").alias("partner"), "count")
    back = pairs.select("repo_id", F.col("b").alias("id"), F.col("a").alias("partner"), "count")
    both = seen.unionByName(back)
    if nodes is None:
        return both
    kinds = nodes.select("repo_id", "id", "kind")
    other = nodes.select("repo_id", F.col("id").alias("partner"), "kind")
    return both.join(kinds, ["repo_id", "id"]).join(other, ["repo_id", "partner", "kind"])


def top_partners(partner_rows: DataFrame, limit: int = fv.PARTNER_LIMIT) -> DataFrame:
    order = Window.partitionBy("repo_id", "id").orderBy(F.desc("count"), "partner")
    return partner_rows.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= limit
    )


def hidden_cochanges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that change together without importing each other in any direction."""
    linked = edges.select(
        "repo_id",
        F.least("source", "target").alias("a"),
        F.greatest("source", "target").alias("b"),
    )
    return pairs.join(linked, ["repo_id", "a", "b"], "left_anti")
