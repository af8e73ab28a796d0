"""Rankings and per-node reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom.functions import fixed_values as fv
from commitloom.functions import measures, text
from commitloom.functions.paths import basename
from commitloom.operators import cochange, graph
from commitloom.operators.skew import per_repo_join


def reading_order(
    nodes: DataFrame, edges: DataFrame, limit: int = fv.READING_ORDER_LIMIT
) -> DataFrame:
    """The top files per category, with each category's size.

    ``core``: imported files by importers times lines; ``entry-points``: files
    that import but are not imported; ``tests``: test files by imports.
    """
    degrees = graph.file_degrees(edges, nodes)
    is_test = F.col("layer") == "test"
    category = (
        F.when(is_test, "tests")
        .when(F.col("in_degree") > 0, "core")
        .when(F.col("out_degree") > 0, "entry-points")
    )
    is_core = F.col("category") == "core"
    ranked = (
        degrees.withColumn("category", category)
        .where(F.col("category").isNotNull())
        .select(
            "repo_id", "category", "id", "path", basename(F.col("path")).alias("name"),
            "layer", "loc", "in_degree", "out_degree",
            F.when(is_core, F.col("in_degree") * F.col("loc"))
            .otherwise(F.col("out_degree")).alias("metric"),
            F.when(
                is_core,
                F.concat_ws(
                    " · ",
                    text.counted(F.col("in_degree"), "importer"),
                    text.counted(F.col("loc"), "line"),
                ),
            ).otherwise(text.counted(F.col("out_degree"), "import")).alias("metric_label"),
        )
    )
    sizes = ranked.groupBy("repo_id", "category").agg(F.count("*").alias("total"))
    order = Window.partitionBy("repo_id", "category").orderBy(F.desc("metric"), "id")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    # both sides hold a few rows per repository
    return top.join(sizes, ["repo_id", "category"])


def display_name(kind: Column, id_: Column, path: Column) -> Column:
    return F.when(kind == "module", id_).otherwise(
        F.coalesce(F.nullif(basename(path), F.lit("")), path)
    )


def no_change_caption(days: Column) -> Column:
    return F.format_string("no change in last %d days", days)


def no_commits_caption(days: Column) -> Column:
    return F.format_string("no commits in the last %d days", days)


def no_partner_caption(days: Column, minimum: int = fv.MIN_PAIR_COUNT) -> Column:
    return F.format_string(
        f"nothing changed with it in {minimum} or more commits of the last %d days", days
    )


def notice(repo_commits: Column, last_changed_at: Column) -> Column:
    """A quiet repository is stated before a quiet node."""
    return F.when(repo_commits == 0, "repo-zero-history").when(
        last_changed_at.isNull(), "node-out-of-window"
    )


def node_report(
    nodes: DataFrame, pairs: DataFrame, repos: DataFrame, now: int
) -> DataFrame:
    """One display row per node.

    ``repos(repo_id, remote_url, default_branch, window_days, commits)``;
    ``now`` is unix seconds.
    """
    with_repo = per_repo_join(nodes, repos.withColumnRenamed("commits", "repo_commits"),
                              ["repo_id"], spread=["id"])
    counted = with_repo.join(graph.member_counts(nodes), ["repo_id", "id"], "left")
    best = (
        cochange.top_partners(cochange.partners(pairs, nodes))
        .groupBy("repo_id", "id")
        # at most PARTNER_LIMIT rows per node
        .agg(F.sort_array(F.collect_list(F.struct("rank", "partner"))).alias("best"))
    )
    rows = counted.join(best, ["repo_id", "id"], "left")
    is_module = F.col("kind") == "module"
    days = F.col("window_days")
    return rows.select(
        "repo_id", "id",
        display_name(F.col("kind"), F.col("id"), F.col("path")).alias("name"),
        F.concat_ws(" · ", "kind", "layer").alias("kind_line"),
        (F.col("churn") >= fv.HOT_CHURN).alias("hot"),
        F.when(is_module, text.grouped_integer(F.coalesce("members", F.lit(0))))
        .otherwise(text.EMPTY).alias("files"),
        text.grouped_integer(F.col("loc")).alias("loc"),
        text.percent(F.col("churn")).alias("churn"),
        text.grouped_integer(F.col("authors")).alias("authors"),
        F.when(F.col("last_changed_at").isNull(), no_change_caption(days))
        .otherwise(text.relative_time(F.col("last_changed_at"), F.lit(now)))
        .alias("last_change"),
        notice(F.col("repo_commits"), F.col("last_changed_at")).alias("notice"),
        F.concat_ws(
            ", ", F.transform(F.coalesce("best", F.array().cast("array<struct<rank:int,partner:string>>")),
                              lambda b: b["partner"])
        ).alias("partners"),
        text.hosted_node_url(
            F.col("remote_url"), F.col("default_branch"), F.col("path"), F.col("kind")
        ).alias("url"),
    )


def cochange_report(nodes: DataFrame, pairs: DataFrame, repos: DataFrame) -> DataFrame:
    """All partners of every node, strongest first, with the reason for none.

    The pair table is capped per repository and kind, so a node's list is too.
    """
    order = F.struct((-F.col("count")).alias("_o"), F.col("partner"), F.col("count"))
    lists = (
        cochange.partners(pairs, nodes)
        .groupBy("repo_id", "id")
        .agg(F.sort_array(F.collect_list(order)).alias("l"))
    )
    with_repo = per_repo_join(
        nodes.select("repo_id", "id", "kind"),
        repos.select("repo_id", "window_days", F.col("commits").alias("repo_commits")),
        ["repo_id"], spread=["id"],
    )
    none = F.col("l").isNull()
    label = lambda p: F.concat(
        p["partner"], F.lit(" "), text.counted(p["count"], "commit")
    )
    return with_repo.join(lists, ["repo_id", "id"], "left").select(
        "repo_id", "id",
        F.concat(
            F.lit("blast radius · "), F.col("kind"),
            F.format_string("s · last %d days", "window_days"),
        ).alias("caption"),
        F.coalesce(F.size("l"), F.lit(0)).alias("partner_count"),
        F.when(~none, F.array_join(F.transform("l", label), "; ")).alias("partners"),
        F.when(none & (F.col("repo_commits") == 0), "suppressed")
        .when(none, "empty").otherwise("listed").alias("state"),
        F.when(
            none & (F.col("repo_commits") > 0), no_partner_caption(F.col("window_days"))
        ).alias("cause"),
    )


def cold_share(nodes: DataFrame) -> DataFrame:
    """Files without churn, and whether they are the majority."""
    counts = (
        nodes.where(F.col("kind") == "file")
        .groupBy("repo_id")
        .agg(F.count_if(F.col("churn") == 0).alias("cold"), F.count("*").alias("files"))
    )
    share = F.col("cold") / F.col("files")
    return counts.withColumns(
        {"share": share, "mostly_cold": share > fv.MOSTLY_COLD_SHARE}
    )


def size_concentration(nodes: DataFrame) -> DataFrame:
    """How much the largest node of a kind stands out in drawn size."""
    sized = nodes.select(
        "repo_id", "kind", measures.radius(F.col("kind"), F.col("loc")).alias("r")
    )
    # sizes repeat: one row per distinct radius enters the median
    stats = (
        sized.groupBy("repo_id", "kind", "r").agg(F.count("*").alias("n"))
        .groupBy("repo_id", "kind")
        .agg(
            F.max("r").alias("largest"),
            F.percentile("r", 0.5, F.col("n")).alias("median"),
            F.sum(F.col("r") * F.col("r") * F.col("n")).alias("area"),
        )
    )
    ratio = F.col("largest") / F.col("median")
    return stats.select(
        "repo_id", "kind",
        F.round(ratio, 6).alias("radius_ratio"),
        F.round(ratio * ratio, 6).alias("area_ratio"),
        F.round(F.col("largest") * F.col("largest") / F.col("area"), 9).alias("largest_share"),
    )
