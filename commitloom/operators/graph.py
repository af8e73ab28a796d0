"""Queries over the import graph, for all focus nodes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with two known endpoints of one kind; adds ``level``."""
    kinds = nodes.select("repo_id", "id", "kind")
    sources = kinds.select("repo_id", F.col("id").alias("source"), F.col("kind").alias("level"))
    targets = kinds.select("repo_id", F.col("id").alias("target"), F.col("kind").alias("_other"))
    with_source = edges.join(sources, ["repo_id", "source"])
    with_both = with_source.join(targets, ["repo_id", "target"])
    return with_both.where(F.col("level") == F.col("_other")).drop("_other")


def neighbours(valid: DataFrame) -> DataFrame:
    """Distinct one-hop neighbours, direction dropped."""
    there = valid.select("repo_id", F.col("source").alias("id"), F.col("target").alias("other"), "level")
    back = valid.select("repo_id", F.col("target").alias("id"), F.col("source").alias("other"), "level")
    return there.unionByName(back).distinct()


def members(nodes: DataFrame) -> DataFrame:
    """Files of the modules the table knows: ``(repo_id, module, id)``."""
    modules = nodes.where(F.col("kind") == "module").select("repo_id", F.col("id").alias("module"))
    files = nodes.where((F.col("kind") == "file") & F.col("parent").isNotNull()).select(
        "repo_id", F.col("parent").alias("module"), "id"
    )
    return files.join(modules, ["repo_id", "module"])


def member_counts(nodes: DataFrame) -> DataFrame:
    return (
        nodes.where(F.col("parent").isNotNull())
        .groupBy("repo_id", F.col("parent").alias("id"))
        .agg(F.count("*").alias("members"))
    )


def one_hop(foci: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Each focus with its neighbours; an ``unfolded`` module adds its files.

    ``foci(repo_id, focus, unfolded)``; unknown ids give no rows.
    """
    ids = nodes.select("repo_id", F.col("id").alias("focus"))
    known = foci.join(ids, ["repo_id", "focus"])
    own = known.select("repo_id", "focus", F.col("focus").alias("id"))
    hops = near.select(
        "repo_id", F.col("id").alias("focus"), F.col("other").alias("id")
    ).join(known.select("repo_id", "focus"), ["repo_id", "focus"])
    held = members(nodes).withColumnRenamed("module", "focus")
    unfolded = known.where("unfolded").select("repo_id", "focus")
    inside = held.join(unfolded, ["repo_id", "focus"])
    return own.unionByName(hops).unionByName(inside).distinct()


def scopes(foci: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Each focus module with its files and its neighbouring modules.

    A focus that is not a module has an empty scope.
    """
    modules = nodes.where(F.col("kind") == "module").select("repo_id", F.col("id").alias("focus"))
    known = foci.select("repo_id", "focus").join(modules, ["repo_id", "focus"])
    own = known.select("repo_id", "focus", F.col("focus").alias("id"))
    held = members(nodes).withColumnRenamed("module", "focus")
    inside = held.join(known, ["repo_id", "focus"])
    beside = near.where(F.col("level") == "module").select(
        "repo_id", F.col("id").alias("focus"), F.col("other").alias("id")
    )
    around = beside.join(known, ["repo_id", "focus"])
    return own.unionByName(inside).unionByName(around).distinct()


def lift_edges(valid: DataFrame, nodes: DataFrame) -> DataFrame:
    """Top-level links: module edges, and file edges that touch a root file.

    A module's file stands for its module, a root file for itself.
    """
    files = nodes.where(F.col("kind") == "file").select(
        "repo_id", "id",
        F.coalesce("parent", "id").alias("top"), F.col("parent").isNull().alias("root"),
    )
    modules = valid.where(F.col("level") == "module").select("repo_id", "source", "target")
    pairs = valid.where(F.col("level") == "file").select("repo_id", "source", "target")
    ends = lambda name: files.select(
        "repo_id", F.col("id").alias(name),
        F.col("top").alias(f"_{name}"), F.col("root").alias(f"_{name}_root"),
    )
    lifted = pairs.join(ends("source"), ["repo_id", "source"]).join(
        ends("target"), ["repo_id", "target"]
    )
    touching = lifted.where(F.col("_source_root") | F.col("_target_root")).select(
        "repo_id", F.col("_source").alias("source"), F.col("_target").alias("target")
    )
    return (
        modules.unionByName(touching).where(F.col("source") != F.col("target")).distinct()
    )


def filter_layers(
    nodes: DataFrame, edges: DataFrame, layers: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept nodes, edges with both ends kept, and hidden nodes per repository."""
    shown = F.col("layer").isin(*layers)
    kept = nodes.where(shown)
    ids = kept.select("repo_id", "id")
    half = edges.join(ids.withColumnRenamed("id", "source"), ["repo_id", "source"])
    whole = half.join(ids.withColumnRenamed("id", "target"), ["repo_id", "target"])
    hidden = nodes.groupBy("repo_id").agg(
        F.count_if(~shown).alias("hidden"), F.count_if(shown).alias("visible")
    )
    return kept, whole, hidden


def edgeless(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no import edge touches."""
    touched = (
        edges.select("repo_id", F.col("source").alias("id"))
        .unionByName(edges.select("repo_id", F.col("target").alias("id")))
        .distinct()
    )
    return nodes.where(F.col("kind") == "file").join(touched, ["repo_id", "id"], "left_anti")


def unpaired(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes that are in no co-change pair."""
    touched = (
        pairs.select("repo_id", F.col("a").alias("id"))
        .unionByName(pairs.select("repo_id", F.col("b").alias("id")))
        .distinct()
    )
    return nodes.join(touched, ["repo_id", "id"], "left_anti")


def connected(candidates: DataFrame, near: DataFrame) -> DataFrame:
    """What is left after edgeless nodes are removed until none remains.

    Two passes reach the fixpoint: removing a node without neighbours takes no
    neighbour from anybody, so only a module's last member can pull it along.
    """
    ids = candidates.select("repo_id", "id")
    half = near.select("repo_id", "id", "other").join(ids, ["repo_id", "id"])
    linked = (
        half.join(ids.withColumnRenamed("id", "other"), ["repo_id", "other"])
        .select("repo_id", "id")
        .distinct()
    )
    files = candidates.where(F.col("kind") == "file").join(linked, ["repo_id", "id"], "left_semi")
    modules = candidates.where(F.col("kind") == "module")
    holding = files.select("repo_id", F.col("parent").alias("id")).distinct()
    alive = linked.unionByName(holding).distinct()
    return files.unionByName(modules.join(alive, ["repo_id", "id"], "left_semi"))


def visible(
    nodes: DataFrame,
    near: DataFrame,
    layers: Sequence[str],
    scope: DataFrame | None = None,
    connected_only: bool = True,
    materialised: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes in view, and per repository how many each cause hides.

    ``scope(repo_id, id)`` comes from :func:`scopes` for one focus; layers
    narrow next, uncounted here. Edgeless nodes are counted over those
    candidates, while the view is narrowed to ``materialised(repo_id, id)``,
    the nodes that can be drawn, before they are removed from it.
    """
    in_scope = nodes if scope is None else nodes.join(scope, ["repo_id", "id"], "left_semi")
    candidates = in_scope.where(F.col("layer").isin(*layers))
    kept = connected(candidates, near) if connected_only else candidates
    shown = kept
    if materialised is not None:
        drawable = candidates.join(materialised, ["repo_id", "id"], "left_semi")
        shown = connected(drawable, near) if connected_only else drawable
    count = lambda df, name: df.groupBy("repo_id").agg(F.count("*").alias(name))
    total = count(nodes, "total")
    zero = F.lit(0).cast("long")
    hidden = (
        total.join(count(in_scope, "scoped"), "repo_id", "left")
        .join(count(candidates, "candidates"), "repo_id", "left")
        .join(count(kept, "kept"), "repo_id", "left")
        .join(count(shown, "shown"), "repo_id", "left")
        .select(
            "repo_id",
            (F.col("total") - F.coalesce("scoped", zero)).alias("hidden_by_scope"),
            (F.coalesce("candidates", zero) - F.coalesce("kept", zero)).alias("hidden_by_degree"),
            F.coalesce("shown", zero).alias("visible"),
        )
    )
    return shown, hidden


def file_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In and out degree of every file over file edges, self-edges skipped."""
    valid = valid_edges(edges.where(F.col("source") != F.col("target")), nodes)
    ends = valid.where(F.col("level") == "file").select(
        "repo_id",
        F.inline(
            F.array(
                F.struct(F.col("source").alias("id"), F.lit(0).alias("in"), F.lit(1).alias("out")),
                F.struct(F.col("target").alias("id"), F.lit(1).alias("in"), F.lit(0).alias("out")),
            )
        ),
    )
    degrees = ends.groupBy("repo_id", "id").agg(
        F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree")
    )
    zero = F.lit(0).cast("long")
    return (
        nodes.where(F.col("kind") == "file")
        .join(degrees, ["repo_id", "id"], "left")
        .withColumns(
            {
                "in_degree": F.coalesce("in_degree", zero),
                "out_degree": F.coalesce("out_degree", zero),
            }
        )
    )


