"""The whole analysis of a fleet of repositories, from inputs to tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.functions.globs import matches_any
from commitloom.operators import (
    cochange, history, python_imports, quality, resolution, scan, script_imports,
)
from commitloom.operators.warnings import union_warnings
from commitloom.options import Options
from commitloom.session import checkpoint


@dataclass(frozen=True)
class Analysis:
    nodes: DataFrame
    edges: DataFrame
    cochanges: DataFrame
    repo_stats: DataFrame
    warnings: DataFrame


def merge_nodes(universe: DataFrame, activity: DataFrame) -> DataFrame:
    """Structure and history side by side; the description columns stay empty."""
    measured = activity.select(
        "repo_id", "id", "churn", "commits", "authors", "last_changed_at"
    )
    zero = F.lit(0).cast("long")
    return universe.join(measured, ["repo_id", "id"], "left").select(
        "repo_id", "id", "kind", "parent", "path", "layer", "loc",
        F.coalesce("churn", F.lit(0.0)).alias("churn"),
        F.coalesce("commits", zero).alias("commits"),
        F.coalesce("authors", zero).alias("authors"),
        "last_changed_at",
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("description_source"),
    )


def read_contents(files: DataFrame, options: Options) -> DataFrame:
    """One pass over the contents: measures, script specifiers, settings files.

    Excluded files stay, as paths only: an import may name them.
    """
    path, content = F.col("path"), F.col("content")
    excluded = matches_any(path, options.excludes, subtree=True)
    settings = script_imports.is_settings(path, content)
    wanted = files.withColumn("excluded", excluded).withColumn(
        "content", F.when(~F.col("excluded") | settings, content)
    )
    return scan.measure_files(
        wanted, options,
        excluded=F.col("excluded"),
        settings=F.when(settings, content),
        specifiers=F.when(
            script_imports.is_script(path), script_imports.specifiers_of(content)
        ),
        unparsable=script_imports.is_script(path) & script_imports.is_unparsable(content),
    )


def analyze(
    files: DataFrame,
    commits: DataFrame,
    changes: DataFrame,
    options: Options,
    inventory: DataFrame | None = None,
) -> Analysis:
    """Scan, history and imports of every repository in the input tables.

    Contents are read twice, once in the JVM and once for Python syntax. What
    several stages use is written once: measured files, universe, touched
    paths, read and resolved imports.
    """
    read = checkpoint(read_contents(files, options))
    listed = read.where(~F.col("excluded"))
    measured = listed.drop("excluded", "settings", "specifiers", "unparsable")
    kept = scan.drop_data_blobs(measured, options)
    universe = checkpoint(scan.universe(scan.assign_modules(kept)))
    touched = checkpoint(history.resolve_history(universe, commits, changes, options))
    disk = read.select("repo_id", "path", F.col("settings").alias("content"))
    python = checkpoint(
        python_imports.extract(scan.exclude_paths(files, options.excludes))
    )
    scripts = script_imports.resolve(
        script_imports.explode_specifiers(listed), disk, universe
    )
    resolutions = checkpoint(
        scripts.unionByName(python_imports.resolve(python_imports.imports(python), universe))
    )

    activity = history.with_churn(checkpoint(history.node_activity(universe, touched)))
    logged = history.repo_totals(commits, options)
    stats = (
        scan.totals(kept)
        .join(scan.language_map(scan.language_shares(kept)), "repo_id", "left")
        .join(logged, "repo_id", "left")
        .select(
            "repo_id", "files", "loc",
            F.coalesce("commits", F.lit(0).cast("long")).alias("commits"),
            "last_commit_at",
            F.coalesce("languages", F.create_map().cast("map<string,double>")).alias("languages"),
        )
    )
    unparsable = python_imports.unparsable(python).unionByName(
        listed.where("unparsable").select("repo_id", F.col("path").alias("source"))
    ).unionByName(script_imports.unreadable_configs(disk))
    warnings = [
        scan.scan_warnings(measured, options),
        history.history_warnings(touched, commits, options),
        resolution.import_warnings(resolutions, unparsable),
    ]
    if inventory is not None:
        warnings.append(scan.inventory_warnings(inventory))
    return Analysis(
        nodes=merge_nodes(universe, activity),
        edges=resolution.all_edges(resolutions, universe),
        cochanges=cochange.cochanges(touched, options),
        repo_stats=stats,
        warnings=union_warnings(*warnings),
    )


def enrich(analysis: Analysis, hook: Callable[[DataFrame], DataFrame]) -> Analysis:
    """Run a user function over the node table; its result must keep the contract."""
    before = analysis.nodes
    problem = quality.node_ranges(before).first()
    if problem is not None:
        raise ValueError(f"the nodes break the contract: {problem.path} {problem.message}")
    nodes = checkpoint(before.transform(hook))
    if nodes.dtypes != before.dtypes:
        raise ValueError(f"the hook changed the node columns to {nodes.dtypes}")
    problem = quality.node_ranges(nodes).first()
    if problem is not None:
        raise ValueError(f"the hook broke the contract: {problem.path} {problem.message}")
    # identity is not the hook's to change: the same nodes, each once, with their kind and parent
    identity = ["repo_id", "id", "kind", "parent"]
    change = quality.differences(before.select(identity), nodes.select(identity)).first()
    if change is not None:
        raise ValueError(f"the hook lost, added or moved a node: {change.repo_id} {change.id}")
    return replace(analysis, nodes=nodes)
