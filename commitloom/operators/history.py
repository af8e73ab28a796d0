"""Commit activity of files and modules inside an analysis window.

``commits(repo_id, seq, hash, committed_at, author_email)`` with
``committed_at`` in unix seconds, and
``changes(repo_id, seq, pos, status, path, old_path)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.functions import fixed_values as fv
from commitloom.functions import measures
from commitloom.operators import renames
from commitloom.operators.skew import per_repo_join, spread_join
from commitloom.operators.warnings import count_warnings, union_warnings
from commitloom.options import Options


def log_since(commits: DataFrame, options: Options) -> DataFrame:
    """Commits not older than the window; newer than its end ones stay, for renames."""
    return commits.where(F.col("committed_at") >= F.lit(options.since)).withColumn(
        "author_email", F.lower("author_email")
    )


def in_window(commits: DataFrame, options: Options) -> DataFrame:
    return log_since(commits, options).where(F.col("committed_at") <= options.until)


def repo_totals(commits: DataFrame, options: Options) -> DataFrame:
    """Commits inside the window, changeless ones too, and the newest instant."""
    return (
        in_window(commits, options)
        .groupBy("repo_id")
        .agg(
            F.count("*").alias("commits"),
            F.max("committed_at").alias("last_commit_at"),
        )
    )


def dated_renames(commits: DataFrame, changes: DataFrame, options: Options) -> DataFrame:
    """The renames of the read part of the log; few rows, so no salt."""
    read = log_since(commits, options).select("repo_id", "seq")
    return changes.where(F.col("status") == "R").join(read, ["repo_id", "seq"])


def dated_changes(commits: DataFrame, changes: DataFrame, options: Options) -> DataFrame:
    """Changes of the read part of the log with instant and author."""
    attributes = log_since(commits, options).select(
        "repo_id", "seq", "committed_at", "author_email"
    )
    return spread_join(
        changes, attributes, ["repo_id", "seq"], spread=["path", "pos"], profile=changes
    )


def path_dictionary(universe: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """What a path of the log may mean: itself, or the file it was renamed to.

    ``self`` and ``renamed`` are ``(path, id, parent, module)`` structs; the
    rename applies to changes older than ``alias_seq``.
    """
    files = universe.where(F.col("kind") == "file").select("repo_id", "path", "id", "parent")
    modules = universe.where(F.col("kind") == "module").select(
        "repo_id", F.col("id").alias("parent"), F.col("id").alias("module")
    )
    known = files.join(modules, ["repo_id", "parent"], "left")
    entry = F.struct("path", "id", "parent", "module")
    own = known.select("repo_id", "path", entry.alias("self"))
    ends = own.select("repo_id", F.col("path").alias("target"), F.col("self").alias("end"))
    outside = F.struct(
        F.col("target").alias("path"),
        *[F.lit(None).cast("string").alias(c) for c in ("id", "parent", "module")],
    )
    renamed = alias_rows.join(ends, ["repo_id", "target"], "left").select(
        "repo_id",
        F.col("old").alias("path"),
        F.col("seq").alias("alias_seq"),
        F.coalesce("end", outside).alias("renamed"),
    )
    return own.join(renamed, ["repo_id", "path"], "full")


def touches(
    dated: DataFrame, dictionary: DataFrame, options: Options, changes: DataFrame
) -> DataFrame:
    """One row per in-window commit and distinct present-day path.

    ``id`` is null outside the universe; ``module`` is null where the parent is
    missing or is no module. ``pos`` is the first position of the path.
    ``changes`` is the stored table ``dated`` comes from.
    """
    windowed = dated.where(F.col("committed_at") <= options.until).select(
        "repo_id", "seq", "pos", "path", "committed_at", "author_email"
    )
    looked_up = spread_join(
        windowed, dictionary, ["repo_id", "path"], "left", spread=["seq"], profile=changes
    )
    # strictly newer: a commit's own renames do not apply to it
    unknown = F.struct(
        F.col("path").alias("path"),
        *[F.lit(None).cast("string").alias(c) for c in ("id", "parent", "module")],
    )
    meaning = F.when(F.col("alias_seq") < F.col("seq"), F.col("renamed")).otherwise(
        F.coalesce("self", unknown)
    )
    return (
        looked_up.withColumn("m", meaning)
        .groupBy(
            "repo_id", "seq", "committed_at", "author_email",
            F.col("m.path").alias("path"), F.col("m.id").alias("id"),
            F.col("m.parent").alias("parent"), F.col("m.module").alias("module"),
        )
        .agg(F.min("pos").alias("pos"))
    )


def resolve_history(
    universe: DataFrame, commits: DataFrame, changes: DataFrame, options: Options
) -> DataFrame:
    """Window, renames and universe applied to the log: see :func:`touches`."""
    dated = dated_changes(commits, changes, options)
    alias_rows = renames.aliases(dated_renames(commits, changes, options))
    dictionary = path_dictionary(universe, alias_rows)
    return touches(dated, dictionary, options, changes)


def _activity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo_id", "id").agg(
        F.count("*").alias("commits"),
        F.countDistinct("author_email").alias("authors"),
        F.max("committed_at").alias("last_changed_at"),
    )


def file_activity(touched: DataFrame) -> DataFrame:
    return _activity(touched.where(F.col("id").isNotNull()))


def module_activity(touched: DataFrame) -> DataFrame:
    """A commit on several files of a module counts once for the module."""
    once = (
        touched.where(F.col("module").isNotNull())
        .select("repo_id", F.col("module").alias("id"), "seq", "author_email", "committed_at")
        .distinct()
    )
    return _activity(once)


def node_activity(universe: DataFrame, touched: DataFrame) -> DataFrame:
    """Every node of the universe with its counts; zeros where nothing touched it."""
    measured = file_activity(touched).unionByName(module_activity(touched))
    return universe.join(measured, ["repo_id", "id"], "left").withColumns(
        {
            "commits": F.coalesce("commits", F.lit(0).cast("long")),
            "authors": F.coalesce("authors", F.lit(0).cast("long")),
        }
    )


def p95_by_kind(activity: DataFrame) -> DataFrame:
    """Nearest-rank 95th percentile of commits over the active nodes of a kind."""
    rank = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY commits)")
    return (
        activity.where(F.col("commits") >= 1)
        .groupBy("repo_id", "kind")
        .agg(rank.cast("long").alias("p95"))
    )


def with_churn(activity: DataFrame) -> DataFrame:
    p95 = p95_by_kind(activity)
    joined = per_repo_join(activity, p95, ["repo_id", "kind"], "left", spread=["id"])
    scaled = measures.churn(F.col("commits"), F.coalesce("p95", F.lit(0)))
    return joined.withColumn("churn", scaled).drop("p95")


def hot_spots(nodes: DataFrame, threshold: float = fv.HOT_CHURN) -> DataFrame:
    return nodes.where(F.col("churn") >= F.lit(threshold))


def history_warnings(
    touched: DataFrame, commits: DataFrame, options: Options
) -> DataFrame:
    """Paths outside the universe, bulk commits and parents that are no module."""
    place = F.struct("seq", "pos", "path")
    outside = count_warnings(
        touched.where(F.col("id").isNull()),
        "history", "path-outside-universe", F.col("path"), place,
    )
    orphan = count_warnings(
        touched.where(F.col("parent").isNotNull() & F.col("module").isNull()),
        "history", "unknown-module-parent", F.col("parent"), place,
    )
    bulk = (
        touched.groupBy("repo_id", "seq")
        .agg(F.count("*").alias("paths"))
        .where(F.col("paths") > options.bulk_paths)
        .join(commits.select("repo_id", "seq", "hash"), ["repo_id", "seq"])
    )
    skipped = count_warnings(
        bulk, "history", "bulk-commit-skipped", F.col("hash"), F.col("seq")
    )
    return union_warnings(outside, skipped, orphan)
