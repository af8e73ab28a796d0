"""From a file inventory to the universe of file and module nodes.

Input ``files(repo_id, path, content)``; a null content means the file could
not be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom.functions import fixed_values as fv
from commitloom.functions import measures
from commitloom.functions.globs import matches_any
from commitloom.functions.paths import prefix
from commitloom.operators.skew import per_repo_join
from commitloom.operators.warnings import count_warnings
from commitloom.options import Options


def exclude_paths(files: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    """Drop paths a glob matches, and everything beneath a matched folder."""
    return files.where(~matches_any(F.col("path"), globs, subtree=True))


def measure_files(files: DataFrame, options: Options, **extra: Column) -> DataFrame:
    """Language, layer, line count and the two read outcomes of every file.

    ``extra`` columns over ``path`` and ``content`` come from the same reading.
    """
    content = F.col("content")
    binary = F.coalesce(measures.is_binary(content), F.lit(False))
    loc = F.when(F.col("is_binary") | F.col("is_unreadable"), F.lit(0)).otherwise(
        measures.line_count(content)
    )
    return files.select(
        "repo_id",
        "path",
        "content",
        content.isNull().alias("is_unreadable"),
        binary.alias("is_binary"),
        *[column.alias(name) for name, column in extra.items()],
    ).select(
        "repo_id",
        "path",
        measures.language(F.col("path")).alias("language"),
        measures.layer(F.col("path"), options.layers).alias("layer"),
        loc.cast("long").alias("loc"),
        "is_binary",
        "is_unreadable",
        *extra,
    )


def is_data_blob(options: Options) -> Column:
    return F.col("language").isin(*fv.DATA_LANGUAGES) & (F.col("loc") > options.blob_loc)


def drop_data_blobs(measured: DataFrame, options: Options) -> DataFrame:
    """Generated data leaves before modules, totals and shares are formed."""
    return measured.where(~is_data_blob(options))


def dominant_folders(files: DataFrame) -> DataFrame:
    """The one top-level folder per repository holding over 70% of its files."""
    per_folder = files.groupBy("repo_id", prefix(F.col("path"), 1).alias("top")).agg(
        F.count("*").alias("n")
    )
    return (
        per_folder.groupBy("repo_id")
        .agg(
            F.sum("n").alias("total"),
            F.max(F.when(F.col("top").isNotNull(), F.struct("n", "top"))).alias("big"),
        )
        .where(F.col("big.n") / F.col("total") > fv.DESCENT_SHARE)
        .select("repo_id", F.col("big.top").alias("dominant"))
    )


def assign_modules(files: DataFrame) -> DataFrame:
    """Add ``parent``: the module id of each file, null for a root file.

    A path has at most two candidate modules, its first segment and, under a
    dominant folder, its first two; the longer one wins.
    """
    path = F.col("path")
    located = per_repo_join(
        files, dominant_folders(files), ["repo_id"], "left", spread=["path"]
    )
    top = prefix(path, 1)
    module = F.when(
        top == F.col("dominant"), F.coalesce(prefix(path, 2), top)
    ).otherwise(top)
    return located.withColumn("parent", F.concat(module, F.lit("/"))).drop("dominant")


def module_nodes(files: DataFrame) -> DataFrame:
    """One node per module: summed lines and the layer with most of them."""
    by_layer = (
        files.where(F.col("parent").isNotNull())
        .groupBy("repo_id", "parent", "layer")
        .agg(F.sum("loc").alias("loc"))
    )
    rank = F.array_position(F.array(*[F.lit(x) for x in fv.LAYERS]), F.col("layer"))
    return by_layer.groupBy("repo_id", "parent").agg(
        F.sum("loc").alias("loc"),
        F.coalesce(
            F.max_by(
                F.when(F.col("loc") > 0, F.col("layer")),
                F.when(F.col("loc") > 0, F.struct("loc", (-rank).alias("rank"))),
            ),
            F.lit(fv.DEFAULT_LAYER),
        ).alias("layer"),
    )


def universe(files: DataFrame) -> DataFrame:
    """Module nodes and file nodes in one table. ``files`` carries ``parent``."""
    modules = module_nodes(files).select(
        "repo_id",
        F.col("parent").alias("id"),
        F.lit("module").alias("kind"),
        F.lit(None).cast("string").alias("parent"),
        F.col("parent").alias("path"),
        "layer",
        "loc",
    )
    leaves = files.select(
        "repo_id", F.col("path").alias("id"), F.lit("file").alias("kind"),
        "parent", "path", "layer", "loc",
    )
    return modules.unionByName(leaves)


def totals(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.sum("loc").alias("loc")
    )


def language_shares(files: DataFrame) -> DataFrame:
    """Share of a repository's lines per language; languages without lines are left out."""
    by_language = files.groupBy("repo_id", "language").agg(F.sum("loc").alias("loc"))
    total = by_language.groupBy("repo_id").agg(F.sum("loc").alias("total"))
    # both sides hold one row per language at most, not one per file
    return (
        by_language.where(F.col("loc") > 0)
        .join(total, "repo_id")
        .select("repo_id", "language", "loc", (F.col("loc") / F.col("total")).alias("share"))
    )


def language_map(shares: DataFrame) -> DataFrame:
    """Shares as one sorted map per repository (at most one entry per language)."""
    entries = F.sort_array(F.collect_list(F.struct("language", "share")))
    return shares.groupBy("repo_id").agg(F.map_from_entries(entries).alias("languages"))


def top_languages(shares: DataFrame, limit: int = fv.LANGUAGE_LIMIT) -> DataFrame:
    """The largest shares as one line, ``python 61% · css 20%``."""
    # at most one row per known language and repository
    rows = F.sort_array(
        F.collect_list(F.struct((-F.col("share")).alias("order"), "language"))
    )
    label = lambda r: F.concat(
        r["language"], F.lit(" "),
        F.floor(-r["order"] * 100 + 0.5).cast("string"), F.lit("%"),
    )
    return shares.groupBy("repo_id").agg(
        F.array_join(F.transform(F.slice(rows, 1, limit), label), " · ").alias("languages")
    )


def scan_warnings(measured: DataFrame, options: Options) -> DataFrame:
    """Unreadable, binary and generated files. Takes the table before the blob cut."""
    code = F.when(F.col("is_unreadable"), "unreadable-file").when(
        F.col("is_binary"), "binary-file"
    )
    code = F.when(is_data_blob(options), "data-blob").otherwise(code)
    hits = measured.withColumn("_code", code).where(F.col("_code").isNotNull())
    return count_warnings(hits, "scan", F.col("_code"), F.col("path"), F.col("path"))


def inventory_warnings(inventory: DataFrame) -> DataFrame:
    """Skipped entries of a listing that knows its ``entry_kind``."""
    code = (
        F.when(F.col("entry_kind") == "symlink", "symlink-skipped")
        .when(F.col("entry_kind") == "other", "irregular-file-skipped")
        .when(F.col("entry_kind") == "unreadable-directory", "unreadable-directory")
    )
    hits = inventory.withColumn("_code", code).where(F.col("_code").isNotNull())
    return count_warnings(hits, "scan", F.col("_code"), F.col("path"), F.col("path"))

