"""The given tables read as repositories.

``orders`` is a commit log and ``lineitem`` its changed paths; ``part`` is the
file tree; ``documents`` are file contents of four repositories; each line item
is also a small source file with one import; ``events`` are event series.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.operators import resolution, scan
from commitloom.options import Options
from commitloom.session import checkpoint, configure, drop, free, run_folder
from commitloom.sources import ranged

REPO = "shop"
OPTIONS = Options(anchor="2000-07-01T00:00:00Z", window_days=1800)
NOW = 1_000_000_000

LAYER_OF_TYPE = {
    "STANDARD": "backend",
    "MEDIUM": "frontend",
    "SMALL": "infra",
    "LARGE": "test",
    "ECONOMY": "other",
}
# Parts of this type are on disk but not in the analysed universe.
UNLISTED_TYPE = "PROMO"
# Files of this module point at a module that no table declares.
UNDECLARED_MODULE = "m24/"


class Tables:
    """The given parquet tables of one folder, read where a query needs them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A result that one query uses several times, computed and written once."""
        if name not in self._stored:
            self._stored[name] = checkpoint(make())
        return self._stored[name]

    def drop(self, name: str) -> None:
        """Delete a stored result that nothing still to be read needs, and the shuffle files behind it."""
        drop(self._stored.pop(name))
        free(self.spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def stem(key: Column) -> Column:
    """Every fortieth part lies at the root, the others in 25 folders."""
    name = F.concat(F.lit("f"), key.cast("string"))
    folder = F.concat(F.lit("m"), (key % 25).cast("string"), F.lit("/"))
    return F.when(key % 40 == 0, name).otherwise(F.concat(folder, name))


def path(key: Column, extension: str = "ts") -> Column:
    return F.concat(stem(key), F.lit(f".{extension}"))


def seconds(instant: Column) -> Column:
    return F.unix_seconds(instant.cast("timestamp"))


# ------------------------------------------------------------------ history


def commits(t: Tables) -> DataFrame:
    return t.orders.select(
        F.lit(REPO).alias("repo_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash"),
        seconds(F.col("o_orderdate")).alias("committed_at"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("@X")).alias("author_email"),
    )


def changes(t: Tables) -> DataFrame:
    """Lines as changes; some quantities mean that the next part's file was renamed."""
    key = F.col("l_partkey")
    renamed = (key % 10 < 3) & (F.col("l_quantity") == key % 10 + 1)
    status = (
        F.when(renamed, "R")
        .when(F.col("l_returnflag") == "A", "A")
        .when(F.col("l_returnflag") == "R", "D")
        .otherwise("M")
    )
    return t.lineitem.select(
        F.lit(REPO).alias("repo_id"),
        F.col("l_orderkey").alias("seq"),
        F.col("l_linenumber").alias("pos"),
        status.alias("status"),
        path(key).alias("path"),
        F.when(renamed, path(key + 1)).alias("old_path"),
    )


# Order keys whose commits are in one log file, and documents in one archive.
LOG_ORDERS, ARCHIVE_DOCUMENTS = 4096, 64


def log_chunks(t: Tables) -> DataFrame:
    """The commits and changes as an exported log, in chunks of some order keys."""
    nul = F.lit("\0")
    change = F.when(
        F.col("status") == "R", F.concat(F.lit("R100"), nul, F.col("old_path"), nul, F.col("path"), nul)
    ).otherwise(F.concat("status", nul, F.col("path"), nul))
    # an order has a handful of lines
    touched = changes(t).groupBy("repo_id", "seq").agg(F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "path", "status", change.alias("text")))), lambda c: c["text"]
        ), "",
    ).alias("changes"))
    head = F.concat(
        F.lit("\x1e"), "hash", F.lit("\x1f"), F.col("committed_at").cast("string"), F.lit("\x1f"), "author_email", nul
    )
    written = commits(t).join(touched, ["repo_id", "seq"], "left").select(
        "repo_id", "seq", F.floor(F.col("seq") / LOG_ORDERS).alias("chunk"),
        F.concat(head, F.coalesce("changes", F.lit(""))).alias("text"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"])
    return written.groupBy("repo_id", "chunk").agg(
        F.encode(F.array_join(ordered, ""), "UTF-8").alias("content")
    )


def new_root(t: Tables) -> str:
    """A folder for files that a query writes and reads back."""
    return ranged.full_path(t.spark, f"{run_folder(t.spark)}/{uuid.uuid4().hex}")


def log_folder(t: Tables) -> str:
    """The log as files below a folder."""
    root = new_root(t)

    def write(batches):
        for batch in batches:
            for repo, chunk, content in zip(batch["repo_id"], batch["chunk"], batch["content"]):
                ranged.write_file(f"{root}/{repo}/{chunk}.log", content)
            yield batch[["chunk"]]

    log_chunks(t).mapInPandas(write, "chunk long").agg(F.count("*")).collect()
    return root


def part_files(t: Tables, extension: str = "ts") -> DataFrame:
    """File nodes of the listed parts, with their module id in ``parent``."""
    key, kind = F.col("p_partkey"), F.col("p_type")
    layer = reduce(
        lambda acc, item: acc.when(kind == item[0], item[1]),
        LAYER_OF_TYPE.items(),
        F.when(F.lit(False), ""),
    )
    return t.part.where(kind != UNLISTED_TYPE).select(
        F.lit(REPO).alias("repo_id"),
        path(key, extension).alias("path"),
        F.when(key % 40 != 0, F.concat(F.lit("m"), (key % 25).cast("string"), F.lit("/")))
        .alias("parent"),
        layer.alias("layer"),
        F.col("p_size").cast("long").alias("loc"),
    )


def universe(t: Tables) -> DataFrame:
    return t.stored(
        "universe",
        lambda: scan.universe(part_files(t)).where(F.col("id") != UNDECLARED_MODULE),
    )


# -------------------------------------------------------------------- edges


def import_pairs(t: Tables) -> DataFrame:
    """Each line item as an import: its part names its supplier-numbered part."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    outcome = (
        F.when(flag == "A", resolution.EXTERNAL)
        .when((flag == "R") & (status == "O"), resolution.EDGE)
        .otherwise(resolution.UNRESOLVED)
    )
    return t.lineitem.select(
        F.lit(REPO).alias("repo_id"),
        path(F.col("l_partkey")).alias("source"),
        path(F.col("l_suppkey")).alias("target"),
        outcome.alias("outcome"),
    )


def edges(t: Tables) -> DataFrame:
    return resolution.all_edges(import_pairs(t), universe(t))


# ----------------------------------------------------------------- contents

SCAN_OPTIONS = Options(anchor=OPTIONS.anchor, blob_loc=10)
# Extensions given to documents, by length.
EXTENSIONS = ("ts", "py", "css", "json", "md", "tf", "test.ts", "unknownext")


def document_path() -> Column:
    source = F.col("source")
    extension = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("n_chars") % 8 + 1).cast("int")
    )
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), extension)
    in_source = F.concat(source, F.lit("/"), name)
    return (
        F.when(source == "src7", F.concat(F.lit("lib/node_modules/"), name))
        .when(F.col("lang") == "de", F.concat(F.lit("packages/"), in_source))
        .when((F.col("lang") == "fr") & (source == "src3"), F.concat(F.lit("src/"), name))
        .when(F.col("lang") == "fr", F.concat(F.lit("src/"), source, F.lit("/deep/"), name))
        .when((F.col("lang") == "es") & (source == "src1"), name)
        .when(source == "src9", F.concat(F.lit("core/Tests/"), name))
        .otherwise(in_source)
    )


def document_rows(t: Tables) -> DataFrame:
    """One repository per language; one source holds binary files."""
    text = F.encode("text", "UTF-8")
    content = F.when(
        F.col("source") == "src5", F.concat(F.unhex(F.lit("00")), text)
    ).otherwise(text)
    return t.documents.select(
        F.col("lang").alias("repo_id"), document_path().alias("path"), content.alias("content"), "doc_id"
    )


def document_files(t: Tables) -> DataFrame:
    return document_rows(t).drop("doc_id")


def archive_folder(t: Tables) -> str:
    """The documents in tar archives below a folder, each with a folder and a symbolic link beside it."""
    import io
    import tarfile

    root = new_root(t)

    def write(key, rows):
        held = io.BytesIO()
        with tarfile.open(fileobj=held, mode="w") as tar:
            for path, content in zip(rows["path"], rows["content"]):
                folder = tarfile.TarInfo("./folder")
                folder.type = tarfile.DIRTYPE
                tar.addfile(folder)
                entry = tarfile.TarInfo("./" + path)
                entry.size = len(content or b"")
                tar.addfile(entry, io.BytesIO(content or b""))
                link = tarfile.TarInfo(path + ".link")
                link.type, link.linkname = tarfile.SYMTYPE, "elsewhere"
                tar.addfile(link)
        ranged.write_file(f"{root}/{key[0]}/{key[1]}.tar", held.getvalue())
        return rows[["number"]].head(1)

    numbered = document_rows(t).withColumn("number", F.floor(F.col("doc_id") / ARCHIVE_DOCUMENTS))
    numbered.groupBy("repo_id", "number").applyInPandas(write, "number long").agg(F.count("*")).collect()
    return root


def listed_documents(t: Tables) -> DataFrame:
    return scan.exclude_paths(document_files(t), SCAN_OPTIONS.excludes)


def measured_documents(t: Tables) -> DataFrame:
    return t.stored(
        "measured", lambda: scan.measure_files(listed_documents(t), SCAN_OPTIONS)
    )


def kept_documents(t: Tables) -> DataFrame:
    return scan.drop_data_blobs(measured_documents(t), SCAN_OPTIONS)


# ------------------------------------------------------------------ imports


def line_stem() -> Column:
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return F.concat(
        F.lit("orders/l"), F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    )


def specifier() -> Column:
    flag, status, key = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_suppkey")
    number = key.cast("string")
    return (
        F.when(flag == "A", F.concat(F.lit("pkg-"), number))
        .when((flag == "R") & (status == "O"), F.concat(F.lit("../"), stem(key)))
        .when(flag == "R", F.concat(F.lit("./missing"), number))
        .when(status == "O", F.concat(F.lit("@/"), stem(key)))
        .otherwise(F.concat(F.lit("@/gone/"), number))
    )


# One config a region: the root one extends two, one of them through a third.
CONFIGS = (
    ("tsconfig.json", '{ "extends": ["./config/other", "./config/base"], /* own */ "compilerOptions": {}, }'),
    ("config/base.json", '\ufeff{ "extends": "./deeper/paths.json", "compilerOptions": { "strict": true, // end\n } }'),
    ("config/deeper/paths.json", '{ "compilerOptions": { "paths": { "@/*": ["../../*"], /* last */ } } }'),
    ("config/other.json", '{ "compilerOptions": { "paths": { "@/*": ["nowhere/*"] } } }'),
    ("docs/tsconfig.json", '{ "extends": "./tsconfig.json", "compilerOptions": {} }'),
)


def script_files(t: Tables) -> DataFrame:
    """All files on disk: one script per line item, the parts, a config per region."""
    spec, form = specifier(), F.col("l_linenumber") % 5
    statement = (
        F.when(form == 0, F.concat(F.lit('import { a, b as c } from "'), spec, F.lit('";')))
        .when(form == 1, F.concat(F.lit("export * from '"), spec, F.lit("'")))
        .when(form == 2, F.concat(F.lit('const m = require("'), spec, F.lit('");')))
        .when(form == 3, F.concat(F.lit("const l = await import('"), spec, F.lit("')")))
        .otherwise(F.concat(F.lit('import type {\n  T, // from "no"\n} from "'), spec, F.lit('"')))
    )
    source = F.concat(
        F.lit('// import x from "./commented"\nconst s = "import y from \'./quoted\'";\n'),
        statement, F.lit("\n/* require('./also') */\n"),
    )
    lines = t.lineitem.select(
        F.lit(REPO).alias("repo_id"), F.concat(line_stem(), F.lit(".ts")).alias("path"),
        F.encode(source, "UTF-8").alias("content"),
    ).distinct()
    parts = t.part.select(
        F.lit(REPO).alias("repo_id"), path(F.col("p_partkey")).alias("path"),
        F.encode(F.lit(""), "UTF-8").alias("content"),
    )
    settings = t.region.select(
        F.lit(REPO).alias("repo_id"),
        F.get(F.array(*[F.lit(name) for name, _ in CONFIGS]), F.col("r_regionkey")).alias("path"),
        F.encode(
            F.get(F.array(*[F.lit(text) for _, text in CONFIGS]), F.col("r_regionkey")), "UTF-8"
        ).alias("content"),
    )
    return lines.unionByName(parts).unionByName(settings)


def _line_nodes(t: Tables, extension: str) -> DataFrame:
    return t.lineitem.select(
        F.lit(REPO).alias("repo_id"),
        F.concat(line_stem(), F.lit(f".{extension}")).alias("path"),
        F.lit("orders/").alias("parent"),
        F.lit("backend").alias("layer"),
        F.lit(1).cast("long").alias("loc"),
    ).distinct()


def import_universe(t: Tables, extension: str) -> DataFrame:
    """Not stored: resolving reads the files' paths once, and columns nobody reads are never computed."""
    return scan.universe(part_files(t, extension).unionByName(_line_nodes(t, extension)))


def python_files(t: Tables) -> DataFrame:
    flag, status, key = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_suppkey")
    dotted = F.replace(stem(key), F.lit("/"), F.lit("."))
    source = (
        F.when(flag == "A", "import numpy as np, os.path")
        .when(
            (flag == "R") & (status == "O"),
            F.when(key % 40 == 0, F.concat(F.lit("from .. import "), dotted))
            .otherwise(F.concat(F.lit("from .."), dotted, F.lit(" import x"))),
        )
        .when(flag == "R", "def f():\n    from .missing import y")
        .when(status == "O", F.concat(F.lit("import "), dotted))
        .otherwise("def broken( :")
    )
    return t.lineitem.select(
        F.lit(REPO).alias("repo_id"),
        F.concat(line_stem(), F.lit(".py")).alias("path"),
        F.encode(source, "UTF-8").alias("content"),
    ).distinct()


# ------------------------------------------------------------------- events


def series(t: Tables, key: str) -> DataFrame:
    return t.events.select(
        F.col(key).cast("string").alias("series"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )
