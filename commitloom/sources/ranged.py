"""Large files in byte ranges: what each task reads, and reading it.

Spark lists the files, so a folder may lie in any store that Spark reads, and
content stays unread. A task opens a file by Arrow's file systems (local, HDFS,
S3, GCS) and reads its own bytes, so no row ever holds a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
# what a task reads of many ranges; a range may be smaller
TASK_BYTES = 32 << 20


def list_files(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """``(path, length, repo_id, number)`` of the files ``<repo_id>/<number>.<extension>``.

    A file with another name is an error, as its rows would have no repository.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{extension}")
        .load(root)
    )
    named = rf"([^/]+)/(\d+)\.{extension}\z"
    repo = F.regexp_extract("path", named, 1)
    unnamed = F.raise_error(F.concat(F.lit(f"not named <repo_id>/<number>.{extension}: "), "path"))
    return listed.select(
        "path", "length", F.when(repo != "", repo).otherwise(unnamed).alias("repo_id"),
        F.regexp_extract("path", named, 2).try_cast("long").alias("number"),
    )


def range_bytes(spark: SparkSession) -> int:
    """Bytes a task reads: what Spark itself gives a task of a splittable file."""
    stated = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(stated)


def ranges(files: DataFrame, width: int) -> DataFrame:
    """The files with ``start`` and ``stop`` of every range of ``width`` bytes."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(width).cast("long"))
    return files.withColumn("start", F.explode(starts)).withColumn(
        "stop", F.least(F.col("start") + width, "length")
    )


def task_count(rows: DataFrame, size: Column) -> int:
    """Tasks for rows that stand for ``size`` bytes each: one for ``TASK_BYTES``, four a core if there are rows enough.

    It follows from the bytes and not from the number of rows, of which there may be
    very many: each task costs a start, and every shuffle before it a block.
    """
    total, count = rows.agg(F.sum(size), F.count("*")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(count, max(4 * cores, ceil((total or 0) / TASK_BYTES))))


def spread(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Small rows that stand for much work, over a stated number of tasks.

    A stated number is kept: by the size of the rows themselves Spark would give
    all of them to one task.
    """
    return rows.repartition(max(1, tasks), *keys)


def store_of(path: str):
    """Arrow's file system of a full path, and the path in it."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{known}:{quote(rest)}")


def open_file(path: str):
    """A file of ``list_files`` for reading at any place."""
    store, place = store_of(path)
    return store.open_input_file(place)


def write_file(path: str, content: bytes) -> None:
    """Write a file whole or not at all, however often a task is repeated."""
    store, place = store_of(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place + ".part") as file:
        file.write(content)
    store.move(place + ".part", place)


def full_path(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as tasks need it."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()


def blocks(file, start: int, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The bytes of an open file from a place on."""
    file.seek(start)
    while block := file.read(size):
        yield block


def block_bytes(width: int) -> int:
    """Bytes to read at once of a range: little beyond its end is read."""
    return max(4096, min(BLOCK_BYTES, width // 8))


def tokens(file, start: int, end: bytes = b"\0", size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of every token that starts at ``start`` or later; ``size`` bytes are read at once.

    A token starts at the file's first byte or after an ``end`` byte. What follows
    the last ``end`` is a token unless it is empty.
    """
    at, held, skipping = start, [], start > 0
    if skipping:  # a token starts at `start` only after an end
        at = start - 1
    for block in blocks(file, at, size) if size else blocks(file, at):
        parts = block.split(end)
        if skipping:
            if len(parts) == 1:
                at += len(block)
                continue
            at += len(parts.pop(0)) + 1
            skipping = False
        held.append(parts[0])
        for part in parts[1:]:
            token = b"".join(held)
            yield at, token
            at += len(token) + 1
            held = [part]
    rest = b"".join(held)
    if rest:
        yield at, rest
