"""File trees as tables.

A tree is stored as tar archives, ``<root>/<repo_id>/<number>.tar`` (what ``git
archive`` or ``tar`` over a checkout write). Spark's own folder listing would not
do: it leaves out empty files and every name that starts with ``_`` or ``.``, so a
package's ``__init__.py`` would be missing.

An archive of any size is read by many tasks: a first pass goes from header to
header and writes down where each member lies, the members are dealt out by bytes,
and a task seeks and reads its own. No row holds an archive.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from posixpath import normpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.session import checkpoint
from commitloom.sources import ranged

_BATCH_BYTES = 32 * 1024 * 1024
_BATCH_MEMBERS = 10_000
#: a larger file has null content, which the scan counts as unreadable
MAX_CONTENT = 512 * 1024 * 1024
_COLUMNS = ["repo_id", "path", "entry_kind", "content"]
_SCHEMA = "repo_id string, path string, entry_kind string, content binary"


def _content(tar: tarfile.TarFile, entry: tarfile.TarInfo) -> bytes | None:
    """Bytes of a file; null for a hard link whose other name is elsewhere."""
    try:
        return tar.extractfile(entry).read()
    except KeyError:
        return None


def _entries(archive: bytes) -> Iterator[tuple[str, str, bytes | None]]:
    """``(path, entry_kind, content)`` of everything that is not a folder."""
    with tarfile.open(fileobj=io.BytesIO(archive), mode="r:") as tar:
        for entry in tar:
            path = entry.name.removeprefix("./")
            if entry.isreg() or entry.islnk():
                yield path, "file", _content(tar, entry)
            elif entry.issym():
                yield path, "symlink", None
            elif not entry.isdir():
                yield path, "other", None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for repo, archive in zip(batch["repo_id"], batch["content"]):
            rows, size = [], 0
            for path, kind, content in _entries(archive):
                rows.append((repo, path, kind, content))
                size += len(content or b"")
                if size > _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=_COLUMNS)


_MEMBER = (
    "archive string, repo_id string, path string, entry_kind string, name string, "
    "link string, header long, data long, size long, slot long"
)
_MEMBER_COLUMNS = [field.split()[0] for field in _MEMBER.split(", ")]


def _members(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Where each member lies; ``slot`` counts the ranges of about ``width`` bytes."""
    rows = []
    for batch in batches:
        for archive, repo in zip(batch["path"], batch["repo_id"]):
            with ranged.open_file(archive) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                while (entry := tar.next()) is not None:
                    tar.members.clear()  # else the reader keeps every member
                    if entry.isdir():
                        continue
                    kind = "file" if entry.isreg() or entry.islnk() else "symlink" if entry.issym() else "other"
                    # a sparse file is read from its header, which has its map
                    data = -1 if entry.issparse() else entry.offset_data
                    rows.append((
                        archive, repo, entry.name.removeprefix("./"), kind, normpath(entry.name),
                        normpath(entry.linkname) if entry.islnk() else None,
                        entry.offset, data, entry.size if entry.isreg() else 0, entry.offset // width,
                    ))
                    if len(rows) == _BATCH_MEMBERS:
                        yield pd.DataFrame(rows, columns=_MEMBER_COLUMNS)
                        rows = []
    yield pd.DataFrame(rows, columns=_MEMBER_COLUMNS)


def _followed(members: DataFrame) -> DataFrame:
    """Hard links with the place and size of the last earlier member of their other name."""
    links = members.where("link IS NOT NULL")
    others = members.where("entry_kind = 'file' AND link IS NULL").select(
        "archive", F.col("name").alias("link"), F.struct("header", "data", "size").alias("other")
    )
    earlier = F.when(F.col("other.header") < F.col("header"), F.col("other"))
    columns = ["archive", "repo_id", "path", "entry_kind", "name", "link", "header", "slot"]
    found = links.join(others, ["archive", "link"], "left").groupBy(*columns).agg(F.max(earlier).alias("other"))
    place = {n: F.col(f"other.{n}").alias(n) for n in ("header", "data", "size")}
    return found.select(
        *(place.get(n, F.col(n)) for n in _MEMBER_COLUMNS)
    )


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members' bytes; a partition's members come archive by archive."""
    held, file = None, None
    for batch in batches:
        rows, size = [], 0
        for m in batch.itertuples():
            content = None
            if m.entry_kind == "file" and m.size == m.size and m.size <= MAX_CONTENT:
                if held != m.archive:
                    if file is not None:
                        file.close()
                    held, file = m.archive, ranged.open_file(m.archive)
                if m.data >= 0:
                    file.seek(int(m.data))
                    content = file.read(int(m.size))
                else:
                    file.seek(int(m.header))
                    tar = tarfile.open(fileobj=file, mode="r:")
                    content = tar.extractfile(tar.next()).read()
            rows.append((m.repo_id, m.path, m.entry_kind, content))
            size += len(content or b"")
            if size > _BATCH_BYTES:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=_COLUMNS)
    if file is not None:
        file.close()


def list_members(spark: SparkSession, root: str, width: int | None = None) -> DataFrame:
    """Every member of all archives but folders, as a stored table: names, kinds and places, no content."""
    width = width or ranged.range_bytes(spark)
    archives = ranged.list_files(spark, root, "tar").select("path", "repo_id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(
        ranged.spread(archives, tasks, "path").mapInPandas(lambda batches: _members(batches, width), _MEMBER)
    )


def read_members(members: DataFrame) -> DataFrame:
    """``(repo_id, path, entry_kind, content)`` of the members; each range of an archive is read by one task."""
    tasks = ranged.task_count(members, F.col("size") + tarfile.BLOCKSIZE)
    placed = members.where("link IS NULL").unionByName(_followed(members))
    dealt = ranged.spread(placed, tasks, "archive", "slot").sortWithinPartitions("archive", "header")
    return dealt.mapInPandas(_contents, _SCHEMA)


def read_entries(spark: SparkSession, root: str, width: int | None = None) -> DataFrame:
    """``(repo_id, path, entry_kind, content)`` of all archives.

    Members that start in the same ``width`` bytes of an archive, by default what Spark
    gives a task of a file, are read by one task; a task reads as many such ranges as
    make up its bytes.
    """
    return read_members(list_members(spark, root, width))


def parse_archives(archives: DataFrame) -> DataFrame:
    """The entries of tar archives that are rows ``(repo_id, content)`` already."""
    return archives.select("repo_id", "content").mapInPandas(_read, _SCHEMA)


def files(entries: DataFrame) -> DataFrame:
    """Regular files, the input of the scan."""
    return entries.where(F.col("entry_kind") == "file").select("repo_id", "path", "content")


def inventory(entries: DataFrame) -> DataFrame:
    """All entries without content, for the counts of skipped ones."""
    return entries.select("repo_id", "path", "entry_kind")
