"""Path arithmetic on POSIX relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Folder part, ``''`` for a root file."""
    return F.left(path, F.length(path) - F.length(basename(path)) - 1)


def prefix(path: Column, depth: int) -> Column:
    """First ``depth`` folder segments; null when the folder is shallower."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.when(
        F.size(folders) >= depth, F.array_join(F.slice(folders, 1, depth), "/")
    )


def join_path(folder: Column, relative: Column) -> Column:
    """``folder/relative`` with ``.`` and ``..`` resolved; null above the root."""
    def plain(part: Column) -> Column:  # without segments that need resolving
        return ~part.rlike(r"(?:\A|/)\.{0,2}(?:/|\z)")

    # most imports climb one folder at most, which needs no walk over segments
    up = relative.startswith("../")
    rest = F.when(up, F.substr(relative, F.lit(4))).when(relative.startswith("./"), F.substr(relative, F.lit(3))).otherwise(relative)
    start = F.when(up, dirname(folder)).otherwise(folder)
    easy = plain(rest) & F.when(folder == "", ~up).otherwise(plain(folder))
    parts = F.filter(
        F.split(F.concat_ws("/", folder, relative), "/"),
        lambda s: (s != "") & (s != "."),
    )
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        parts,
        empty,
        lambda acc, s: F.when(acc.isNull(), F.lit(None).cast("array<string>"))
        .when(
            s == "..",
            F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)),
        )
        .otherwise(F.concat(acc, F.array(s))),
    )
    short = F.when(start == "", rest).otherwise(F.concat(start, F.lit("/"), rest))
    return F.when(easy, short).otherwise(F.array_join(walked, "/"))


def ancestors(path: Column) -> Column:
    """Every folder that holds ``path``, the root ``''`` first."""
    segments = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1),
        lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"),
    )


def repo_name(remote_url: Column, fallback: Column) -> Column:
    """Last ``/`` or ``:`` segment of the remote without ``.git``."""
    trimmed = F.regexp_replace(remote_url, r"/+\z", "")
    name = F.regexp_replace(F.regexp_extract(trimmed, r"([^/:]*)\z", 1), r"\.git\z", "")
    return F.coalesce(F.when(name != "", name), fallback)
