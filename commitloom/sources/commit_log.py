"""Exported commit logs as ``commits`` and ``changes`` tables.

A log is the output of ``git log -M -z --name-status
--format=%x1e%H%x1f%ct%x1f%ae``, newest commit first, as one file or as files
that begin at a commit, ``<root>/<repo_id>/<number>.log`` with 0 the newest.
``seq`` is the file's number and the commit's place within it.

A file of any size is read by many tasks. Fields are told apart by position
only, as a path may look like a commit's head, so a task cannot know what the
first token of its byte range is. It therefore reads the range for each of the
reader's four states and gives the state it ends in and the commits it meets; such
summaries compose, and folding a file's ranges in order gives every range its true
state and the number of commits before. A second pass then reads each range once:
a commit belongs to the range its head starts in and is read to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.session import checkpoint
from commitloom.sources import ranged

_CHUNK_BITS = 32
_BATCH_ROWS = 50_000

_COLUMNS = [
    "repo_id", "seq", "hash", "committed_at", "author_email", "pos", "status", "path",
    "old_path",
]
_SCHEMA = (
    "repo_id string, seq long, hash string, committed_at long, author_email string, "
    "pos int, status string, path string, old_path string"
)


def _seconds(field: str) -> int | None:
    return int(field) if field.isascii() and field.isdigit() else None


def log_rows(raw: bytes) -> Iterator[tuple]:
    """``(n, hash, committed_at, email, pos, status, path, old_path)`` rows.

    Every commit gives a row with ``pos`` -1, then one row per change. Fields
    are taken by position between NUL bytes: a path may hold any other byte,
    the record separator too.
    """
    tokens = iter(raw.decode("utf-8", "replace").split("\0"))
    n, pos, head = -1, 0, None
    for token in tokens:
        if token.startswith("\x1e"):
            sha, _, rest = token[1:].partition("\x1f")
            instant, _, email = rest.partition("\x1f")
            head = None
            if sha:
                n, pos = n + 1, 0
                head = (sha, _seconds(instant), email.lower())
                yield (n, *head, -1, None, None, None)
            continue
        status = token.strip()
        if head is None or not status:
            continue
        old_path = next(tokens, None) if status[0] in "RC" else None
        path = next(tokens, None)
        if path:
            yield (n, *head, pos, status[0], path, old_path)
            pos += 1


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for repo, chunk, content in zip(batch["repo_id"], batch["chunk"], batch["content"]):
            base, rows = int(chunk) << _CHUNK_BITS, []
            for n, *fields in log_rows(content):
                rows.append((repo, base + n, *fields))
                if len(rows) == _BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS)


# What the next token is: a head or a status, a path, an old path, or, after the
# start or a head without a hash, anything: only a head counts.
NEXT, PATH, OLD_PATH, IGNORED = range(4)


def step(state: int, token: bytes) -> tuple[int, bool]:
    """The state after a token, and whether the token is a commit."""
    if state in (PATH, OLD_PATH):
        return state - 1, False
    if token.startswith(b"\x1e"):
        named = token[1:2] not in (b"", b"\x1f")
        return (NEXT, True) if named else (IGNORED, False)
    if state == IGNORED:
        return IGNORED, False
    status = token.decode("utf-8", "replace").strip()
    return (NEXT if not status else OLD_PATH if status[0] in "RC" else PATH), False


def summary(found: Iterator[tuple[int, bytes]], stop: int) -> tuple[list[int], list[int]]:
    """For each state at the start of a range, the state at its end and the commits in it."""
    states, counts = list(range(4)), [0] * 4
    for at, token in found:
        if at >= stop:
            break
        if len(set(states)) == 1:  # all are one by now
            state, commit = step(states[0], token)
            states = [state] * 4
            if commit:
                counts = [n + 1 for n in counts]
            continue
        for k, (state, commit) in enumerate([step(state, token) for state in states]):
            states[k] = state
            counts[k] += commit
    return states, counts


def range_rows(found: Iterator[tuple[int, bytes]], stop: int, state: int, before: int) -> Iterator[tuple]:
    """The rows of the commits that start before ``stop``, as `log_rows` gives them.

    ``state`` is the true one at the start, ``before`` the number of earlier commits.
    """
    n, pos, head, status, old_path = before - 1, 0, None, "", None
    for at, token in found:
        if at >= stop and (head is None or state in (NEXT, IGNORED) and token.startswith(b"\x1e")):
            return  # the last commit of this range is over
        after, commit = step(state, token)
        if commit:
            sha, _, rest = token[1:].decode("utf-8", "replace").partition("\x1f")
            instant, _, email = rest.partition("\x1f")
            n, pos, head = n + 1, 0, (sha, _seconds(instant), email.lower())
            yield (n, *head, -1, None, None, None)
        elif after == IGNORED:
            head = None
        elif head is not None:  # else the commit began in an earlier range
            if state == OLD_PATH:
                old_path = token.decode("utf-8", "replace")
            elif state == PATH:
                if token:
                    yield (n, *head, pos, status, token.decode("utf-8", "replace"), old_path)
                    pos += 1
            elif after != NEXT:
                status, old_path = token.decode("utf-8", "replace").strip()[0], None
        state = after


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
            with ranged.open_file(path) as file:
                made.append(summary(ranged.tokens(file, start, size=ranged.block_bytes(stop - start)), stop))
        batch["ends"], batch["commits"] = [m[0] for m in made], [m[1] for m in made]
        yield batch


def _placed(file: pd.DataFrame) -> pd.DataFrame:
    """The true state and the commits before each range of a file."""
    file, state, before = file.sort_values("start"), IGNORED, 0
    states, counts = [], []
    for ends, commits in zip(file["ends"], file["commits"]):
        states.append(state)
        counts.append(before)
        before, state = before + int(commits[state]), int(ends[state])
    return file.drop(columns=["ends", "commits"]).assign(state=states, before=counts)


def _parse_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for batch in batches:
        for row in batch.itertuples():
            base, size = int(row.number) << _CHUNK_BITS, ranged.block_bytes(row.stop - row.start)
            with ranged.open_file(row.path) as file:
                found = ranged.tokens(file, row.start, size=size)
                for n, *fields in range_rows(found, row.stop, row.state, row.before):
                    rows.append((row.repo_id, base + n, *fields))
                    if len(rows) == _BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
    yield pd.DataFrame(rows, columns=_COLUMNS)


def read_log(spark: SparkSession, root: str, width: int | None = None) -> DataFrame:
    """Commit rows (``pos`` -1) and change rows of all files in one table.

    A range has ``width`` bytes, by default what Spark gives a task of a file; a task
    reads as many ranges as make up its bytes.
    """
    places = "path string, length long, repo_id string, number long, start long, stop long"
    parts = ranged.ranges(ranged.list_files(spark, root, "log"), width or ranged.range_bytes(spark))
    tasks = ranged.task_count(parts, F.col("stop") - F.col("start"))
    told = ranged.spread(parts, tasks, "path", "start").mapInPandas(
        _summaries, f"{places}, ends array<int>, commits array<long>"
    )
    placed = told.groupBy("path").applyInPandas(_placed, f"{places}, state int, before long")
    rows = ranged.spread(placed, tasks, "path", "start").mapInPandas(_parse_ranges, _SCHEMA)
    return checkpoint(rows)


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """The rows of log files given as ``(repo_id, chunk, content)``, written once: commits and changes both read them."""
    return checkpoint(chunks.select("repo_id", "chunk", "content").mapInPandas(_parse, _SCHEMA))


def commits(log: DataFrame) -> DataFrame:
    return log.where(F.col("pos") == -1).select(
        "repo_id", "seq", "hash", "committed_at", "author_email"
    )


def changes(log: DataFrame) -> DataFrame:
    return log.where(F.col("pos") >= 0).select(
        "repo_id", "seq", "pos", "status", "path", "old_path"
    )
