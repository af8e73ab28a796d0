"""Small tables for tests."""

from commitloom import schemas
from commitloom.operators import cochange, history
from commitloom.options import Options

REPO = "r"
ALL_TIME = Options(anchor="1970-01-02T00:00:00Z", window_days=365)


def table(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def universe(spark, *nodes):
    """``(id, kind, parent)``, or with layer and loc after."""
    full = [
        (REPO, n[0], n[1], n[2], n[0], *(n[3:] or ("backend", 10))) for n in nodes
    ]
    return table(spark, full, schemas.UNIVERSE)


def log(spark, *entries, repo=REPO):
    """Newest first: ``(hash, seconds, email, *changes)``; a change is a path or (old, new)."""
    commits, changes = [], []
    for seq, (sha, at, email, *touched) in enumerate(entries):
        commits.append((repo, seq, sha, at, email))
        for pos, change in enumerate(touched):
            if isinstance(change, tuple):
                changes.append((repo, seq, pos, "R", change[1], change[0]))
            else:
                changes.append((repo, seq, pos, "M", change, None))
    return (
        table(spark, commits, schemas.COMMITS),
        table(spark, changes, schemas.CHANGES),
    )


class History:
    """Everything the history operators say about one log."""

    def __init__(self, nodes, commit_log, options=ALL_TIME):
        commits, changes = commit_log
        touched = history.resolve_history(nodes, commits, changes, options).cache()
        activity = history.with_churn(history.node_activity(nodes, touched))
        self.nodes = {
            r.id: (r.churn, r.commits, r.authors, r.last_changed_at)
            for r in activity.collect()
        }
        self.totals = [
            (r.commits, r.last_commit_at)
            for r in history.repo_totals(commits, options).collect()
        ]
        self.warnings = {
            r.code: (r["count"], r.detail)
            for r in history.history_warnings(touched, commits, options).collect()
        }
        self.pairs = rows(cochange.cochanges(touched, options), "a", "b", "count")


def files(spark, tree, repo=REPO):
    encoded = [
        (repo, path, bytearray(c if isinstance(c, bytes) else c.encode())) for path, c in tree.items()
    ]
    return table(spark, encoded, schemas.FILES)
