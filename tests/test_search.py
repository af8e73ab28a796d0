import random

from pyspark.sql import functions as F

from commitloom.functions import text
from commitloom.operators import search

QUERIES = [
    "src", "a.b", "A-b", "[^]", "\\d", "a b", "x$", "(a", "&&~#", "é", "aé", "İx", "K", "\U0001f600a", "a\nb",
    "aaaaaaaaaaaaaaaaaaaaab", "  ", "",
]


def test_paths_are_left_out_for_no_query_they_match(spark, monkeypatch):
    rng = random.Random(3)
    signs = [*"abxk./-_[]^\\d $(&~#\n", "é", "É", "İ", "K", "\U0001f600", "i̇x", "SRC"]
    paths = sorted({"".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(1500)} | {"a" * 3000, "src/a.b"})
    nodes = spark.createDataFrame([(1, f"file:{p}", p) for p in paths] + [(1, "null", None)], "repo_id long, id string, path string")
    columns = ["repo_id", "query", "id", "score", "rank", "positions"]
    got = search.search(nodes, QUERIES, limit=2000).select(columns)
    rows = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(text, "may_match", lambda path, query: path.isNotNull())
    assert rows == sorted(map(tuple, search.search(nodes, QUERIES, limit=2000).select(columns).collect()))
    assert len({r[1] for r in rows}) > 10


def test_few_pairs_are_placed(spark):
    paths = spark.range(2000).select(F.concat(F.lit("src/f"), "id", F.lit(".ts")).alias("path"))
    fits = paths.where(text.may_match(F.col("path"), "F12"))
    placed = paths.where(text.match_positions(F.col("path"), F.lit("F12")).isNotNull())
    assert 0 < fits.count() == placed.count() < 500
