"""What jobs leave on disk: phases, dropped tables, shuffle files."""

import datetime
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from support import files, rows, universe

from commitloom import session
from commitloom.operators import python_imports, script_imports
from commitloom.plans.queries import QUERIES


def stored(spark):
    """Columns of each table that is in the application's folder, with its rows."""
    top = session.run_folder(spark).removeprefix("file:")
    held = {}
    for folder, _, names in os.walk(top):
        parts = [pq.read_table(f"{folder}/{n}") for n in names if n.endswith(".parquet")]
        if parts:
            held[folder] = (parts[0].column_names, sum(p.num_rows for p in parts))
    return held


def test_a_phase_leaves_its_result_alone(spark):
    before = stored(spark)

    def make():
        first = session.checkpoint(spark.range(10))
        return session.checkpoint(first.where("id > 3")).select((F.col("id") * 2).alias("n"))

    result = session.phase(spark, make)
    assert [v for k, v in stored(spark).items() if k not in before] == [(["n"], 6)]
    assert rows(result) == rows(spark.range(4, 10).select(F.col("id") * 2))


def test_what_fails_in_a_phase_does_not_stay_its_folder(spark):
    with pytest.raises(ValueError):
        session.phase(spark, lambda: (_ for _ in ()).throw(ValueError("x")))
    table = session.checkpoint(spark.range(3))
    assert os.path.dirname(table.inputFiles()[0].removeprefix("file://")).rpartition("/")[0].endswith(spark.sparkContext.applicationId)


def test_a_dropped_table_is_deleted(spark):
    table, other = session.checkpoint(spark.range(5)), session.checkpoint(spark.range(7))
    session.drop(table)
    assert not [k for k, v in stored(spark).items() if k in table.inputFiles()[0]] and other.count() == 7


def test_shuffle_files_are_let_go(spark):
    def held():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    session.free(spark)
    time.sleep(1)
    before = held()
    session.checkpoint(spark.range(1000).repartition(7, "id"))
    assert held() > before
    session.free(spark)
    until = time.time() + 20
    while held() > before and time.time() < until:
        time.sleep(0.2)
    assert held() <= before


def watched(monkeypatch, module):
    written, real = [], module.checkpoint
    monkeypatch.setattr(module, "checkpoint", lambda df: written.append(real(df)) or written[-1])
    return written


def test_files_are_stored_without_what_their_path_tells(spark, monkeypatch):
    written = watched(monkeypatch, script_imports)
    tree = {"a.ts": "", "d/index.js": ""}
    script_imports.targets(files(spark, tree), universe(spark, ("a.ts", "file", None)))
    found = next(df for df in written if "in_universe" in df.columns)
    assert rows(found) == [
        ("r", "a.ts", True, None, None), ("r", "d/index.js", False, "d", 24.0), ("r", "d/index.js", False, None, None),
    ]
    assert not any({"base", "key", "place"} <= set(df.columns) for df in written)


def test_specifiers_without_a_lookup_path_are_not_joined(spark, monkeypatch):
    written = watched(monkeypatch, script_imports)
    disk = files(spark, {"a.ts": 'import "./b"; import "x"; import "../y"; import "./gone";', "b.ts": ""})
    nodes = universe(spark, ("a.ts", "file", None), ("b.ts", "file", None))
    found = script_imports.resolve(script_imports.extract(disk), disk, nodes)
    assert rows(found, "specifier", "outcome", "target") == [
        ("../y", "unresolved-import", None), ("./b", "edge", "b.ts"), ("./gone", "unresolved-import", None),
        ("x", "external-import", None),
    ]
    answered = next(df for df in written if "best" in df.columns)
    assert rows(answered, "specifier") == [("../y",), ("./b",), ("./gone",)]


def test_python_imports_are_looked_up_only_by_paths_they_have(spark, monkeypatch):
    written = watched(monkeypatch, python_imports)
    nodes = universe(spark, ("a.py", "file", None), ("p/__init__.py", "file", "p/"), ("p/q.py", "file", "p/"))
    found = python_imports.extract(files(spark, {"a.py": "from p import q, r\nimport os\nfrom .. import up"}))
    resolved = python_imports.resolve(python_imports.imports(found), nodes)
    assert rows(resolved, "ord", "specifier", "outcome", "target") == [
        (0, "p", "edge", "p/q.py"), (1, "p", "edge", "p/__init__.py"), (2, "os", "external-import", None),
        (3, "..", "unresolved-import", None),
    ]
    assert [rows(df, "ord") for df in written if "best" in df.columns] == [[(0,), (1,)], [(1,), (2,)]]


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.datetime(1998, 1, 1)
    tables = {
        "lineitem": ([(n // 3, n % 7 + 1, n % 5 + 1, n % 3, float(n % 4 + 1), "ARN"[n % 3], "OF"[n % 2]) for n in range(60)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_returnflag string, l_linestatus string"),
        "orders": ([(n, n % 4, day) for n in range(20)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "part": ([(n, ("ECONOMY", "PROMO", "LARGE")[n % 3], n) for n in range(1, 9)], "p_partkey long, p_type string, p_size int"),
        "region": ([(n,) for n in range(5)], "r_regionkey long"),
    }
    for name, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_edge_union_keeps_only_edges(spark, folder):
    before = stored(spark)
    found = QUERIES["edge_union"](spark, folder)
    left = [columns for k, (columns, _) in stored(spark).items() if k not in before]
    assert left == [["repo_id", "source", "target", "kind", "weight"]] * 2
    both = QUERIES["import_resolve"](spark, folder).unionByName(QUERIES["python_resolve"](spark, folder))
    assert rows(found, "source", "target") == rows(both.where("outcome = 'edge'").select("source", "target").distinct())
    assert found.count() > 0


def test_resolved_scripts_let_their_files_go(spark, folder):
    before = stored(spark)
    assert QUERIES["import_resolve"](spark, folder).count() == 60
    assert not [c for k, (c, _) in stored(spark).items() if k not in before and "specifiers" in c]


def test_two_runs_are_compared_without_their_rows(spark, folder):
    before = stored(spark)
    found = QUERIES["determinism"](spark, folder)
    assert not [c for k, (c, _) in stored(spark).items() if k not in before and "author_email" in c]
    assert found.count() == 0  # no node has a multiple of 25 lines here
