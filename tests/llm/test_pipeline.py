import importlib
import sys

from conftest_llm import AWKWARD

import corpus_pipeline
from commitloom.llm import decontaminate, factorization, packing
from commitloom.llm.common import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_hand_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, before, folder))
        if name != "packing":
            assert after.columns == COLUMNS
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality classifier":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            want = factorization.quality_scores(docs, labels).where("predicted = 1").select("doc_id")
            assert after.select("doc_id").exceptAll(want).count() == 0 and after.count() == want.count()
        if name == "line dedup":
            lines = after.selectExpr("explode(split(text, '\\n')) as line").where("trim(line) <> ''")
            assert lines.count() == lines.distinct().count()
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "benchmark decontamination":
            assert decontaminate.contamination(after, items).where("contaminated").count() == 0
        if name == "packing":
            tokens = after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"})
            assert tokens.where("`sum(length)` <> `max(doc_tokens)`").count() == 0
            assert tokens.count() == before.count()
        before = after


def test_stages_take_awkward_tables(spark, make, folder):
    for rows in (AWKWARD, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, folder))
            assert name == "packing" or docs.columns == COLUMNS
    assert packing.SEQUENCE == 4096


def test_entry_works_without_this_package(monkeypatch):
    import __spark_entry__ as entry

    assert any(name.startswith("op1_") for name in entry.queries()) and "pipeline" in entry.queries()
    hidden = [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("commitloom.llm")]
    for module in hidden:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "commitloom.llm", None)
    bare = importlib.reload(entry)
    assert bare.queries() and not any(name.startswith("op") and name[2].isdigit() for name in bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)
