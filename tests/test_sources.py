import io
import json

import pytest
from support import files, log, rows, table

from commitloom import schemas
from commitloom.operators import quality, rates
from commitloom.options import Options
from commitloom.plans import analyze
from commitloom.sources import commit_log, documents, ranged
from pyspark.sql import functions as F


def _raw(*commits):
    """A log stream as git writes it."""
    out = ""
    for sha, at, email, *changes in commits:
        out += f"\x1e{sha}\x1f{at}\x1f{email}\0"
        for i, change in enumerate(changes):
            out += ("\n" if i == 0 else "") + "\0".join(change) + "\0"
    return out.encode()


def test_log_parser():
    raw = _raw(
        ("c3", 30, "Ada\x1f@X", ("R100", "old.py", "new.py"), ("M", "\x1edeadbeef\x1f1\x1fx")),
        ("c2", 20, "b@x"),
        ("c1", 10, "c@x", ("A", "a\nb"), ("C75", "p", "q"), ("D", "gone")),
    )
    assert list(commit_log.log_rows(raw)) == [
        (0, "c3", 30, "ada\x1f@x", -1, None, None, None),
        (0, "c3", 30, "ada\x1f@x", 0, "R", "new.py", "old.py"),
        (0, "c3", 30, "ada\x1f@x", 1, "M", "\x1edeadbeef\x1f1\x1fx", None),
        (1, "c2", 20, "b@x", -1, None, None, None),
        (2, "c1", 10, "c@x", -1, None, None, None),
        (2, "c1", 10, "c@x", 0, "A", "a\nb", None),
        (2, "c1", 10, "c@x", 1, "C", "q", "p"),
        (2, "c1", 10, "c@x", 2, "D", "gone", None),
    ]
    assert list(commit_log.log_rows(b"")) == [] and list(commit_log.log_rows(b"M\0x\0")) == []


def test_log_chunks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "0.log").write_bytes(_raw(("n2", 30, "a", ("M", "x")), ("n1", 20, "a")))
    (tmp_path / "r" / "1.log").write_bytes(_raw(("o1", 10, "b", ("M", "x"), ("M", "y"))))
    read = commit_log.read_log(spark, str(tmp_path)).cache()
    commits = commit_log.commits(read).orderBy("seq").collect()
    assert [c.hash for c in commits] == ["n2", "n1", "o1"]
    assert rows(commit_log.changes(read), "seq", "pos", "path") == [
        (commits[0].seq, 0, "x"), (commits[2].seq, 0, "x"), (commits[2].seq, 1, "y"),
    ]


AMBIGUOUS = _raw(
    ("c5", 50, "Ada\x1f@X", ("R100", "\x1eold\x1f1\x1fx", "\x1edeadbeef\x1f1\x1fx"), ("M", "M"), ("R9", "R", "C")),
    ("c4", 40, "b@x"), ("c3", 30, "b@x", ("A", "\x1e"), ("M", "M"), ("M", "R"), ("D", "a\nb")),
    ("", 25, "nobody", ("M", "ignored")), ("c2", 20, "c@x", ("C75", "p", "q"), ("M", "ünï")), ("c1", 10, "c@x", ("M", "\x1e")),
) + b"\n\0\0M\0"


def _by_ranges(raw, cuts):
    """Rows of a log read in ranges that end at the cuts, by both passes."""
    file, state, before, found = io.BytesIO(raw), commit_log.IGNORED, 0, []
    for start, stop in zip([0, *cuts], [*cuts, len(raw)]):
        tokens = lambda: ranged.tokens(file, start)  # noqa: B023,E731
        found += commit_log.range_rows(tokens(), stop, state, before)
        ends, commits = commit_log.summary(tokens(), stop)
        before, state = before + commits[state], ends[state]
    return found


def test_log_cut_anywhere():
    want = list(commit_log.log_rows(AMBIGUOUS))
    assert [r[1] for r in want if r[4] == -1] == ["c5", "c4", "c3", "c2", "c1"]
    for cut in range(len(AMBIGUOUS) + 1):
        assert _by_ranges(AMBIGUOUS, [cut]) == want, cut
    for width in range(1, 40):
        assert _by_ranges(AMBIGUOUS, range(width, len(AMBIGUOUS), width)) == want, width


def test_tokens_from_any_place(monkeypatch):
    raw = b"ab\0\0c\0\0\0def"
    want = [(0, b"ab"), (3, b""), (4, b"c"), (6, b""), (7, b""), (8, b"def")]
    for size in (1, 2, 3, 100):
        monkeypatch.setattr(ranged.blocks, "__defaults__", (size,))
        for start in range(len(raw) + 1):
            assert list(ranged.tokens(io.BytesIO(raw), start)) == [t for t in want if t[0] >= start]


def test_log_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    one = _raw(*((f"h{k}", k, f"{k % 7}@x", *((("M", f"p{j}") for j in range(k % 9)))) for k in range(400)))
    (tmp_path / "r" / "0.log").write_bytes(one)
    (tmp_path / "r" / "1.log").write_bytes(AMBIGUOUS)
    (tmp_path / "r" / "2.log").write_bytes(b"")
    read = commit_log.read_log(spark, str(tmp_path), 256)
    assert len(read.inputFiles()) > 10
    chunks = table(spark, [("r", 0, bytearray(one)), ("r", 1, bytearray(AMBIGUOUS))], "repo_id string, chunk long, content binary")
    assert rows(read) == rows(commit_log.parse_chunks(chunks))


def test_tasks_follow_the_bytes_and_not_the_ranges(spark, tmp_path):
    (tmp_path / "r").mkdir()
    one = _raw(*((f"h{k}", k, f"{k % 7}@x", *((("M", f"p{j}") for j in range(k % 9)))) for k in range(4000)))
    (tmp_path / "r" / "0.log").write_bytes(one)
    read = commit_log.read_log(spark, str(tmp_path), 256)  # more than 500 ranges
    assert len(one) / 256 > 500
    assert len(read.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
    assert read.where("pos = -1").count() == 4000


def test_a_small_range_is_read_in_small_blocks():
    """What lies far beyond a range's end is not read."""
    assert ranged.block_bytes(1 << 16) < 1 << 14 and ranged.block_bytes(1 << 40) == ranged.BLOCK_BYTES
    file = io.BytesIO(b"ab\0" * 100_000)
    for at, _ in ranged.tokens(file, 0, size=ranged.block_bytes(1 << 10)):
        if at >= 1 << 10:
            break
    assert file.tell() <= 2 * 4096


def _document(**changes):
    doc = {
        "schemaVersion": "1.0",
        "repo": {
            "name": "n", "remoteUrl": None, "analyzedAt": "2026-01-01T00:00:00.000Z", "defaultBranch": "main",
            "analysisWindowDays": 90,
            "stats": {"files": 1, "loc": 3, "commits": 0, "languages": {"python": 1}},
        },
        "nodes": [
            {"id": "a/", "kind": "module", "parent": None, "path": "a/", "layer": "backend", "loc": 3, "churn": 0,
             "commits": 0, "authors": 0, "lastChangedAt": None, "description": None, "descriptionSource": None},
            {"id": "a/b", "kind": "file", "parent": "a/", "path": "a/b", "layer": "backend", "loc": 3.0, "churn": 0.5,
             "commits": 2, "authors": 1, "lastChangedAt": "2025-12-31T23:59:59+01:00", "description": None,
             "descriptionSource": None},
        ],
        "edges": [{"source": "a/b", "target": "a/b", "kind": "import", "weight": 1}],
        "cochanges": [{"a": "a/", "b": "a/b", "count": 3}],
    }
    doc.update(changes)
    return doc


def _change(where, value):
    doc = _document()
    target = doc
    for key in where[:-1]:
        target = target[key]
    if value is KeyError:
        del target[where[-1]]
    else:
        target[where[-1]] = value
    return doc


def _docs(spark, *values):
    raw = [(str(i), v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return table(spark, raw, "repo_id string, raw string")


VIOLATIONS = [
    (("schemaVersion",), "1.1", "/schemaVersion", "must be equal to constant"),
    (("extra",), 1, "/", "must NOT have additional properties"),
    (("nodes",), KeyError, "/nodes", "must have required property 'nodes'"),
    (("edges",), {}, "/edges", "must be array"),
    (("repo", "name"), "", "/repo/name", "must NOT have fewer than 1 characters"),
    (("repo", "analyzedAt"), "2026-02-29T00:00:00Z", "/repo/analyzedAt", 'must match format "date-time"'),
    (("repo", "analysisWindowDays"), 0, "/repo/analysisWindowDays", "must be >= 1"),
    (("repo", "stats"), [], "/repo/stats", "must be object"),
    (("repo", "stats", "loc"), 1.5, "/repo/stats/loc", "must be integer"),
    (("repo", "stats", "languages", "go"), 1.5, "/repo/stats/languages/go", "must be <= 1"),
    (("nodes", 1, "layer"), "ui", "/nodes/1/layer", "must be equal to one of the allowed values"),
    (("nodes", 0, "kind"), 3, "/nodes/0/kind", "must be equal to one of the allowed values"),
    (("nodes", 1, "parent"), 3, "/nodes/1/parent", "must be string,null"),
    (("nodes", 1, "churn"), -1, "/nodes/1/churn", "must be >= 0"),
    (("nodes", 1, "commits"), "2", "/nodes/1/commits", "must be integer"),
    (("nodes", 1, "description"), "x", "/nodes/1/description", "must be null"),
    (("nodes", 1), None, "/nodes/1", "must be object"),
    (("edges", 0, "kind"), "call", "/edges/0/kind", "must be equal to constant"),
    (("edges", 0, "weight"), 0, "/edges/0/weight", "must be >= 1"),
    (("cochanges", 0, "b"), KeyError, "/cochanges/0/b", "must have required property 'b'"),
]


def test_contract_violations(spark):
    changed = [_change(where, value) for where, value, _, _ in VIOLATIONS]
    several = _change(("nodes", 0, "loc"), -1)
    several["edges"][0]["target"] = ""
    docs = _docs(spark, _document(), "{nope", "[]", several, *changed)
    want = [("1", "/", "must be valid JSON"), ("2", "/", "must be object"), ("3", "/nodes/0/loc", "must be >= 0"),
            ("3", "/edges/0/target", "must NOT have fewer than 1 characters")]
    want += [(str(i + 4), path, message) for i, (_, _, path, message) in enumerate(VIOLATIONS)]
    assert rows(quality.validate_documents(docs)) == sorted(want, key=repr)


def test_a_document_is_read_once_for_all_its_checks(spark, tmp_path):
    share = _change(("repo", "stats", "languages", "go"), None)
    _docs(spark, share, _change(("nodes",), [None, 1])).write.parquet(f"{tmp_path}/docs")
    checked = quality.validate_documents(spark.read.parquet(f"{tmp_path}/docs"))
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert rows(checked) == [
        ("0", "/repo/stats/languages/go", "must be number"),
        ("1", "/nodes/0", "must be object"), ("1", "/nodes/1", "must be object"),
    ]


def test_load_status(spark):
    docs = _docs(
        spark, _document(), "{", _change(("schemaVersion",), KeyError), _change(("schemaVersion",), "one"),
        _change(("schemaVersion",), "2.0"), _change(("schemaVersion",), "1.7"), _change(("nodes", 1), None),
        _change(("edges", 0), {"source": 1}), _change(("repo", "stats", "files"), "x"), _change(("cochanges",), KeyError),
    )
    got = [r[1:] for r in rows(documents.load_status(docs), "repo_id", "status", "detail")]
    assert got == [
        ("ok", None), ("malformed", "not valid JSON"), ("malformed", "schemaVersion is missing"),
        ("malformed", "schemaVersion is unreadable: one"), ("unsupported-version", "schemaVersion is not supported: 2.0"),
        ("ok", None), ("malformed", "not a node at index 1"), ("malformed", "not an edge at index 0"),
        ("malformed", "`repo.stats.files` is missing"), ("malformed", "`cochanges` array is missing"),
    ]
    tables = documents.document_tables(docs)
    assert rows(tables["nodes"].where("repo_id = '0'"), "id", "loc", "last_changed_at") == [
        ("a/", 3, None), ("a/b", 3, 1767221999),
    ]


@pytest.mark.parametrize("valid, instants", [
    (True, ["2024-02-29T00:00:00Z", "2026-01-01t23:59:59.123z", "0001-12-31T00:00:00-23:59", "2000-02-29T00:00:00+05:30"]),
    (False, ["2026-99-99T25:61:61Z", "1900-02-29T00:00:00Z", "2026-04-31T00:00:00Z", "2026-01-01T23:59:60Z",
             "0000-01-01T00:00:00Z", "2026-01-01T00:00:00+24:00", "2026-01-01 00:00:00Z", "2026-01-01T00:00:00", "", "2026-01-00T00:00:00Z"]),
])
def test_instants(spark, valid, instants):
    df = table(spark, [(i,) for i in instants], "v string").select("v", quality.is_instant(F.col("v")).alias("ok"))
    assert {r.v: r.ok for r in df.collect()} == dict.fromkeys(instants, valid)


def test_document_order(spark):
    swapped = _document()
    swapped["nodes"].reverse()
    pairs = _document(cochanges=[{"a": "a", "b": "b", "count": 1}, {"a": "a", "b": "b", "count": 2}])
    assert rows(quality.document_order(_docs(spark, _document(), swapped, pairs)), "repo_id", "path") == [
        ("1", "/nodes"), ("2", "/cochanges"),
    ]


TREE = {
    "src/app/main.py": "from ..core import model\nimport os\n", "src/app/__init__.py": "", "src/core/__init__.py": "",
    "src/core/model.py": "x = 1\n\n", "src/web/a.ts": 'import "./b";\n', "src/web/b.ts": "export {}\n",
    "src/bad.py": "def (", "README.md": "# hi\n", "node_modules/x.js": "1",
}


@pytest.fixture(scope="module")
def analysed(spark):
    commits, changes = log(
        spark, ("h2", 1_000_050, "b", "src/web/a.ts", "src/web/b.ts"),
        ("h1", 1_000_040, "a", "src/web/a.ts", "src/web/b.ts", "gone.py"),
        ("h0", 1_000_030, "a", "src/web/a.ts", "src/web/b.ts"),
    )
    options = Options(anchor="1970-01-12T13:48:20Z")
    return analyze.analyze(files(spark, TREE), commits, changes, options)


def test_whole_analysis(spark, analysed):
    nodes = {r.id: r for r in analysed.nodes.collect()}
    assert set(nodes) == {"src/", "src/app/", "src/core/", "src/web/", *TREE} - {"node_modules/x.js"}
    assert nodes["src/web/"].commits == 3 and nodes["src/web/"].authors == 2 and nodes["src/web/a.ts"].churn == 1
    assert nodes["src/app/"].loc == 2 and nodes["README.md"].parent is None
    assert set(rows(analysed.edges, "source", "target", "weight")) == {
        ("src/app/main.py", "src/core/model.py", 1), ("src/web/a.ts", "src/web/b.ts", 1), ("src/app/", "src/core/", 1),
    }
    assert rows(analysed.cochanges, "kind", "a", "b", "count") == [("file", "src/web/a.ts", "src/web/b.ts", 3)]
    stats = analysed.repo_stats.first()
    assert (stats.files, stats.commits, stats.last_commit_at) == (8, 3, 1_000_050)
    assert {(r.stage, r.code, r.detail) for r in analysed.warnings.collect()} == {
        ("deps", "external-import", "os in src/app/main.py"), ("deps", "unparsable-file", "src/bad.py"),
        ("history", "path-outside-universe", "gone.py"),
    }


def test_written_documents(spark, analysed, tmp_path):
    described = analysed.repo_stats.selectExpr(
        "repo_id", "'demo' as name", "'x' as remote_url", "'main' as default_branch", "1000100L as analyzed_at",
        "90 as window_days", "files", "loc", "commits", "languages",
    )
    lines = documents.document_lines(described, analysed.nodes, analysed.edges, analysed.cochanges).cache()
    docs = documents.documents(lines).cache()
    assert quality.validate_documents(docs).count() == 0 and quality.document_order(docs).count() == 0
    assert documents.load_status(docs).first().status == "ok"
    tables = documents.document_tables(docs)
    same = ["repo_id", "id", "kind", "parent", "path", "layer", "loc", "churn", "commits", "authors", "last_changed_at"]
    assert rows(tables["nodes"], *same) == rows(analysed.nodes, *same)
    assert rows(tables["edges"]) == rows(analysed.edges)
    assert rows(tables["cochanges"]) == rows(analysed.cochanges)
    size = documents.document_sizes(lines).first()
    assert size.bytes == len(docs.first().raw) + 1 and size.within_limit
    documents.write_documents(lines, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "repo_id=r").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    assert json.loads(whole) == json.loads(docs.first().raw)
    back = documents.read_documents(spark, str(tmp_path / "out"))
    assert [(r.repo_id, json.loads(r.raw)) for r in back.collect()] == [("r", json.loads(whole))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "demo.json").write_text(whole)
    read = documents.read_documents(spark, str(tmp_path / "in"))
    assert rows(documents.load_status(read), "repo_id", "status") == [("demo", "ok")]
    documents.write_table(analysed.nodes, str(tmp_path / "nodes"), "id")
    assert rows(spark.read.parquet(str(tmp_path / "nodes")), "id") == rows(analysed.nodes, "id")


def test_large_document_makes_the_round_trip(spark, tmp_path):
    nodes = spark.range(60_000).selectExpr(
        "'big' as repo_id", "concat('src/', id, '.ts') as id", "'file' as kind", "cast(null as string) as parent",
        "concat('src/', id, '.ts') as path", "'other' as layer", "1L as loc", "0.5D as churn", "1L as commits",
        "1L as authors", "1000L as last_changed_at",
    )
    repo = spark.createDataFrame(
        [("big", "big", None, "main", 1000, 90, 60_000, 1, 1, {"go": 1.0})],
        schemas.REPOS + ", files long, loc long, commits long, languages map<string,double>",
    )
    none = spark.createDataFrame([], schemas.EDGES), spark.createDataFrame([], schemas.COCHANGES)
    lines = documents.document_lines(repo, nodes, *none)
    assert not documents.document_sizes(lines).first().within_limit
    documents.write_documents(lines, str(tmp_path / "out"))
    back = documents.document_tables(documents.read_documents(spark, str(tmp_path / "out")))["nodes"]
    assert back.select("id").exceptAll(nodes.select("id")).count() == 0 and back.count() == 60_000


def _folder(root, docs):
    """Documents as folders of part files; a document is a list of parts, a part a list of lines."""
    for repo, parts in docs.items():
        (root / f"repo_id={repo}").mkdir(parents=True)
        for k, part in enumerate(parts):
            (root / f"repo_id={repo}" / f"part-{k:05}.txt").write_text("".join(line + "\n" for line in part))


HEAD = (
    '{"schemaVersion":"1.0","repo":{"name":"r","remoteUrl":null,"analyzedAt":"2026-01-01T00:00:00Z","defaultBranch":"main",'
    '"analysisWindowDays":90,"stats":{"files":1,"loc":1,"commits":1,"languages":{"go":1}}},"nodes":['
)
EDGES, PAIRS, END = '],"edges":[', '],"cochanges":[', "]}"


def _node(n, **changes):
    node = {"id": f"n{n}", "kind": "file", "parent": None, "path": f"n{n}", "layer": "other", "loc": n, "churn": 0,
            "commits": 1, "authors": 1, "lastChangedAt": None, "description": None, "descriptionSource": None}
    return json.dumps({**node, **changes}, separators=(",", ":"))


@pytest.mark.parametrize("width", ["134217728", "300"])
def test_documents_line_by_line(spark, tmp_path, width):
    """Elements over many blocks and part files equal the document read whole."""
    edge = '{"source":"n1","target":"n2","kind":"import","weight":1}'
    pair = '{"a":"n1","b":"n2","count":3}'
    nodes = [("," if k else "") + _node(k) for k in range(60)]
    _folder(tmp_path, {
        "one": [[HEAD, *nodes[:7]], nodes[7:31], [*nodes[31:], EDGES], [edge, "," + edge, PAIRS, pair, END]],
        "a%20b": [[HEAD], [EDGES, PAIRS], [], [END]],
        "other-version": [[HEAD.replace("1.0", "2.0"), EDGES, PAIRS, END]],
        "bad-node": [[HEAD, *nodes[:5], "," + _node(5, loc="x"), *nodes[6:9], EDGES, PAIRS, END]],
        "bad-edge": [[HEAD, EDGES, edge], ['  ,{"source":"n1"}'.strip(), PAIRS, END]],
    })
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    try:
        lines = documents.read_lines(spark, str(tmp_path))
        assert lines.where("repo_id = 'one' AND section = 0 AND n IS NOT NULL").orderBy("n").select("n").collect() == [
            (k,) for k in range(60)
        ]
        got = documents.line_tables(lines)
        whole = documents.read_documents(spark, str(tmp_path)).cache()
        want = documents.document_tables(whole)
        for name in ("nodes", "edges", "cochanges", "repos"):
            assert rows(got[name]) == rows(want[name]), name
        assert got["nodes"].count() == 60
        assert rows(got["status"]) == rows(documents.load_status(whole).drop("raw"))
        assert {(r.repo_id, r.detail) for r in got["status"].where("status <> 'ok'").collect()} == {
            ("other-version", "schemaVersion is not supported: 2.0"), ("bad-node", "not a node at index 5"),
            ("bad-edge", "not an edge at index 1"),
        }
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _named_documents(spark, names, count):
    none = spark.createDataFrame([], schemas.EDGES), spark.createDataFrame([], schemas.COCHANGES)
    repos = spark.createDataFrame(
        [(name, name, None, "main", 1000, 90, count, 1, 1, {"go": 1.0}) for name in names],
        schemas.REPOS + ", files long, loc long, commits long, languages map<string,double>",
    )
    nodes = spark.range(count * len(names)).select(
        F.get(F.array(*map(F.lit, names)), (F.col("id") % len(names)).cast("int")).alias("repo_id"),
        F.col("id").cast("string").alias("id"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("parent"),
        F.lit("p").alias("path"), F.lit("other").alias("layer"), F.lit(1).cast("long").alias("loc"),
        F.lit(0.5).alias("churn"), F.lit(1).cast("long").alias("commits"), F.lit(1).cast("long").alias("authors"),
        F.lit(None).cast("long").alias("last_changed_at"),
    )
    return documents.document_lines(repos, nodes, *none)


def test_lines_of_a_table_are_those_of_the_folder(spark, tmp_path):
    """Documents in several parts; what lay in the folder before is gone."""
    names = ["a b", "c", "\u00e9"]
    lines = _named_documents(spark, names, 200)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.txt").write_text("gone")
    documents.write_documents(lines, str(tmp_path / "out"))
    assert all(p.name.startswith("part-") for p in (tmp_path / "out").rglob("*") if p.is_file())
    folder, table_ = documents.read_lines(spark, str(tmp_path / "out")), documents.ordered_lines(lines)
    assert rows(table_.select(folder.columns)) == rows(folder)
    tables = documents.line_tables(table_)
    assert rows(tables["status"]) == [(name, "ok", None) for name in sorted(names)]
    assert tables["nodes"].count() == 600


def test_document_queries_hold_no_whole_document(spark, monkeypatch):
    from commitloom.plans.queries import QUERIES

    monkeypatch.setattr(documents, "documents", None)
    for name in ("document_roundtrip", "document_edges", "document_cochanges"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_broken_lines_are_malformed(spark, tmp_path):
    sound = [HEAD, _node(1), "," + _node(2), EDGES, PAIRS, END]
    broken = {
        "no-head": sound[1:], "no-end": sound[:-1], "comma": [HEAD, "," + _node(1), *sound[3:]],
        "no-comma": [HEAD, _node(1), _node(2), *sound[3:]], "json": [HEAD, '{"id":', *sound[3:]], "more": [HEAD, _node(1) + "}", *sound[3:]],
        "order": [HEAD, PAIRS, EDGES, END], "twice": [HEAD, HEAD, *sound[1:]], "after": [*sound, _node(3)],
        "text": [HEAD, "what", *sound[1:]], "late-head": [EDGES, HEAD, PAIRS, END],
    }
    _folder(tmp_path, {"sound": [sound], **{k: [v] for k, v in broken.items()}})
    tables = documents.line_tables(documents.read_lines(spark, str(tmp_path)))
    assert {r.repo_id: (r.status, r.detail) for r in tables["status"].collect()} == {
        "sound": ("ok", None), **dict.fromkeys(broken, ("malformed", "not valid JSON")),
    }
    assert rows(tables["nodes"], "repo_id", "id") == [("sound", "n1"), ("sound", "n2")]


def test_enrichment_hook(analysed):
    assert analyze.enrich(analysed, lambda nodes: nodes).nodes.columns == analysed.nodes.columns
    with pytest.raises(ValueError):
        analyze.enrich(analysed, lambda nodes: nodes.drop("loc"))
    with pytest.raises(ValueError):
        analyze.enrich(analysed, lambda nodes: nodes.withColumn("churn", F.lit(2.0)))


def _plain_stats(ts):
    """Interval statistics restated in plain Python."""
    ts = sorted(ts)
    if len(ts) < 2:
        return (max(0, len(ts) - 1), 0, 0.0, 0, 0, 0, 0.0)
    gaps = sorted(b - a for a, b in zip(ts, ts[1:]))
    at = lambda p: gaps[min(len(gaps) - 1, p * len(gaps) // 100)]
    rate = len(gaps) / (ts[-1] - ts[0]) * 1000
    lows = [sum(1 for x in ts[i + 1:] if x <= t + 1000) for i, t in enumerate(ts) if t + 1000 <= ts[-1]]
    return (len(gaps), ts[-1] - ts[0], rate, at(50), at(95), gaps[-1], float(min(lows)) if lows else rate)


def test_rates_against_brute_force(spark):
    import random

    rng = random.Random(5)
    series = {
        "dense": [rng.randrange(5000) for _ in range(300)],
        "edge": [599_000 + rng.randrange(3000) for _ in range(80)] + [600_000, 600_000, 601_000],
        "sparse": [rng.randrange(5_000_000) for _ in range(40)],
        "one": [7], "short": [0, 3, 3, 900], "steady": list(range(0, 30_000, 250)),
    }
    rows_ = [(name, t) for name, listed in series.items() for t in listed]
    events = table(spark, rows_, "series string, ts long").cache()
    stats = {r.series: tuple(r)[1:] for r in rates.interval_stats(events).collect()}
    worst = {r.series: r.worst_rate for r in rates.worst_second(events).collect()}
    for name, listed in series.items():
        want = _plain_stats(listed)
        assert (*stats[name], worst[name]) == pytest.approx(want), name

