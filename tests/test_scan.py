import io
import tarfile

import pytest
from support import files, rows, table

from commitloom.functions import fixed_values as fv
from commitloom.functions import globs, measures, paths, text
from commitloom.operators import reports, scan, search
from commitloom.options import Options, merge_excludes
from commitloom.sources import tree
from pyspark.sql import functions as F

OPTIONS = Options(anchor="2026-01-01T00:00:00Z")


def _one(spark, values, expression, schema="v string"):
    df = table(spark, [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r.got for r in df.select("i", expression.alias("got")).orderBy("i").collect()]


def test_line_count(spark):
    cases = [
        (b"", 0), (b"a\r\nb\rc", 3), (b"\xc2\xa0\n", 0), (b"\xef\xbb\xbf\n", 0), (b"\xc2", 1),
        (b"\xe2\x80\n", 1), (b"\xc2\x85x", 1), (b"\x1c", 1), (b"a\n\n  \n b", 2), (b"\n", 0),
        (b" \t\x0b\x0c", 0), (b"x", 1), (b"\xe3\x80\x80\xe2\x80\xa8\n#", 1), (b"\n" * 70000 + b"z", 1),
    ]
    got = _one(spark, [bytearray(b) for b, _ in cases], measures.line_count(F.col("v")), "v binary")
    assert got == [n for _, n in cases]


def test_binary_looks_at_the_first_chunk_only(spark):
    cases = [b"a\0", b"a" * 65535 + b"\0", b"a" * 65536 + b"\0", b""]
    assert _one(spark, [bytearray(c) for c in cases], measures.is_binary(F.col("v")), "v binary") == [
        True, True, False, False,
    ]


def test_language(spark):
    cases = {
        "a/b.PY": "python", "Makefile": "make", "x/Dockerfile.prod": "dockerfile", "MAKEFILE": "unknown",
        ".gitignore": "unknown", "a.d/x": "unknown", "Jenkinsfile": "groovy", "a.b.ts": "typescript",
        "Dockerfile.py": "python", "x.unknownext": "unknown", "dir.py/": "unknown", "r.R": "r",
    }
    assert _one(spark, list(cases), measures.language(F.col("v"))) == list(cases.values())


def test_layer(spark):
    cases = {
        "src/service.py": "backend", "src/app.tsx": "frontend", "web/api.ts": "frontend",
        "server/api.ts": "backend", "tests/test_thing.py": "test", "src/thing.test.ts": "test",
        "frontend/widget.spec.tsx": "test", ".github/workflows/ci.yml": "infra",
        "sub/.github/ci.yml": "other", "deploy/Dockerfile": "infra", "infra/main.tf": "infra",
        "README.md": "other", "weird": "other", "src/App.TSX": "frontend", "deploy/DOCKERFILE": "infra",
        "test": "test", "a/fixtures/x.json": "test", "docker-compose.dev.yml": "infra",
    }
    assert _one(spark, list(cases), measures.layer(F.col("v"))) == list(cases.values())
    rules = {"src/api/**": "backend", "src/**": "infra"}
    cases = {"src/api/t.css": "backend", "src/thing.test.ts": "infra", "web/api.ts": "frontend"}
    assert _one(spark, list(cases), measures.layer(F.col("v"), rules)) == list(cases.values())


def test_excludes(spark):
    cases = {
        "node_modules": True, "a/node_modules/x.js": True, "docs/LOGO.PNG": True, "Node_Modules": True,
        "src/builder/index.ts": False, "src/node_modules_helper.ts": False, "src/Main.TS": False,
        ".git/config": True, "a/dist/b": True, "x.d.ts": True, "go.sum": True, "a.snap/b": True,
        "README.md": False, ".github/workflows/ci.yml": False, "docs/adr/x.md": False,
    }
    expression = globs.matches_any(F.col("v"), fv.DEFAULT_EXCLUDES, subtree=True)
    assert _one(spark, list(cases), expression) == list(cases.values())
    assert _one(spark, ["a"], globs.matches_any(F.col("v"), ())) == [False]


@pytest.mark.parametrize(
    "glob, hits, misses",
    [
        ("src/*.ts", ["src/a.ts", "src/.ts"], ["src/a/b.ts", "x/src/a.ts"]),
        ("src/**", ["src", "src/a", "src/a/b"], ["srcx", "a/src"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("**/.secret", [".secret", "n/.secret"], ["x.secret"]),
        ("*.{js,ts}", ["a.js", "b.ts"], ["a.jsx", "d/a.js"]),
        ("a?[0-9].c", ["ab1.c"], ["a1.c", "a/1.c", "abx.c"]),
    ],
)
def test_globs(spark, glob, hits, misses):
    got = _one(spark, hits + misses, globs.matches_any(F.col("v"), [glob]))
    assert got == [True] * len(hits) + [False] * len(misses)


def test_merge_excludes_keeps_order():
    assert merge_excludes(["a", "b"], ["b", "c"]) == ("a", "b", "c")


def _modules(spark, *listed):
    df = table(spark, [("r", p, loc, layer) for p, loc, layer in listed],
               "repo_id string, path string, loc long, layer string")
    placed = scan.assign_modules(df)
    return (
        {r.path: r.parent for r in placed.collect()},
        {r.parent: (r.loc, r.layer) for r in scan.module_nodes(placed).collect()},
    )


def test_descent_needs_more_than_the_share(spark):
    seven = [(f"src/x{i}/a.py", 1, "backend") for i in range(7)]
    parents, modules = _modules(spark, *seven, *[(f"d/{i}", 1, "other") for i in range(3)])
    assert set(modules) == {"src/", "d/"}
    parents, modules = _modules(
        spark, *seven, ("src/main.py", 5, "test"), ("src/x0/deep/b.py", 9, "frontend"),
        ("d/1", 0, "other"), ("root.md", 1, "other"),
    )
    assert parents["src/x0/deep/b.py"] == "src/x0/" and parents["src/main.py"] == "src/"
    assert parents["d/1"] == "d/" and parents["root.md"] is None
    assert modules["src/x0/"] == (10, "frontend") and modules["d/"] == (0, "other")


def test_dominant_layer_ties(spark):
    _, modules = _modules(
        spark, ("a/1", 5, "frontend"), ("a/2", 5, "backend"), ("b/1", 5, "test"), ("b/2", 5, "infra"),
        ("root", 1, "other"),
    )
    assert modules == {"a/": (10, "backend"), "b/": (10, "infra")}


def test_scan_of_a_tree(spark):
    content = {
        "src/a.py": "x = 1\n\ny = 2\n", "src/b.bin.py": b"\0\n", "data/big.json": "1\n" * 5001,
        "data/edge.json": "1\n" * 5000, "long.py": "1\n" * 5001, "src/logo.png": b"x",
    }
    inputs = files(spark, content).unionByName(
        spark.createDataFrame([("r", "gone.py", None)], "repo_id string, path string, content binary")
    )
    measured = scan.measure_files(scan.exclude_paths(inputs, OPTIONS.excludes), OPTIONS).cache()
    kept = scan.drop_data_blobs(measured, OPTIONS)
    assert rows(scan.totals(kept), "files", "loc") == [(5, 2 + 0 + 5000 + 5001 + 0)]
    got = {r.code: (r["count"], r.detail) for r in scan.scan_warnings(measured, OPTIONS).collect()}
    assert got == {
        "binary-file": (1, "src/b.bin.py"), "data-blob": (1, "data/big.json"),
        "unreadable-file": (1, "gone.py"),
    }
    shares = scan.language_shares(kept)
    assert rows(shares, "language", "loc") == [("json", 5000), ("python", 5003)]
    assert scan.top_languages(shares).first().languages == "python 50% · json 50%"
    assert set(scan.language_map(shares).first().languages) == {"json", "python"}
    empty = scan.language_shares(kept.where(F.col("loc") == 0))
    assert empty.count() == 0


def test_inventory_warnings(spark):
    listing = table(
        spark, [("r", "b", "symlink"), ("r", "a", "symlink"), ("r", "s", "other"), ("r", "d", "unreadable-directory"), ("r", "f", "file")],
        "repo_id string, path string, entry_kind string",
    )
    assert rows(scan.inventory_warnings(listing), "code", "count", "detail") == [
        ("irregular-file-skipped", 1, "s"), ("symlink-skipped", 2, "a"), ("unreadable-directory", 1, "d"),
    ]


def test_tree_archives(spark, tmp_path):
    content = {
        "r1/0": {"src/__init__.py": b"", ".github/ci.yml": b"a: 1\n", "b c+d.json": b"1\n" * 300},
        "r1/1": {"src/_x.py": b"a\r\nb\rc\n\n \xc2\xa0\n"},
        "r2/0": {"x/nul.c": b"a\n" * 99 + b"\0\n", "node_modules/x.js": b"a"},
    }
    for name, listed in content.items():
        target = tmp_path / f"{name}.tar"
        target.parent.mkdir(exist_ok=True)
        with tarfile.open(target, "w") as tar:
            for path, data in listed.items():
                entry = tarfile.TarInfo(path)
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))
            if name == "r2/0":
                for path, kind in (("link", tarfile.SYMTYPE), ("pipe", tarfile.FIFOTYPE), ("x", tarfile.DIRTYPE)):
                    entry = tarfile.TarInfo(path)
                    entry.type = kind
                    tar.addfile(entry)
    entries = tree.read_entries(spark, str(tmp_path)).cache()
    listed = scan.exclude_paths(tree.files(entries), OPTIONS.excludes)
    got = {r[:2]: r[4:6] for r in rows(scan.measure_files(listed, OPTIONS))}
    assert got == {
        ("r1", "src/__init__.py"): (0, False), ("r1", ".github/ci.yml"): (1, False),
        ("r1", "b c+d.json"): (300, False), ("r1", "src/_x.py"): (3, False), ("r2", "x/nul.c"): (0, True),
    }
    assert rows(scan.inventory_warnings(tree.inventory(entries)), "repo_id", "code", "detail") == [
        ("r2", "irregular-file-skipped", "pipe"), ("r2", "symlink-skipped", "link"),
    ]


def _tar(path, members):
    """(name, type, content or other name) members in an archive."""
    path.parent.mkdir(exist_ok=True)
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as tar:
        for name, kind, data in members:
            entry = tarfile.TarInfo(name)
            entry.type = kind
            if kind == tarfile.REGTYPE:
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))
            else:
                entry.linkname = data or ""
                tar.addfile(entry)


@pytest.mark.parametrize("width", [1, 512, 1 << 20])
def test_archives_by_ranges(spark, tmp_path, width):
    file, hard = tarfile.REGTYPE, tarfile.LNKTYPE
    _tar(tmp_path / "r" / "0.tar", [
        ("./a/b", file, b"first"), ("link", hard, "a/b"), ("a/b", file, b"second"), ("again", hard, "./a/b"),
        ("lost", hard, "nowhere"), ("early", hard, "z"), ("z", file, b"z" * 2000), ("empty", file, b""),
        ("d" * 150 + "/" + "e" * 90, file, b"long name"), ("sym", tarfile.SYMTYPE, "z"), ("dir", tarfile.DIRTYPE, None),
    ])
    _tar(tmp_path / "q q" / "7.tar", [(f"f{k}", file, str(k).encode() * k) for k in range(50)])
    (tmp_path / "r" / "1.tar").write_bytes(b"\0" * 10240)
    got = {(r.repo_id, r.path, r.entry_kind, bytes(r.content) if r.content is not None else None)
           for r in tree.read_entries(spark, str(tmp_path), width).collect()}
    want = {("q q", f"f{k}", "file", str(k).encode() * k) for k in range(50)} | {
        ("r", "a/b", "file", b"first"), ("r", "link", "file", b"first"), ("r", "a/b", "file", b"second"),
        ("r", "again", "file", b"second"), ("r", "lost", "file", None), ("r", "early", "file", None),
        ("r", "z", "file", b"z" * 2000), ("r", "empty", "file", b""), ("r", "d" * 150 + "/" + "e" * 90, "file", b"long name"),
        ("r", "sym", "symlink", None),
    }
    assert got == want


def test_archive_tasks_follow_the_bytes_and_not_the_ranges(spark, tmp_path):
    _tar(tmp_path / "r" / "0.tar", [(f"f{k}", tarfile.REGTYPE, b"x" * k) for k in range(300)])
    members = tree.list_members(spark, str(tmp_path), 512)
    assert members.select("slot").distinct().count() == 300
    entries = tree.read_members(members)
    assert entries.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert entries.where("length(content) = substr(path, 2)").count() == 300


def test_archive_of_more_than_two_gigabytes(spark, tmp_path):
    """A member too large for a row is passed over; the others are read by several tasks."""
    path, large = tmp_path / "r" / "0.tar", 3 << 30
    path.parent.mkdir()
    with open(path, "wb") as out:
        def member(name, data):
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            out.write(entry.tobuf(tarfile.GNU_FORMAT) + data + b"\0" * (-len(data) % 512))

        for k in range(20):
            member(f"before{k}", b"x" * 100_000)
        entry = tarfile.TarInfo("large")
        entry.size = large
        out.write(entry.tobuf(tarfile.GNU_FORMAT))
        out.seek(large, 1)  # a hole, so the file takes no room
        for k in range(20):
            member(f"after{k}", b"y" * 100_000)
        out.write(b"\0" * 1024)
    members = tree.list_members(spark, str(tmp_path), 1 << 20)
    assert members.select("slot").distinct().count() >= 4
    entries = tree.read_members(members)
    tasks = entries.withColumn("task", F.spark_partition_id())
    found = {r.path: (r.size, r.task) for r in tasks.select("path", "task", F.length("content").alias("size")).collect()}
    assert {p: s for p, (s, _) in found.items()} == {
        **{f"{w}{k}": 100_000 for w in ("before", "after") for k in range(20)}, "large": None,
    }
    assert len({t for _, t in found.values()}) > 1


def test_join_path(spark):
    cases = [("a/b", "../c"), ("a", "../../x"), ("", "./y"), ("a", "b//./c"), ("a", ".."), ("a", "")]
    got = _one(spark, cases, paths.join_path(F.col("d"), F.col("r")), "d string, r string")
    assert got == ["a/c", None, "y", "a/b/c", "", "a"]


def test_repo_names_and_urls(spark):
    cases = [
        ("git@github.com:o/n.git", "n", "https://github.com/o/n/blob/feat/x/a%20b/c(1).py"),
        ("https://user@github.com:443/o/n/", "n", "https://github.com/o/n/blob/feat/x/a%20b/c(1).py"),
        ("ssh://git@GitHub.com/o/n", "n", "https://github.com/o/n/blob/feat/x/a%20b/c(1).py"),
        ("https://gitlab.com/o/n", "n", None), ("https://github.com/o", "o", None),
        ("https://github.com/o/n/x", "x", None), ("https://evil.com/github.com/o/n", "n", None),
        (None, "dir", None), ("", "dir", None),
    ]
    values = [c[0] if c[0] is not None else None for c in cases]
    assert _one(spark, values, paths.repo_name(F.col("v"), F.lit("dir"))) == [c[1] for c in cases]
    url = text.hosted_node_url(F.col("v"), F.lit("feat/x"), F.lit("/a b/c(1).py"), F.lit("file"))
    assert _one(spark, values, url) == [c[2] for c in cases]
    root = text.hosted_node_url(F.col("v"), F.lit("m"), F.lit("/"), F.lit("file"))
    assert _one(spark, ["git@github.com:o/n"], root) == ["https://github.com/o/n/tree/m"]


def test_display_strings(spark):
    numbers = [0, 999, 1000, 1250, 999949, 1234567, -1]
    assert _one(spark, numbers, text.compact_count(F.col("v")), "v long") == [
        "0", "999", "1.0k", "1.3k", "999.9k", "1.2m", "0",
    ]
    assert _one(spark, numbers[:6], text.grouped_integer(F.col("v")), "v long")[-1] == "1,234,567"
    assert _one(spark, [0.0, 0.004, 0.005, 0.125, 0.995, 7.0, None], text.percent(F.col("v")), "v double") == [
        "0%", "0%", "1%", "13%", "100%", "100%", "0%",
    ]
    day = 86400
    ages = [0, 59, 60, 7199, 2 * day, 7 * day, 30 * day, 364 * day, 365 * day, 800 * day, -5]
    now = 10**9
    got = _one(spark, [now - a for a in ages], text.relative_time(F.col("v"), F.lit(now)), "v long")
    assert got == [
        "just now", "just now", "1 minute ago", "1 hour ago", "2 days ago", "1 week ago", "1 month ago",
        "12 months ago", "1 year ago", "2 years ago", "just now",
    ]
    assert _one(spark, [None], text.relative_time(F.col("v"), F.lit(now)), "v long") == ["—"]
    assert _one(spark, [300], text.iso_utc(F.col("v")), "v long") == ["1970-01-01T00:05:00.000Z"]


def _score(haystack, query):
    """The search score restated in plain Python."""
    low, wanted = haystack.lower(), query.lower()
    found, cursor = [], 0
    for ch in wanted:
        at = low.find(ch, cursor)
        if at < 0:
            return None
        found.append(at)
        cursor = at + 1
    total, previous = 0.0, -2
    for at in found:
        total += 1 + (8 if at == previous + 1 else 0) + (6 if at == 0 or low[at - 1] in "/.-_ " else 0)
        previous = at
    total += 12 * (wanted in low) + 10 * low.startswith(wanted)
    return round(total - 0.4 * found[0] - 0.06 * len(haystack), 6)


def test_search_against_brute_force(spark):
    names = ["src/app/main.ts", "src/App.ts", "a-b_c d", "lib/mapper.py", "maps/a.ts", "x/y/z", "MAIN.md"]
    names += [f"m{i}/app{i}.ts" for i in range(12)]
    nodes = table(spark, [("r", n, n) for n in names], "repo_id string, id string, path string")
    queries = ["app", " MA ", "bc", "s/a", "zz", "", "ap1", "m"]
    got = search.search(nodes, queries).collect()
    for query in {q.strip() for q in queries} - {""}:
        scored = [(-_score(n, query), n) for n in names if _score(n, query) is not None]
        want = [(n, -s) for s, n in sorted(scored)[:7]]
        mine = sorted((r.rank, r.path, round(r.score, 6)) for r in got if r.query == query)
        assert [(p, s) for _, p, s in mine] == want
    assert search.search(nodes, [" "]).count() == 0


def test_size_and_cold_share(spark):
    nodes = table(
        spark,
        [("r", "a", "file", 0, 0.0), ("r", "b", "file", 121, 0.0), ("r", "c", "file", 484, 0.5), ("r", "m/", "module", 0, 0.0)],
        "repo_id string, id string, kind string, loc long, churn double",
    )
    assert rows(reports.cold_share(nodes), "cold", "files", "mostly_cold") == [(2, 3, True)]
    got = {r.kind: r for r in reports.size_concentration(nodes).collect()}
    assert got["module"].radius_ratio == 1 and got["module"].largest_share == 1
    assert got["file"].radius_ratio == round(3.5 / 2.5, 6)
