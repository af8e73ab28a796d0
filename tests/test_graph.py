import random

from support import REPO, rows, table, universe

from commitloom import schemas
from commitloom.operators import cochange, graph, quality, reports, resolution

NODES = [
    ("a/", "module", None, "backend", 30), ("b/", "module", None, "frontend", 20),
    ("c/", "module", None, "other", 0),
    ("a/x", "file", "a/", "backend", 20), ("a/y", "file", "a/", "test", 10),
    ("b/z", "file", "b/", "frontend", 20), ("root", "file", None, "other", 5),
    ("lone", "file", "ghost/", "backend", 1),
]
EDGES = [
    ("a/x", "b/z", 1), ("a/y", "a/x", 1), ("root", "a/x", 1), ("a/x", "a/x", 1),
    ("a/", "b/", 1), ("a/x", "b/", 1), ("a/x", "missing", 1), ("root", "lone", 1),
]


def _edges(spark, listed=EDGES):
    return table(spark, [(REPO, s, t, "import", w) for s, t, w in listed], schemas.EDGES)


def _near(spark, nodes):
    return graph.neighbours(graph.valid_edges(_edges(spark), nodes))


def test_valid_edges_and_neighbours(spark):
    nodes = universe(spark, *NODES)
    valid = graph.valid_edges(_edges(spark), nodes)
    assert set(rows(valid, "source", "target")) == {
        ("a/x", "b/z"), ("a/y", "a/x"), ("root", "a/x"), ("a/x", "a/x"), ("a/", "b/"), ("root", "lone"),
    }
    near = graph.neighbours(valid)
    assert {o for i, o in rows(near, "id", "other") if i == "a/x"} == {"a/x", "a/y", "b/z", "root"}


def test_one_hop_scope_and_lift(spark):
    nodes = universe(spark, *NODES)
    near = _near(spark, nodes)
    foci = table(
        spark, [(REPO, "a/", True), (REPO, "b/", False), (REPO, "root", True), (REPO, "nope", True)],
        "repo_id string, focus string, unfolded boolean",
    )
    assert set(rows(graph.one_hop(foci, nodes, near), "focus", "id")) == {
        ("a/", "a/"), ("a/", "b/"), ("a/", "a/x"), ("a/", "a/y"), ("b/", "b/"), ("b/", "a/"),
        ("root", "root"), ("root", "a/x"), ("root", "lone"),
    }
    assert set(rows(graph.scopes(foci, nodes, near), "focus", "id")) == {
        ("a/", "a/"), ("a/", "a/x"), ("a/", "a/y"), ("a/", "b/"), ("b/", "b/"), ("b/", "b/z"), ("b/", "a/"),
    }
    lifted = graph.lift_edges(graph.valid_edges(_edges(spark), nodes), nodes)
    assert rows(lifted, "source", "target") == [("a/", "b/"), ("root", "a/"), ("root", "ghost/")]


def _fixpoint(candidates, near):
    """Edgeless removal repeated until nothing changes."""
    alive = set(candidates)
    while True:
        dead = {
            n for n in alive
            if not any(o in alive for i, o in near if i == n)
            and not (candidates[n][0] == "module" and any(candidates[m][1] == n for m in alive))
        }
        if not dead:
            return alive
        alive -= dead


def test_connected_reaches_the_fixpoint(spark):
    rng = random.Random(3)
    nodes, edges, want = [], [], set()
    for r in range(25):
        repo = f"r{r}"
        listed = {f"m{i}/": ("module", None) for i in range(4)}
        listed |= {f"f{i}": ("file", rng.choice([None, *[f"m{j}/" for j in range(4)]])) for i in range(8)}
        pairs = [(a, b) for a in listed for b in listed if listed[a][0] == listed[b][0] and rng.random() < 0.06]
        kept = {n: v for n, v in listed.items() if rng.random() < 0.8}
        near = pairs + [(b, a) for a, b in pairs]
        want |= {(repo, n) for n in _fixpoint(kept, near)}
        nodes += [(repo, n, k, p, n, "backend", 1) for n, (k, p) in kept.items()]
        edges += [(repo, a, b, listed[a][0]) for a, b in near]
    candidates = table(spark, nodes, schemas.UNIVERSE)
    near = table(spark, edges, "repo_id string, id string, other string, level string").distinct()
    assert set(rows(graph.connected(candidates, near), "repo_id", "id")) == want


def test_layers_visible_and_edgeless(spark):
    nodes, edges = universe(spark, *NODES), _edges(spark)
    kept, whole, hidden = graph.filter_layers(nodes, edges, ["backend", "frontend"])
    assert set(rows(kept, "id")) == {("a/",), ("b/",), ("a/x",), ("b/z",), ("lone",)}
    assert rows(whole, "source", "target") == [("a/", "b/"), ("a/x", "a/x"), ("a/x", "b/"), ("a/x", "b/z")]
    assert rows(hidden, "hidden", "visible") == [(3, 5)]
    near = _near(spark, nodes)
    focus = table(spark, [(REPO, "a/")], "repo_id string, focus string")
    scope = graph.scopes(focus, nodes, near).select("repo_id", "id")
    shown, counts = graph.visible(nodes, near, ["backend", "test"], scope)
    assert set(rows(shown, "id")) == {("a/",), ("a/x",), ("a/y",)}
    assert rows(counts, "hidden_by_scope", "hidden_by_degree", "visible") == [(4, 0, 3)]
    top = table(spark, [(REPO, "a/")], "repo_id string, id string")
    shown, counts = graph.visible(nodes, near, ["backend"], scope, materialised=top)
    assert shown.count() == 0
    assert rows(counts, "hidden_by_scope", "hidden_by_degree", "visible") == [(4, 0, 0)]
    extra = universe(spark, *NODES, ("quiet", "file", "a/", "other", 3))
    assert rows(graph.edgeless(extra, edges), "id") == [("quiet",)]


def test_reading_order(spark):
    listed = [(f"s{i}", "file", None, "backend", 10) for i in range(7)]
    listed += [("core", "file", None, "backend", 1200), ("barrel", "file", None, "other", 1), ("t", "file", None, "test", 4)]
    listed += [("iso", "file", None, "other", 9)]
    edges = [(f"s{i}", "core", 1) for i in range(7)] + [(f"s{i}", "barrel", 1) for i in range(7)]
    edges += [("t", "core", 1), ("core", "core", 1)]
    got = reports.reading_order(universe(spark, *listed), _edges(spark, edges))
    assert rows(got.where("category = 'core'"), "rank", "id", "metric", "metric_label", "total") == [
        (1, "core", 9600, "8 importers · 1,200 lines", 2), (2, "barrel", 7, "7 importers · 1 line", 2),
    ]
    assert rows(got.where("category = 'entry-points'"), "rank", "id", "total") == [(i + 1, f"s{i}", 7) for i in range(5)]
    assert rows(got.where("category = 'tests'"), "id", "metric_label") == [("t", "1 import")]


def test_partners_and_reports(spark):
    nodes = universe(spark, *NODES).selectExpr(
        "*", "0.5 as churn", "1L as commits", "1L as authors",
        "if(id = 'root', null, 1000L) as last_changed_at",
    )
    pairs = table(
        spark,
        [(REPO, "file", "a/x", "a/y", 3), (REPO, "file", "a/x", "b/z", 9), (REPO, "file", "a/x", "lone", 3),
         (REPO, "file", "a/x", "root", 1), (REPO, "module", "a/", "b/", 4), (REPO, "file", "a/", "a/x", 9)],
        schemas.COCHANGES,
    )
    top = cochange.top_partners(cochange.partners(pairs, nodes))
    assert [p for _, p in rows(top.where("id = 'a/x'"), "rank", "partner")] == ["b/z", "a/y", "lone"]
    hidden = cochange.hidden_cochanges(pairs, _edges(spark))
    assert set(rows(hidden, "a", "b")) == {("a/x", "lone"), ("a/", "a/x")}
    repo = lambda commits: table(
        spark, [(REPO, None, "main", 90, commits)],
        "repo_id string, remote_url string, default_branch string, window_days int, commits long",
    )
    report = {r.id: r for r in reports.node_report(nodes, pairs, repo(5), now=4600).collect()}
    assert report["a/"].files == "2" and report["a/x"].files == "—" and report["c/"].files == "0"
    assert report["a/x"].partners == "b/z, a/y, lone" and report["a/x"].last_change == "1 hour ago"
    assert report["root"].notice == "node-out-of-window"
    assert report["root"].last_change == "no change in last 90 days" and report["a/x"].url is None
    quiet = reports.node_report(nodes, pairs, repo(0), now=4600)
    assert {r.notice for r in quiet.collect()} == {"repo-zero-history"}
    listed = {r.id: r for r in reports.cochange_report(nodes, pairs, repo(5)).collect()}
    assert listed["a/x"].partner_count == 4 and listed["a/x"].partners.startswith("b/z 9 commits; a/y 3 commits")
    assert listed["c/"].state == "empty" and "3 or more commits of the last 90 days" in listed["c/"].cause
    silent = {r.id: r.state for r in reports.cochange_report(nodes, pairs, repo(0)).collect()}
    assert silent["c/"] == "suppressed" and silent["a/x"] == "listed"


def test_table_checks(spark):
    nodes, edges = universe(spark, *NODES), _edges(spark)
    files = edges.join(nodes.where("kind = 'file'").selectExpr("repo_id", "id as source"), ["repo_id", "source"])
    assert quality.edge_weights(resolution.module_edges(files, nodes), files, nodes).count() == 0
    off = resolution.module_edges(files, nodes).selectExpr("repo_id", "source", "target", "kind", "weight + 1 as weight")
    assert rows(quality.edge_weights(off, files, nodes), "source", "target", "expected", "stated") == [("a/", "b/", 1, 2)]
    pairs = table(
        spark, [(REPO, "file", "b/z", "a/x", 3), (REPO, "file", "a/", "a/x", 3), (REPO, "file", "a/x", "a/y", 2)],
        schemas.COCHANGES,
    )
    assert rows(quality.pair_rules(pairs, nodes), "path", "message") == [
        ("a/ a/x", "must be of one kind"), ("a/x a/y", "count must be >= 3"), ("b/z a/x", "a must come before b"),
    ]
    assert rows(quality.pair_rules(pairs, nodes, max_pairs=1), "path", "message")[-1] == (
        "file", "must NOT have more than 1 pairs"
    )
    assert rows(quality.unmet_counts(nodes, {"module": 3, "file": 4}), "kind", "expected", "found") == [("file", 4, 5)]
    assert quality.differences(nodes, nodes.repartition(3)).count() == 0
    assert rows(quality.differences(nodes, nodes.where("id <> 'lone'")), "id", "only_in") == [("lone", "left")]
    nulls = spark.createDataFrame([(None, "a", [1, None]), ("a", None, [None, 1]), (None, "a", [1, None])], "x string, y string, z array<int>")
    other = spark.createDataFrame([("a", None, [1, None]), (None, "a", [None, 1]), (None, "a", [1, None])], "x string, y string, z array<int>")
    assert quality.differences(nulls, nulls.repartition(2)).count() == 0
    assert rows(quality.differences(nulls, other)) == rows(
        nulls.exceptAll(other).selectExpr("*", "'left'").union(other.exceptAll(nulls).selectExpr("*", "'right'"))
    )
