"""Registered queries: each operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.functions import measures, paths, text
from commitloom.operators import (
    cochange, graph, history, python_imports, quality, renames, reports, rates, resolution,
    scan, script_imports, search,
)
from commitloom.plans import shop
from commitloom.options import merge_excludes
from commitloom.session import free, phase
from commitloom.plans.analyze import Analysis, enrich, merge_nodes
from commitloom.sources import commit_log, documents, tree

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SEARCHES = ["f12", "m3/", "M1 F", "f.ts", "3/F7", "zzz"]
SHOWN_LAYERS = ("backend", "test")


def query(function: Callable[[shop.Tables], DataFrame]) -> Callable[[shop.Tables], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(shop.Tables(spark, folder))
    return function


# ---------------------------------------------------------------- history


def touched(t: shop.Tables) -> DataFrame:
    return t.stored(
        "touched",
        lambda: history.resolve_history(
            shop.universe(t), shop.commits(t), shop.changes(t), shop.OPTIONS
        ),
    )


def activity(t: shop.Tables) -> DataFrame:
    return history.node_activity(shop.universe(t), touched(t))


def nodes(t: shop.Tables) -> DataFrame:
    """Read several times by most reports, and its activity twice for the percentile."""
    measured = t.stored("activity", lambda: activity(t))
    return t.stored("nodes", lambda: merge_nodes(shop.universe(t), history.with_churn(measured)))


def pairs(t: shop.Tables) -> DataFrame:
    return cochange.cochanges(touched(t), shop.OPTIONS)


def repos(t: shop.Tables) -> DataFrame:
    return history.repo_totals(shop.commits(t), shop.OPTIONS).select(
        "repo_id", "commits",
        F.lit("git@github.com:acme/shop.git").alias("remote_url"),
        F.lit("feat/main").alias("default_branch"),
        F.lit(shop.OPTIONS.window_days).alias("window_days"),
    )


@query
def node_activity(t):
    return activity(t).select("repo_id", "id", "kind", "commits", "authors", "last_changed_at")


@query
def module_activity(t):
    return history.module_activity(touched(t))


@query
def file_activity(t):
    return history.file_activity(touched(t))


@query
def repo_totals(t):
    totals = history.repo_totals(shop.commits(t), shop.OPTIONS)
    return totals.select(
        "repo_id", "commits", text.iso_utc(F.col("last_commit_at")).alias("last_commit_at")
    )


@query
def p95_by_kind(t):
    return history.p95_by_kind(activity(t))


@query
def churn(t):
    return history.with_churn(activity(t)).select("repo_id", "id", "kind", "churn")


@query
def hot_spots(t):
    return history.hot_spots(nodes(t)).select("repo_id", "id", "churn")


@query
def window_filter(t):
    return history.in_window(shop.commits(t), shop.OPTIONS).select(
        "repo_id", "seq", "hash", "committed_at", "author_email"
    )


@query
def rename_resolve(t):
    dated = history.dated_renames(shop.commits(t), shop.changes(t), shop.OPTIONS)
    return renames.aliases(dated)


@query
def universe_join(t):
    return touched(t).select("repo_id", "seq", "path", "id", "parent", "module", "pos")


@query
def warning_counts(t):
    options = replace(shop.OPTIONS, bulk_paths=6)
    return history.history_warnings(touched(t), shop.commits(t), options)


# ---------------------------------------------------------------- co-change


@query
def cochange_pairs(t):
    return cochange.pair_counts(touched(t), shop.OPTIONS)


@query
def cochange_top(t):
    return cochange.strongest_pairs(cochange.pair_counts(touched(t), shop.OPTIONS), 100)


@query
def bulk_skip(t):
    options = replace(shop.OPTIONS, bulk_paths=6)
    return cochange.pair_counts(touched(t), options)


@query
def partners_top3(t):
    return cochange.top_partners(cochange.partners(pairs(t), shop.universe(t)))


@query
def hidden_cochange(t):
    return cochange.hidden_cochanges(pairs(t), shop.edges(t))


@query
def cochange_report(t):
    return reports.cochange_report(shop.universe(t), pairs(t), repos(t))


@query
def unpaired_nodes(t):
    return graph.unpaired(shop.universe(t), pairs(t)).select("repo_id", "id", "kind")


# ---------------------------------------------------------------- edges, graph


def valid(t: shop.Tables) -> DataFrame:
    return graph.valid_edges(shop.edges(t), shop.universe(t))


def near(t: shop.Tables) -> DataFrame:
    return t.stored("near", lambda: graph.neighbours(valid(t)))


@query
def edge_dedup(t):
    return resolution.file_edges(shop.import_pairs(t))


@query
def module_edges(t):
    return resolution.module_edges(
        resolution.file_edges(shop.import_pairs(t)), shop.universe(t)
    )


@query
def same_kind_edges(t):
    return valid(t)


@query
def neighbour_sets(t):
    return near(t)


@query
def degrees(t):
    return graph.file_degrees(shop.edges(t), shop.universe(t)).select(
        "repo_id", "id", "in_degree", "out_degree"
    )


@query
def reading_order(t):
    return reports.reading_order(shop.universe(t), shop.edges(t))


@query
def one_hop(t):
    everything = shop.universe(t)
    foci = everything.select(
        "repo_id", F.col("id").alias("focus"), (F.col("layer") == "test").alias("unfolded")
    )
    return graph.one_hop(foci, everything, near(t))


@query
def scope_nodes(t):
    everything = shop.universe(t)
    foci = everything.select("repo_id", F.col("id").alias("focus"))
    return graph.scopes(foci, everything, near(t))


@query
def edge_lift(t):
    return graph.lift_edges(valid(t), shop.universe(t))


@query
def connected_only(t):
    candidates = shop.universe(t).where(F.col("layer").isin(*SHOWN_LAYERS))
    return graph.connected(candidates, near(t)).select("repo_id", "id", "kind")


@query
def layer_filter(t):
    return graph.filter_layers(shop.universe(t), shop.edges(t), SHOWN_LAYERS)[1]


@query
def layer_hidden(t):
    return graph.filter_layers(shop.universe(t), shop.edges(t), SHOWN_LAYERS)[2]


@query
def visible_nodes(t):
    everything, close = shop.universe(t), near(t)
    focus = everything.where(F.col("id") == "m3/").select("repo_id", F.col("id").alias("focus"))
    scope = graph.scopes(focus, everything, close).select("repo_id", "id")
    return graph.visible(everything, close, SHOWN_LAYERS, scope)[0].select("repo_id", "id")


@query
def hidden_counts(t):
    everything, close = shop.universe(t), near(t)
    focus = everything.where(F.col("id") == "m3/").select("repo_id", F.col("id").alias("focus"))
    scope = graph.scopes(focus, everything, close).select("repo_id", "id")
    top = everything.where(F.col("parent").isNull()).select("repo_id", "id")
    return graph.visible(everything, close, SHOWN_LAYERS, scope, materialised=top)[1]


@query
def edgeless_files(t):
    return graph.edgeless(shop.universe(t), shop.edges(t)).select("repo_id", "id")


@query
def member_counts(t):
    return graph.member_counts(shop.universe(t))


@query
def module_members(t):
    return graph.members(shop.universe(t))


# ---------------------------------------------------------------- scan


@query
def path_excludes(t):
    return shop.listed_documents(t).select("repo_id", "path")


@query
def user_excludes(t):
    """The user's globs on top of the default ones."""
    globs = merge_excludes(shop.SCAN_OPTIONS.excludes, ["**/*.md", "packages/src1"], ["src/**/deep", "**/*.md"])
    return scan.exclude_paths(shop.document_files(t), globs).select("repo_id", "path")


@query
def language_keys(t):
    """Keys of the language map, in its order."""
    shares = scan.language_map(scan.language_shares(shop.kept_documents(t)))
    return shares.select("repo_id", F.array_join(F.map_keys("languages"), ",").alias("languages"))


# Bytes of an archive or a log that one task of these queries reads.
RANGE_BYTES = 1 << 16


@query
def archive_entries(t):
    """Documents as tar archives with files, folders and symbolic links, read back by byte ranges."""
    entries = tree.read_entries(t.spark, shop.archive_folder(t), RANGE_BYTES)
    return entries.select("repo_id", "path", "entry_kind", F.md5("content").alias("md5"))


def _parsed_log(t: shop.Tables) -> DataFrame:
    return t.stored("log", lambda: commit_log.read_log(t.spark, shop.log_folder(t), RANGE_BYTES))


@query
def log_commits(t):
    """Orders exported as commit logs, several byte ranges each, and read back."""
    return commit_log.commits(_parsed_log(t)).select("repo_id", "hash", "committed_at", "author_email")


@query
def log_changes(t):
    parsed = _parsed_log(t)
    hashes = commit_log.commits(parsed).select("repo_id", "seq", "hash")
    return commit_log.changes(parsed).join(hashes, ["repo_id", "seq"]).select(
        "repo_id", "hash", "pos", "status", "path", "old_path"
    )


@query
def enriched_layers(t):
    """A user's function over the node table; the contract holds before and after it."""
    whole = nodes(t)
    analysis = Analysis(whole, shop.edges(t), pairs(t), repos(t), whole.limit(0))
    small = F.when(F.col("loc") < 10, "other").otherwise(F.col("layer"))
    return enrich(analysis, lambda n: n.withColumn("layer", small)).nodes.select("repo_id", "id", "kind", "layer")


@query
def loc_count(t):
    return shop.measured_documents(t).select("repo_id", "path", "loc", "is_binary")


@query
def language_detect(t):
    return shop.measured_documents(t).select("repo_id", "path", "language")


@query
def layer_classify(t):
    return shop.measured_documents(t).select("repo_id", "path", "layer")


@query
def layer_overrides(t):
    rules = {"**/src3/**": "infra", "packages/**": "frontend"}
    return shop.listed_documents(t).select(
        "repo_id", "path", measures.layer(F.col("path"), rules).alias("layer")
    )


@query
def blob_filter(t):
    return shop.kept_documents(t).select("repo_id", "path", "loc")


@query
def scan_warnings(t):
    return scan.scan_warnings(shop.measured_documents(t), shop.SCAN_OPTIONS)


@query
def scan_totals(t):
    return scan.totals(shop.kept_documents(t))


@query
def language_shares(t):
    return scan.language_shares(shop.kept_documents(t))


@query
def top_languages(t):
    return scan.top_languages(scan.language_shares(shop.kept_documents(t)))


@query
def module_derive(t):
    return scan.assign_modules(shop.kept_documents(t)).select("repo_id", "path", "parent")


@query
def dominant_layer(t):
    return scan.module_nodes(scan.assign_modules(shop.kept_documents(t)))


@query
def universe_nodes(t):
    return shop.universe(t)


# ---------------------------------------------------------------- imports


def script_resolutions(t: shop.Tables) -> DataFrame:
    path, content = F.col("path"), F.col("content")
    # contents are read once; what goes on are paths, specifiers and settings files
    read = t.stored("read", lambda: shop.script_files(t).select(
        "repo_id", "path",
        F.when(script_imports.is_settings(path, content), content).alias("content"),
        F.when(script_imports.is_script(path), script_imports.specifiers_of(content)).alias("specifiers"),
    ))
    disk = read.drop("specifiers")
    filed = script_imports.targets(disk, shop.import_universe(t, "ts"))
    sought = script_imports.lookups(script_imports.explode_specifiers(read), disk)
    t.drop("read")
    return script_imports.answers(sought, filed)


def python_resolutions(t: shop.Tables) -> DataFrame:
    return python_imports.resolve(
        python_imports.imports(python_rows(t)), shop.import_universe(t, "py")
    )


def python_rows(t: shop.Tables) -> DataFrame:
    return t.stored("python", lambda: python_imports.extract(shop.python_files(t)))


@query
def import_extract(t):
    return script_imports.extract(shop.script_files(t)).select("repo_id", "source", "specifier")


@query
def import_resolve(t):
    return script_resolutions(t).select("repo_id", "source", "specifier", "outcome", "target")


@query
def import_warnings(t):
    return resolution.import_warnings(script_resolutions(t))


@query
def import_edges(t):
    resolved = script_resolutions(t)
    members = t.stored("members", lambda: shop.import_universe(t, "ts").select("repo_id", "id", "kind", "parent"))
    free(t.spark)
    return resolution.all_edges(resolved, members)


@query
def resolution_rate(t):
    return resolution.resolution_rate(script_resolutions(t))


@query
def python_extract(t):
    return python_rows(t).select("repo_id", "source", "level", "module", "name", "broken")


@query
def python_resolve(t):
    return python_resolutions(t).select("repo_id", "source", "specifier", "outcome", "target")


@query
def python_warnings(t):
    broken = python_imports.unparsable(python_rows(t))
    return resolution.import_warnings(python_resolutions(t), broken)


@query
def edge_union(t):
    # of each language only the edges are left when the other one's files are read
    found = [
        phase(t.spark, lambda: resolution.file_edges(of(shop.Tables(t.spark, t.folder))))
        for of in (script_resolutions, python_resolutions)
    ]
    return reduce(DataFrame.unionByName, found).distinct()


# ---------------------------------------------------------------- reports, search, rates


@query
def node_report(t):
    return reports.node_report(nodes(t), pairs(t), repos(t), shop.NOW)


@query
def cold_share(t):
    return reports.cold_share(nodes(t))


@query
def size_concentration(t):
    return reports.size_concentration(shop.universe(t))


@query
def drawn_size(t):
    return shop.universe(t).select(
        "repo_id", "id", F.round(measures.radius(F.col("kind"), F.col("loc")), 9).alias("radius")
    )


@query
def fuzzy_top7(t):
    return search.search(shop.universe(t), SEARCHES).select(
        "repo_id", "query", "id", "score", "rank"
    )


@query
def interval_stats(t):
    return rates.interval_stats(shop.series(t, "user_id"))


@query
def gap_counts(t):
    return rates.gaps(shop.series(t, "event_type"))


@query
def worst_1s_rate(t):
    return rates.worst_second(shop.series(t, "user_id"))


@query
def worst_day_rate(t):
    return rates.worst_second(shop.series(t, "event_type"), width=86_400_000)


# ---------------------------------------------------------------- scalars


@query
def display_numbers(t):
    value = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        text.compact_count(F.floor(value)).alias("compact"),
        text.grouped_integer(F.floor(value)).alias("grouped"),
        text.percent(F.floor(value) / 400000).alias("percent"),
        text.counted(F.col("o_orderkey") % 3, "line").alias("counted"),
    )


@query
def relative_times(t):
    return t.orders.select(
        "o_orderkey",
        text.relative_time(
            shop.seconds(F.col("o_orderdate")) + F.col("o_orderkey") % 86400, F.lit(shop.NOW)
        ).alias("ago"),
        text.iso_utc(shop.seconds(F.col("o_orderdate"))).alias("instant"),
    )


@query
def repo_names(t):
    name, key = F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.col("c_custkey") % 6
    remote = (
        F.when(key == 0, F.concat(F.lit("git@github.com:acme/"), name, F.lit(".git")))
        .when(key == 1, F.concat(F.lit("https://github.com/o r/"), name, F.lit("/")))
        .when(key == 2, F.concat(F.lit("ssh://git@github.com:22/a(b)/"), name, F.lit(".git")))
        .when(key == 3, F.concat(F.lit("https://gitlab.com/acme/"), name))
        .when(key == 4, F.concat(F.lit("https://github.com/a/b/"), name))
    )
    return t.customer.select(
        "c_custkey",
        paths.repo_name(remote, F.lit("folder")).alias("name"),
        text.hosted_node_url(
            remote, F.lit(" main "), F.lit("src/a b+c.ts"), F.lit("file")
        ).alias("url"),
    )


# ---------------------------------------------------------------- quality


def customer_nodes(t: shop.Tables) -> DataFrame:
    """Customers as nodes, with balances that break the ranges."""
    balance = F.col("c_acctbal")
    return t.customer.select(
        F.lit("customers").alias("repo_id"),
        F.concat(F.lit("n"), (F.floor(F.col("c_custkey") / 2)).cast("string")).alias("id"),
        F.when(F.col("c_nationkey") > 20, "folder").otherwise("file").alias("kind"),
        F.lit(None).cast("string").alias("parent"),
        F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")).alias("path"),
        F.when(F.col("c_mktsegment") == "BUILDING", "house").otherwise("other").alias("layer"),
        F.floor(balance).alias("loc"),
        (F.floor(balance) / 4000).alias("churn"),
        F.col("c_nationkey").cast("long").alias("commits"),
        (F.col("c_nationkey") - 2).cast("long").alias("authors"),
    )


@query
def quality_ranges(t):
    return quality.node_ranges(customer_nodes(t))


@query
def quality_duplicates(t):
    return quality.duplicate_ids(customer_nodes(t))


@query
def quality_edge_weights(t):
    files = resolution.file_edges(shop.import_pairs(t))
    everything = shop.universe(t)
    off = F.when(F.col("source") > F.col("target"), 1).otherwise(0)
    stated = resolution.module_edges(files, everything).withColumn(
        "weight", F.col("weight") + off
    )
    return quality.edge_weights(stated, files, everything)


@query
def quality_pairs(t):
    """Line items as stated pairs, so every rule is broken somewhere."""
    key, other = F.col("l_partkey"), F.col("l_suppkey")
    other_id = F.when(
        other % 7 == 0, F.concat(F.lit("m"), (other % 25).cast("string"), F.lit("/"))
    ).otherwise(shop.path(other))
    stated = t.lineitem.select(
        F.lit(shop.REPO).alias("repo_id"), F.lit("file").alias("kind"),
        shop.path(key).alias("a"), other_id.alias("b"),
        F.col("l_quantity").cast("long").alias("count"),
    )
    return quality.pair_rules(stated, shop.universe(t)).groupBy("repo_id", "message").agg(
        F.count("*").alias("n"), F.min("path").alias("first_path")
    )


@query
def quality_instants(t):
    number = lambda n, width: F.lpad((F.col("event_id") % n).cast("string"), width, "0")
    stated = F.concat(
        F.lpad((F.col("event_id") % 2100).cast("string"), 4, "0"), F.lit("-"), number(14, 2),
        F.lit("-"), number(33, 2), F.when(F.col("event_id") % 5 == 0, "t").otherwise("T"),
        number(25, 2), F.lit(":"), number(61, 2), F.lit(":"), number(62, 2),
        F.element_at(
            F.array(F.lit("Z"), F.lit(".5z"), F.lit("+01:30"), F.lit("-24:00"), F.lit("")),
            (F.col("event_id") % 5 + 1).cast("int"),
        ),
    )
    return t.events.select("event_id", quality.is_instant(stated).alias("valid"))


@query
def version_gate(t):
    version = F.concat(
        F.element_at(F.array(F.lit("1."), F.lit("2."), F.lit("v1."), F.lit("1"), F.lit("")),
                     (F.col("p_partkey") % 5 + 1).cast("int")),
        F.when(F.col("p_partkey") % 5 < 4, F.col("p_size").cast("string")).otherwise(""),
    )
    status, detail = documents.version_status(version)
    return t.part.select(
        "p_partkey", F.coalesce(status, F.lit("ok")).alias("status"), detail.alias("detail")
    )


@query
def run_validity(t):
    return quality.unmet_counts(shop.universe(t), {"module": 24, "file": 2000})


@query
def determinism(t):
    """Two runs over differently partitioned inputs, one with planted differences."""
    once = touched(t)
    free(t.spark)
    first = t.stored("first", lambda: history.node_activity(shop.universe(t), once))
    t.drop("touched")
    shuffled = t.stored("shuffled", lambda: history.resolve_history(
        shop.universe(t), shop.commits(t).repartition(3),
        shop.changes(t).repartition(5, "path"), shop.OPTIONS,
    ))
    free(t.spark)
    # a row a node; the log's rows are gone before the runs are compared
    second = t.stored("second", lambda: history.node_activity(shop.universe(t), shuffled))
    t.drop("shuffled")
    planted = second.withColumn("commits", F.col("commits") + (F.col("loc") % 25 == 0).cast("long"))
    return quality.differences(first, planted)


# ---------------------------------------------------------------- documents


def _documents(t: shop.Tables) -> DataFrame:
    """Lines of one document per module folder and root file."""
    return t.stored("lines", lambda: _document_lines(t))


def _document_lines(t: shop.Tables) -> DataFrame:
    everything = shop.universe(t)
    folder = F.regexp_replace(F.coalesce("parent", "id"), "/", "")
    split = lambda df: df.withColumn("repo_id", folder)
    listed = split(everything).withColumns(
        {
            "churn": F.lit(0.5), "commits": F.col("loc"), "authors": F.lit(1).cast("long"),
            "last_changed_at": F.lit(shop.NOW).cast("long"),
        }
    )
    folder_of = F.regexp_extract("source", r"\A[^/]+", 0)  # a root file is a folder of its own
    imports = resolution.file_edges(shop.import_pairs(t)).withColumn("repo_id", folder_of)
    summary = (
        listed.where(F.col("kind") == "file")
        .groupBy("repo_id")
        .agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
        .select(
            "repo_id", F.col("repo_id").alias("name"),
            F.lit(None).cast("string").alias("remote_url"),
            F.lit("main").alias("default_branch"),
            F.lit(shop.NOW).cast("long").alias("analyzed_at"),
            F.lit(90).alias("window_days"), "files", "loc",
            F.lit(0).cast("long").alias("commits"),
            F.create_map(F.lit("typescript"), F.lit(1.0)).alias("languages"),
        )
    )
    kept = summary.select("repo_id")
    together = (
        shop.import_pairs(t)
        .where(F.col("source") < F.col("target"))
        .groupBy(folder_of.alias("repo_id"), F.col("source").alias("a"), F.col("target").alias("b"))
        .agg(F.count("*").alias("count"))
    )
    return documents.document_lines(
        summary, listed, imports.join(kept, "repo_id", "left_semi"), together.join(kept, "repo_id", "left_semi")
    )


def _read_back(t: shop.Tables) -> dict[str, DataFrame]:
    """The documents written as a table of lines, and read back line by line; none is ever one row."""
    return documents.line_tables(t.stored("read_lines", lambda: documents.ordered_lines(_documents(t))))


@query
def document_roundtrip(t):
    """Nodes written as JSON documents and read back."""
    return _read_back(t)["nodes"].select(
        "repo_id", "id", "kind", "parent", "layer", "loc", "churn", "last_changed_at"
    )


@query
def document_edges(t):
    return _read_back(t)["edges"]


@query
def document_cochanges(t):
    return _read_back(t)["cochanges"]


def _document_folder(t: shop.Tables) -> dict[str, DataFrame]:
    """The documents written to a folder, a line an element, and read back line by line."""
    return documents.line_tables(t.stored("read_lines", lambda: documents.read_lines(t.spark, _written(t))))


@query
def document_folder_nodes(t):
    return _document_folder(t)["nodes"].select(
        "repo_id", "id", "kind", "parent", "layer", "loc", "churn", "last_changed_at"
    )


@query
def document_folder_edges(t):
    return _document_folder(t)["edges"]


@query
def document_folder_cochanges(t):
    return _document_folder(t)["cochanges"]


@query
def document_folder_status(t):
    """Load status of each document; some of the written lines are spoilt on the way."""
    spoilt = F.when(F.col("line").contains('"id":"m3/f3.ts"'), F.replace("line", F.lit('"id"'), F.lit('"name"'))).when(
        F.col("line").contains('"id":"m7/f7.ts"'), F.concat("line", F.lit("}"))
    )
    lines = documents.read_lines(t.spark, _written(t)).withColumn("line", F.coalesce(spoilt, "line"))
    return documents.line_tables(lines)["status"]


def _written(t: shop.Tables) -> str:
    root = shop.new_root(t)
    documents.write_documents(_documents(t), root)
    return root


@query
def document_violations(t):
    """Documents of one node each, broken in one way or another."""
    nation, customer = F.col("c_nationkey"), F.col("c_custkey")

    def field(name, value, when=None):
        stated = F.concat(F.lit(f'"{name}":'), value)
        return F.when(when, stated) if when is not None else stated

    def quoted(value):
        return F.concat(F.lit('"'), value, F.lit('"'))

    def either(when, broken, sound):
        return F.when(when, F.lit(broken)).otherwise(F.lit(sound))

    node = F.concat_ws(
        ",", field("id", quoted(F.col("c_name"))), field("kind", either(nation > 20, '"folder"', '"file"')),
        field("parent", F.lit("null"), nation != 13), field("path", either(nation == 3, '""', '"p"')),
        field("layer", either(F.col("c_mktsegment") == "BUILDING", '"house"', '"other"')),
        field("loc", F.floor("c_acctbal").cast("string")), field("churn", either(nation == 4, "1.5", "0.5")),
        field("commits", either(nation == 6, "0.5", "3")), field("authors", either(nation == 8, '"1"', "1")),
        field("lastChangedAt", either(nation == 5, '"2023-02-29T00:00:00Z"', '"2024-02-29T00:00:00Z"')),
        field("description", either(nation == 7, '"text"', "null")), field("descriptionSource", F.lit("null")),
        field("extra", F.lit("1"), nation == 11),
    )
    raw = F.concat(
        F.lit('{"schemaVersion":'), either(customer % 10 == 0, '"2.0"', '"1.0"'),
        F.lit(',"repo":{"name":"r","remoteUrl":null,"analyzedAt":"2024-01-01T00:00:00Z","defaultBranch":"main",'),
        field("analysisWindowDays", either(customer % 9 == 0, "0", "90")),
        F.lit(',"stats":{"files":1,"loc":1,"commits":1,"languages":{"go":'), either(customer % 8 == 0, "1.5", "1"),
        F.lit('}}},"nodes":[{'), node, F.lit('}],"edges":[],"cochanges":[]}'),
    )
    docs = t.customer.select(customer.cast("string").alias("repo_id"), raw.alias("raw"))
    return quality.validate_documents(docs)


@query
def document_order(t):
    """Lists of two elements each; about half of them stand in the wrong order."""
    raw = F.expr(
        """concat('{"nodes":[{"id":"', l_partkey, '"},{"id":"', l_suppkey, '"}],"edges":[{"source":"',
        l_linenumber, '","target":"', l_partkey, '"},{"source":"', l_linenumber % 3, '","target":"', l_suppkey,
        '"}],"cochanges":[{"a":"', l_returnflag, '","b":"x","count":', cast(l_quantity as int) % 5,
        '},{"a":"', l_linestatus, '","b":"x","count":', l_linenumber % 5, '}]}')"""
    )
    docs = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("repo_id"), raw.alias("raw"))
    return quality.document_order(docs).groupBy("repo_id", "path", "message").agg(F.count("*").alias("n"))


@query
def document_budget(t):
    """Documents against a budget, and the nodes each holds."""
    sizes = documents.document_sizes(_documents(t), limit=10_000)
    return sizes.select("repo_id", "bytes", "within_limit")


@query
def document_status(t):
    """Load status of texts that are a document, one of another version, or none."""
    repo = '"repo":{"name":"r","stats":{"files":1,"loc":1,"commits":1,"languages":{}}}'
    rest = f'"edges":[],"cochanges":[],{repo}'
    node = '{"id":"a","kind":"file","path":"a","layer":"other","loc":1,"churn":0}'
    forms = [
        F.col("props"),
        F.lit(f'{{"schemaVersion":"1.7","nodes":[{node}],{rest}}}'),
        F.concat(F.lit('{"schemaVersion":"'), (F.col("event_id") % 9 + 2).cast("string"), F.lit('.0"}')),
        F.lit(f'{{"schemaVersion":"1.0",{rest}}}'),
        F.lit(f'{{"schemaVersion":"1.0","nodes":[{node},{{"id":1}}],{rest}}}'),
        F.lit('{"schemaVersion":"1.0","nodes":[],"edges":[],"cochanges":[],"repo":{"name":"r"}}'),
    ]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    docs = t.events.select(F.col("event_id").cast("string").alias("repo_id"), raw.alias("raw"))
    return documents.load_status(docs).select("repo_id", "status", "detail")
