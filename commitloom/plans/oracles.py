"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from datetime import datetime, timezone

from commitloom.functions import fixed_values as fv
from commitloom.plans import shop
from commitloom.plans.queries import SEARCHES, SHOWN_LAYERS

SINCE = int(shop.OPTIONS.since)
UNTIL = shop.OPTIONS.until
NOW = shop.NOW


def stem(key: str) -> str:
    return (
        f"(CASE WHEN {key} % 40 = 0 THEN 'f' || {key} "
        f"ELSE 'm' || ({key} % 25) || '/f' || {key} END)"
    )


def path(key: str, extension: str = "ts") -> str:
    return f"({stem(key)} || '.{extension}')"


RANK = "CASE layer " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(fv.LAYERS)) + " END"
LAYER_OF_TYPE = "CASE p_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in shop.LAYER_OF_TYPE.items()
) + " END"


def files_cte(extension: str) -> str:
    return f"""
files AS (
  SELECT 'shop' AS repo_id, {path('p_partkey', extension)} AS id, 'file' AS kind,
         CASE WHEN p_partkey % 40 <> 0 THEN 'm' || (p_partkey % 25) || '/' END AS parent,
         {path('p_partkey', extension)} AS path, {LAYER_OF_TYPE} AS layer, CAST(p_size AS BIGINT) AS loc
  FROM part WHERE p_type <> 'PROMO')"""


MODULES = f"""
by_layer AS (
  SELECT parent, layer, sum(loc) AS loc FROM files WHERE parent IS NOT NULL GROUP BY ALL),
mods AS (
  SELECT 'shop' AS repo_id, parent AS id, 'module' AS kind, CAST(NULL AS VARCHAR) AS parent,
         parent AS path, arg_min(layer, (-loc, {RANK})) AS layer, CAST(sum(loc) AS BIGINT) AS loc
  FROM by_layer GROUP BY parent HAVING parent <> 'm24/')"""

NODES0 = files_cte("ts") + "," + MODULES + """,
nodes0 AS (SELECT * FROM files UNION ALL SELECT * FROM mods)"""

TOUCHED = NODES0 + f""",
log AS (
  SELECT o_orderkey AS seq, 'h' || o_orderkey AS hash,
         CAST(epoch(o_orderdate) AS BIGINT) AS committed_at,
         lower('C' || o_custkey || '@X') AS author
  FROM orders WHERE epoch(o_orderdate) >= {SINCE}),
dated AS (
  SELECT l_orderkey AS seq, l_linenumber AS pos, {path('l_partkey')} AS path,
         CASE WHEN l_partkey % 10 < 3 AND l_quantity = l_partkey % 10 + 1
              THEN {path('(l_partkey + 1)')} END AS old_path,
         committed_at, author
  FROM lineitem JOIN log ON l_orderkey = seq),
renamed AS (
  SELECT old_path AS old, seq, pos, path AS target FROM dated WHERE old_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY old_path ORDER BY seq, pos, path) = 1),
chain AS (
  SELECT old, seq AS first_seq, seq, pos, target, 0 AS depth FROM renamed
  UNION ALL
  SELECT c.old, c.first_seq, r.seq, r.pos, r.target, c.depth + 1
  FROM chain c JOIN renamed r ON r.old = c.target
  WHERE r.seq < c.seq OR (r.seq = c.seq AND r.pos < c.pos)),
alias AS (
  SELECT old, first_seq AS seq, target FROM chain
  QUALIFY row_number() OVER (PARTITION BY old ORDER BY depth DESC) = 1),
resolved AS (
  SELECT d.seq, d.committed_at, d.author, coalesce(a.target, d.path) AS path, min(d.pos) AS pos
  FROM dated d LEFT JOIN alias a ON a.old = d.path AND a.seq < d.seq
  WHERE d.committed_at <= {UNTIL} GROUP BY ALL),
touched AS (
  SELECT 'shop' AS repo_id, r.*, f.id, f.parent, m.id AS module
  FROM resolved r LEFT JOIN files f ON r.path = f.path LEFT JOIN mods m ON f.parent = m.id),
file_act AS (
  SELECT repo_id, id, count(*) AS commits, count(DISTINCT author) AS authors,
         max(committed_at) AS last_changed_at
  FROM touched WHERE id IS NOT NULL GROUP BY ALL),
module_act AS (
  SELECT repo_id, module AS id, count(DISTINCT seq) AS commits,
         count(DISTINCT author) AS authors, max(committed_at) AS last_changed_at
  FROM touched WHERE module IS NOT NULL GROUP BY ALL),
act AS (
  SELECT n.*, coalesce(a.commits, 0) AS commits, coalesce(a.authors, 0) AS authors,
         a.last_changed_at
  FROM nodes0 n LEFT JOIN (SELECT * FROM file_act UNION ALL SELECT * FROM module_act) a
    ON n.id = a.id),
p95 AS (
  SELECT repo_id, kind, CAST(quantile_disc(commits, 0.95) AS BIGINT) AS p95
  FROM act WHERE commits >= 1 GROUP BY ALL),
nodes AS (
  SELECT act.*, CASE WHEN commits <= 0 OR coalesce(p95, 0) <= 0 THEN 0.0
    ELSE greatest(least((2000 * commits + p95) // (2 * p95), 1000), 1) / 1000.0 END AS churn
  FROM act LEFT JOIN p95 USING (repo_id, kind))"""


def pair_ctes(bulk: int) -> str:
    return f""",
small AS (SELECT seq FROM touched GROUP BY seq HAVING count(*) <= {bulk}),
ids AS (
  SELECT DISTINCT seq, 'file' AS kind, id FROM touched JOIN small USING (seq) WHERE id IS NOT NULL
  UNION ALL
  SELECT DISTINCT seq, 'module', module FROM touched JOIN small USING (seq)
  WHERE module IS NOT NULL),
pair_counts AS (
  SELECT 'shop' AS repo_id, x.kind, x.id AS a, y.id AS b, count(*) AS count
  FROM ids x JOIN ids y ON x.seq = y.seq AND x.kind = y.kind AND x.id < y.id
  GROUP BY ALL HAVING count(*) >= 3),
pairs AS (
  SELECT * FROM pair_counts
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count DESC, a, b) <= 500)"""


PAIRS = TOUCHED + pair_ctes(fv.BULK_COMMIT_PATHS)
PARTNERS = PAIRS + """,
partners AS (
  SELECT repo_id, kind, a AS id, b AS partner, count FROM pairs
  UNION ALL SELECT repo_id, kind, b, a, count FROM pairs)"""

EDGE_PAIRS = f"""
import_pairs AS (
  SELECT DISTINCT 'shop' AS repo_id, {path('l_partkey')} AS source, {path('l_suppkey')} AS target
  FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')"""

EDGES = NODES0 + "," + EDGE_PAIRS + """,
module_edges AS (
  SELECT 'shop' AS repo_id, s.parent AS source, t.parent AS target, count(*) AS weight
  FROM import_pairs p JOIN files s ON p.source = s.id JOIN files t ON p.target = t.id
  WHERE s.parent <> t.parent GROUP BY ALL),
edges AS (
  SELECT repo_id, source, target, 'import' AS kind, 1 AS weight FROM import_pairs
  UNION ALL SELECT repo_id, source, target, 'import', weight FROM module_edges),
valid AS (
  SELECT e.*, s.kind AS level FROM edges e JOIN nodes0 s ON e.source = s.id
  JOIN nodes0 t ON e.target = t.id WHERE s.kind = t.kind),
near AS (
  SELECT repo_id, source AS id, target AS other, level FROM valid
  UNION SELECT repo_id, target, source, level FROM valid),
members AS (
  SELECT f.repo_id, m.id AS module, f.id FROM files f JOIN mods m ON f.parent = m.id),
degree AS (
  SELECT repo_id, id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
  FROM (SELECT repo_id, id, 0 AS i, 0 AS o FROM files
        UNION ALL SELECT repo_id, source, 0, 1 FROM valid WHERE level = 'file' AND source <> target
        UNION ALL SELECT repo_id, target, 1, 0 FROM valid WHERE level = 'file' AND source <> target)
  GROUP BY ALL)"""

SHOWN = ", ".join(f"'{x}'" for x in SHOWN_LAYERS)


def connected_ctes(candidates: str, prefix: str = "") -> str:
    """Edgeless removal written as its two passes."""
    return f""",
{prefix}cand AS ({candidates}),
{prefix}linked AS (
  SELECT DISTINCT id FROM near
  WHERE id IN (SELECT id FROM {prefix}cand) AND other IN (SELECT id FROM {prefix}cand)),
{prefix}kept AS (
  SELECT * FROM {prefix}cand WHERE id IN (SELECT id FROM {prefix}linked)
  UNION
  SELECT * FROM {prefix}cand WHERE kind = 'module' AND id IN (
    SELECT parent FROM {prefix}cand
    WHERE kind = 'file' AND id IN (SELECT id FROM {prefix}linked)))"""


SCOPE = """
scope AS (
  SELECT 'm3/' AS id UNION SELECT id FROM members WHERE module = 'm3/'
  UNION SELECT other FROM near WHERE id = 'm3/' AND level = 'module')"""

# ------------------------------------------------------------------ documents

EXTENSION = "CASE n_chars % 8 " + " ".join(
    f"WHEN {i} THEN '{e}'" for i, e in enumerate(shop.EXTENSIONS)
) + " END"
BLANK = (
    r"[ \t\x0B\f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}]*"
)
# Every default glob of the document paths' kind is a folder or a suffix.
LANGUAGE = """CASE WHEN name LIKE '%.ts' THEN 'typescript' WHEN name LIKE '%.py' THEN 'python'
  WHEN name LIKE '%.css' THEN 'css' WHEN name LIKE '%.json' THEN 'json'
  WHEN name LIKE '%.md' THEN 'markdown' WHEN name LIKE '%.tf' THEN 'terraform'
  ELSE 'unknown' END"""
LAYER = """CASE WHEN path LIKE '%/Tests/%' OR name LIKE '%.test.ts' THEN 'test'
  WHEN name LIKE '%.tf' THEN 'infra' WHEN name LIKE '%.css' THEN 'frontend'
  WHEN name LIKE '%.ts' OR name LIKE '%.py' THEN 'backend' ELSE 'other' END"""
DOCS = f"""
named AS (SELECT *, doc_id || '.' || {EXTENSION} AS name FROM documents),
placed AS (
  SELECT lang AS repo_id, source, text, name,
    CASE WHEN source = 'src7' THEN 'lib/node_modules/' || name
         WHEN lang = 'de' THEN 'packages/' || source || '/' || name
         WHEN lang = 'fr' AND source = 'src3' THEN 'src/' || name
         WHEN lang = 'fr' THEN 'src/' || source || '/deep/' || name
         WHEN lang = 'es' AND source = 'src1' THEN name
         WHEN source = 'src9' THEN 'core/Tests/' || name
         ELSE source || '/' || name END AS path
  FROM named),
listed AS (SELECT * FROM placed WHERE path NOT LIKE '%node_modules/%'),
measured AS (
  SELECT repo_id, path, name, {LANGUAGE} AS language, {LAYER} AS layer,
    source = 'src5' AS is_binary,
    CASE WHEN source = 'src5' THEN 0 ELSE CAST(len(list_filter(
      regexp_split_to_array(text, '[\\r\\n]'),
      lambda x: NOT regexp_full_match(x, '{BLANK}'))) AS BIGINT) END AS loc
  FROM listed),
kept AS (SELECT * FROM measured WHERE NOT (language = 'json' AND loc > {shop.SCAN_OPTIONS.blob_loc})),
tops AS (
  SELECT repo_id, split_part(path, '/', 1) AS top, count(*) AS n FROM kept
  WHERE path LIKE '%/%' GROUP BY ALL),
sizes AS (SELECT repo_id, count(*) AS total FROM kept GROUP BY ALL),
dominant AS (SELECT repo_id, top FROM tops JOIN sizes USING (repo_id) WHERE n / total > 0.7),
parents AS (
  SELECT k.*, CASE WHEN path NOT LIKE '%/%' THEN NULL
    WHEN d.top IS NOT NULL AND len(string_split(path, '/')) > 2
      THEN d.top || '/' || split_part(path, '/', 2) || '/'
    ELSE split_part(path, '/', 1) || '/' END AS parent
  FROM kept k LEFT JOIN dominant d ON k.repo_id = d.repo_id AND split_part(path, '/', 1) = d.top)"""

# ------------------------------------------------------------------ imports

LINE = (
    "'orders/l' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey"
)
SPECIFIER = f"""CASE WHEN l_returnflag = 'A' THEN 'pkg-' || l_suppkey
  WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '../' || {stem('l_suppkey')}
  WHEN l_returnflag = 'R' THEN './missing' || l_suppkey
  WHEN l_linestatus = 'O' THEN '@/' || {stem('l_suppkey')}
  ELSE '@/gone/' || l_suppkey END"""
SCRIPTS = files_cte("ts") + f""",
named AS (
  SELECT DISTINCT {LINE} || '.ts' AS source, {SPECIFIER} AS specifier,
    l_returnflag AS flag, l_linestatus AS status, {path('l_suppkey')} AS wanted
  FROM lineitem),
imports AS (
  SELECT 'shop' AS repo_id, source, specifier,
    CASE WHEN flag = 'A' THEN 'external-import'
         WHEN status = 'F' THEN 'unresolved-import'
         WHEN f.id IS NOT NULL THEN 'edge' ELSE 'outside-universe-import' END AS outcome,
    CASE WHEN flag <> 'A' AND status = 'O' THEN f.id END AS target
  FROM named LEFT JOIN files f ON f.id = wanted)"""
PYTHON = files_cte("py") + f""",
lines AS (
  SELECT DISTINCT {LINE} || '.py' AS source, l_returnflag AS flag, l_linestatus AS status,
    l_suppkey AS k, replace({stem('l_suppkey')}, '/', '.') AS dotted,
    {path('l_suppkey', 'py')} AS wanted
  FROM lineitem),
raw_imports AS (
  SELECT 'shop' AS repo_id, source, 0 AS level, 'numpy' AS module, CAST(NULL AS VARCHAR) AS name,
    false AS broken, CAST(NULL AS VARCHAR) AS wanted FROM lines WHERE flag = 'A'
  UNION ALL SELECT 'shop', source, 0, 'os.path', NULL, false, NULL FROM lines WHERE flag = 'A'
  UNION ALL SELECT 'shop', source, 2, CASE WHEN k % 40 = 0 THEN '' ELSE dotted END,
    CASE WHEN k % 40 = 0 THEN dotted ELSE 'x' END, false, wanted
    FROM lines WHERE flag = 'R' AND status = 'O'
  UNION ALL SELECT 'shop', source, 1, 'missing', 'y', false, NULL
    FROM lines WHERE flag = 'R' AND status <> 'O'
  UNION ALL SELECT 'shop', source, 0, dotted, NULL, false, wanted
    FROM lines WHERE flag = 'N' AND status = 'O'
  UNION ALL SELECT 'shop', source, 0, NULL, NULL, true, NULL
    FROM lines WHERE flag = 'N' AND status <> 'O'),
py_imports AS (
  SELECT r.repo_id, source, repeat('.', level) || module AS specifier,
    CASE WHEN f.id IS NOT NULL THEN 'edge' WHEN level > 0 THEN 'unresolved-import'
         ELSE 'external-import' END AS outcome, f.id AS target
  FROM raw_imports r LEFT JOIN files f ON f.id = wanted WHERE NOT broken)"""

# ------------------------------------------------------------------ events


def event_ctes(key: str) -> str:
    return f"""
ev AS (SELECT CAST({key} AS VARCHAR) AS series, epoch_us(ts) // 1000 AS ts FROM events),
spans AS (
  SELECT series, count(*) - 1 AS frames, max(ts) - min(ts) AS duration, max(ts) AS final
  FROM ev GROUP BY ALL),
avgs AS (
  SELECT *, CASE WHEN frames = 0 THEN 0.0 ELSE frames / duration * 1000 END AS avg_rate
  FROM spans),
gaps AS (
  SELECT series, ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) AS gap FROM ev
  QUALIFY gap IS NOT NULL)"""


def worst(key: str, width: int) -> str:
    return f"""WITH {event_ctes(key)},
ordered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM ev),
windows AS (
  SELECT a.series, a.i, count(*) - 1 AS n
  FROM ordered a JOIN spans s ON a.series = s.series AND a.ts + {width} <= s.final
  JOIN ordered b ON a.series = b.series AND b.i >= a.i AND b.ts <= a.ts + {width}
  GROUP BY ALL)
SELECT series, frames, coalesce(CAST(lowest AS DOUBLE), avg_rate) AS worst_rate
FROM avgs LEFT JOIN (SELECT series, min(n) AS lowest FROM windows GROUP BY ALL) USING (series)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def warning(stage: str, code: str, detail: str, order: str, source: str) -> str:
    return (
        f"SELECT 'shop' AS repo_id, '{stage}' AS stage, '{code}' AS code, count(*) AS count, "
        f"arg_min({detail}, {order}) AS detail FROM {source} HAVING count(*) > 0"
    )


def grouped(value: str) -> str:
    return f"format('{{:,}}', CAST({value} AS BIGINT))"


def ago(elapsed: str) -> str:
    steps = (("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400),
             ("hour", 3600), ("minute", 60))
    cases = " ".join(
        f"WHEN {elapsed} // {s} = 1 THEN '1 {u} ago' "
        f"WHEN {elapsed} // {s} > 1 THEN ({elapsed} // {s}) || ' {u}s ago'"
        for u, s in steps
    )
    return f"CASE {cases} ELSE 'just now' END"


def _search_values() -> str:
    return ", ".join(f"('{q}')" for q in SEARCHES)


PLAIN_PERCENT = "CASE WHEN churn <= 0 THEN '0%' ELSE CAST(floor(least(churn, 1) * 100 + 0.5) AS BIGINT) || '%' END"
DAYS = shop.OPTIONS.window_days

# The documents of queries._documents, one per folder.
DOC_NODES = NODES0 + f""",
doc_nodes AS (
  SELECT replace(coalesce(parent, id), '/', '') AS repo_id, id, kind, parent, path, layer, loc,
    0.5 AS churn, {NOW} AS last_changed_at FROM nodes0),
doc_repos AS (SELECT DISTINCT repo_id FROM doc_nodes WHERE kind = 'file'),
""" + EDGE_PAIRS + f""",
doc_edges AS (
  SELECT split_part(source, '/', 1) AS repo_id, source, target, 'import' AS kind, 1 AS weight
  FROM import_pairs),
doc_pairs AS (
  SELECT split_part({path('l_partkey')}, '/', 1) AS repo_id, {path('l_partkey')} AS a,
    {path('l_suppkey')} AS b, count(*) AS count
  FROM lineitem WHERE {path('l_partkey')} < {path('l_suppkey')} GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "node_activity": with_(TOUCHED, "SELECT repo_id, id, kind, commits, authors, last_changed_at FROM act"),
    "module_activity": with_(TOUCHED, "SELECT * FROM module_act"),
    "file_activity": with_(TOUCHED, "SELECT * FROM file_act"),
    "repo_totals": with_(
        TOUCHED,
        f"""SELECT 'shop' AS repo_id, count(*) AS commits,
  strftime(max(make_timestamp(committed_at * 1000000)), '%Y-%m-%dT%H:%M:%S.000Z') AS last_commit_at
FROM log WHERE committed_at <= {UNTIL}"""),
    "p95_by_kind": with_(TOUCHED, "SELECT * FROM p95"),
    "churn": with_(TOUCHED, "SELECT repo_id, id, kind, churn FROM nodes"),
    "hot_spots": with_(TOUCHED, "SELECT repo_id, id, churn FROM nodes WHERE churn >= 0.5"),
    "window_filter": with_(
        TOUCHED,
        f"""SELECT 'shop' AS repo_id, seq, hash, committed_at, author AS author_email
FROM log WHERE committed_at <= {UNTIL}"""),
    "rename_resolve": with_(TOUCHED, "SELECT 'shop' AS repo_id, old, seq, target FROM alias"),
    "universe_join": with_(TOUCHED, "SELECT repo_id, seq, path, id, parent, module, pos FROM touched"),
    "warning_counts": with_(TOUCHED + """,
outside AS (SELECT * FROM touched WHERE id IS NULL),
orphan AS (SELECT * FROM touched WHERE parent IS NOT NULL AND module IS NULL),
bulk AS (SELECT seq FROM touched GROUP BY seq HAVING count(*) > 6)""",
        " UNION ALL ".join([
            warning("history", "path-outside-universe", "path", "(seq, pos, path)", "outside"),
            warning("history", "unknown-module-parent", "parent", "(seq, pos, path)", "orphan"),
            warning("history", "bulk-commit-skipped", "'h' || seq", "seq", "bulk"),
        ])),
    "cochange_pairs": with_(PAIRS, "SELECT * FROM pair_counts"),
    "cochange_top": with_(
        PAIRS,
        """SELECT * FROM pair_counts
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count DESC, a, b) <= 100"""),
    "bulk_skip": with_(TOUCHED + pair_ctes(6), "SELECT * FROM pair_counts"),
    "partners_top3": with_(
        PARTNERS,
        """SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY count DESC, partner) AS INTEGER)
  AS rank FROM partners QUALIFY rank <= 3"""),
    "hidden_cochange": with_(
        PAIRS + "," + EDGES.split(NODES0 + ",", 1)[1],
        """SELECT * FROM pairs p WHERE NOT EXISTS (
  SELECT 1 FROM edges e WHERE (e.source = p.a AND e.target = p.b)
     OR (e.source = p.b AND e.target = p.a))"""),
    "cochange_report": with_(
        PARTNERS + f""",
lists AS (
  SELECT id, count(*) AS n, string_agg(partner || ' ' || {grouped('count')} ||
    CASE WHEN count = 1 THEN ' commit' ELSE ' commits' END, '; ' ORDER BY count DESC, partner) AS l
  FROM partners GROUP BY id)""",
        f"""SELECT repo_id, n0.id, 'blast radius · ' || kind || 's · last {DAYS} days' AS caption,
  CAST(coalesce(n, 0) AS INTEGER) AS partner_count, l AS partners,
  CASE WHEN l IS NULL THEN 'empty' ELSE 'listed' END AS state,
  CASE WHEN l IS NULL THEN 'nothing changed with it in 3 or more commits of the last {DAYS} days'
  END AS cause
FROM nodes0 n0 LEFT JOIN lists ON n0.id = lists.id"""),
    "unpaired_nodes": with_(
        PARTNERS, "SELECT repo_id, id, kind FROM nodes0 WHERE id NOT IN (SELECT id FROM partners)"),
    "edge_dedup": with_(
        EDGES,
        "SELECT repo_id, source, target, 'import' AS kind, 1 AS weight FROM import_pairs"),
    "module_edges": with_(
        EDGES, "SELECT repo_id, source, target, 'import' AS kind, weight FROM module_edges"),
    "same_kind_edges": with_(EDGES, "SELECT * FROM valid"),
    "neighbour_sets": with_(EDGES, "SELECT * FROM near"),
    "degrees": with_(EDGES, "SELECT * FROM degree"),
    "reading_order": with_(EDGES + f""",
ranked AS (
  SELECT d.repo_id, CASE WHEN layer = 'test' THEN 'tests' WHEN in_degree > 0 THEN 'core'
      WHEN out_degree > 0 THEN 'entry-points' END AS category,
    d.id, path, split_part(path, '/', -1) AS name, layer, loc, in_degree, out_degree
  FROM degree d JOIN files f ON d.id = f.id),
measured AS (
  SELECT *, CASE WHEN category = 'core' THEN in_degree * loc ELSE out_degree END AS metric,
    CASE WHEN category = 'core' THEN {grouped('in_degree')}
      || CASE WHEN in_degree = 1 THEN ' importer · ' ELSE ' importers · ' END || {grouped('loc')}
      || CASE WHEN loc = 1 THEN ' line' ELSE ' lines' END
    ELSE {grouped('out_degree')} || CASE WHEN out_degree = 1 THEN ' import' ELSE ' imports' END
    END AS metric_label
  FROM ranked WHERE category IS NOT NULL)""",
        """SELECT *, count(*) OVER (PARTITION BY category) AS total,
  CAST(row_number() OVER (PARTITION BY category ORDER BY metric DESC, id) AS INTEGER) AS rank
FROM measured QUALIFY rank <= 5"""),
    "one_hop": with_(
        EDGES,
        """SELECT repo_id, id AS focus, id FROM nodes0
UNION SELECT repo_id, id, other FROM near
UNION SELECT m.repo_id, m.module, m.id FROM members m JOIN nodes0 n ON n.id = m.module
WHERE n.layer = 'test'"""),
    "scope_nodes": with_(
        EDGES,
        """SELECT repo_id, id AS focus, id FROM mods
UNION SELECT repo_id, module, id FROM members
UNION SELECT repo_id, id, other FROM near WHERE level = 'module'"""),
    "edge_lift": with_(
        EDGES,
        """SELECT repo_id, source, target FROM valid WHERE level = 'module' AND source <> target
UNION
SELECT v.repo_id, coalesce(s.parent, s.id), coalesce(t.parent, t.id)
FROM valid v JOIN files s ON v.source = s.id JOIN files t ON v.target = t.id
WHERE v.level = 'file' AND (s.parent IS NULL OR t.parent IS NULL)
  AND coalesce(s.parent, s.id) <> coalesce(t.parent, t.id)"""),
    "connected_only": with_(
        EDGES + connected_ctes(f"SELECT * FROM nodes0 WHERE layer IN ({SHOWN})"),
        "SELECT repo_id, id, kind FROM kept"),
    "layer_filter": with_(
        EDGES,
        f"""SELECT e.* FROM edges e JOIN nodes0 s ON e.source = s.id JOIN nodes0 t ON e.target = t.id
WHERE s.layer IN ({SHOWN}) AND t.layer IN ({SHOWN})"""),
    "layer_hidden": with_(
        NODES0,
        f"""SELECT repo_id, count(*) FILTER (layer NOT IN ({SHOWN})) AS hidden,
  count(*) FILTER (layer IN ({SHOWN})) AS visible FROM nodes0 GROUP BY ALL"""),
    "visible_nodes": with_(
        EDGES + "," + SCOPE + connected_ctes(
            f"SELECT * FROM nodes0 WHERE layer IN ({SHOWN}) AND id IN (SELECT id FROM scope)"),
        "SELECT repo_id, id FROM kept"),
    "hidden_counts": with_(
        EDGES + "," + SCOPE
        + connected_ctes(
            f"SELECT * FROM nodes0 WHERE layer IN ({SHOWN}) AND id IN (SELECT id FROM scope)")
        + connected_ctes("SELECT * FROM cand WHERE parent IS NULL", "top_"),
        """SELECT 'shop' AS repo_id,
  (SELECT count(*) FROM nodes0) - (SELECT count(*) FROM scope) AS hidden_by_scope,
  (SELECT count(*) FROM cand) - (SELECT count(*) FROM kept) AS hidden_by_degree,
  (SELECT count(*) FROM top_kept) AS visible"""),
    "edgeless_files": with_(
        EDGES,
        """SELECT repo_id, id FROM files WHERE id NOT IN
  (SELECT source FROM edges UNION SELECT target FROM edges)"""),
    "member_counts": with_(
        NODES0,
        """SELECT repo_id, parent AS id, count(*) AS members FROM nodes0
WHERE parent IS NOT NULL GROUP BY ALL"""),
    "module_members": with_(EDGES, "SELECT * FROM members"),
    "path_excludes": with_(DOCS, "SELECT repo_id, path FROM listed"),
    "user_excludes": with_(
        DOCS,
        """SELECT repo_id, path FROM listed
WHERE NOT (path LIKE '%.md' OR path LIKE 'packages/src1/%' OR regexp_matches(path, '^src/(.*/)?deep/'))"""),
    "language_keys": with_(
        DOCS,
        """SELECT repo_id, string_agg(language, ',' ORDER BY language) AS languages
FROM (SELECT repo_id, language FROM kept GROUP BY ALL HAVING sum(loc) > 0) GROUP BY repo_id"""),
    "archive_entries": with_(
        DOCS,
        """SELECT repo_id, path, 'file' AS entry_kind,
  md5(CASE WHEN source = 'src5' THEN '\\x00'::BLOB ELSE ''::BLOB END || encode(text)) AS md5 FROM placed
UNION ALL SELECT repo_id, path || '.link', 'symlink', NULL FROM placed"""),
    "log_commits": """SELECT 'shop' AS repo_id, 'h' || o_orderkey AS hash,
  CAST(epoch(o_orderdate) AS BIGINT) AS committed_at, lower('C' || o_custkey || '@X') AS author_email
FROM orders""",
    "log_changes": f"""WITH c AS (
  SELECT l_orderkey, l_linenumber, {path('l_partkey')} AS path,
    CASE WHEN l_partkey % 10 < 3 AND l_quantity = l_partkey % 10 + 1 THEN 'R' WHEN l_returnflag = 'A' THEN 'A'
      WHEN l_returnflag = 'R' THEN 'D' ELSE 'M' END AS status, {path('(l_partkey + 1)')} AS next
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT 'shop' AS repo_id, 'h' || l_orderkey AS hash,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, path, status) - 1 AS pos,
  status, path, CASE WHEN status = 'R' THEN next END AS old_path
FROM c""",
    "enriched_layers": with_(
        NODES0,
        "SELECT repo_id, id, kind, CASE WHEN loc < 10 THEN 'other' ELSE layer END AS layer FROM nodes0"),
    "loc_count": with_(DOCS, "SELECT repo_id, path, loc, is_binary FROM measured"),
    "language_detect": with_(DOCS, "SELECT repo_id, path, language FROM measured"),
    "layer_classify": with_(DOCS, "SELECT repo_id, path, layer FROM measured"),
    "layer_overrides": with_(
        DOCS,
        """SELECT repo_id, path, CASE WHEN path LIKE '%/src3/%' OR path LIKE 'src3/%' THEN 'infra'
  WHEN path LIKE 'packages/%' THEN 'frontend' ELSE layer END AS layer FROM measured"""),
    "blob_filter": with_(DOCS, "SELECT repo_id, path, loc FROM kept"),
    "scan_warnings": with_(
        DOCS,
        f"""SELECT repo_id, 'scan' AS stage, code, count(*) AS count, min(path) AS detail
FROM (SELECT *, CASE WHEN language = 'json' AND loc > {shop.SCAN_OPTIONS.blob_loc} THEN 'data-blob'
  WHEN is_binary THEN 'binary-file' END AS code FROM measured)
WHERE code IS NOT NULL GROUP BY ALL"""),
    "scan_totals": with_(
        DOCS,
        "SELECT repo_id, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM kept GROUP BY ALL"),
    "language_shares": with_(
        DOCS,
        """SELECT repo_id, language, loc, loc / sum(loc) OVER (PARTITION BY repo_id) AS share
FROM (SELECT repo_id, language, CAST(sum(loc) AS BIGINT) AS loc FROM kept GROUP BY ALL)
WHERE loc > 0"""),
    "top_languages": with_(
        DOCS + """,
shares AS (
  SELECT repo_id, language, loc / sum(loc) OVER (PARTITION BY repo_id) AS share
  FROM (SELECT repo_id, language, sum(loc) AS loc FROM kept GROUP BY ALL)),
top AS (
  SELECT * FROM shares WHERE share > 0
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY share DESC, language) <= 3)""",
        """SELECT repo_id, string_agg(language || ' ' || CAST(floor(share * 100 + 0.5) AS BIGINT) || '%',
  ' · ' ORDER BY share DESC, language) AS languages FROM top GROUP BY repo_id"""),
    "module_derive": with_(DOCS, "SELECT repo_id, path, parent FROM parents"),
    "dominant_layer": with_(
        DOCS + """,
by_layer AS (
  SELECT repo_id, parent, layer, CAST(sum(loc) AS BIGINT) AS loc FROM parents
  WHERE parent IS NOT NULL GROUP BY ALL)""",
        f"""SELECT repo_id, parent, CAST(sum(loc) AS BIGINT) AS loc,
  coalesce(arg_min(layer, (-loc, {RANK})) FILTER (loc > 0), 'other') AS layer
FROM by_layer GROUP BY ALL"""),
    "universe_nodes": with_(NODES0, "SELECT * FROM nodes0"),
    "import_extract": with_(SCRIPTS, "SELECT repo_id, source, specifier FROM imports"),
    "import_resolve": with_(
        SCRIPTS, "SELECT repo_id, source, specifier, outcome, target FROM imports"),
    "import_warnings": with_(
        SCRIPTS,
        """SELECT repo_id, 'deps' AS stage, outcome AS code, count(*) AS count,
  arg_min(specifier || ' in ' || source, (source, specifier)) AS detail
FROM imports WHERE outcome <> 'edge' GROUP BY ALL"""),
    "import_edges": with_(
        SCRIPTS,
        """SELECT DISTINCT repo_id, source, target, 'import' AS kind, 1 AS weight
FROM imports WHERE outcome = 'edge'
UNION ALL
SELECT 'shop', 'orders/', parent, 'import', count(*)
FROM (SELECT DISTINCT source, target FROM imports WHERE outcome = 'edge') e
JOIN files f ON f.id = e.target WHERE parent IS NOT NULL GROUP BY ALL"""),
    "resolution_rate": with_(
        SCRIPTS + """,
n AS (
  SELECT repo_id, count(*) FILTER (outcome = 'edge') AS resolved,
    count(*) FILTER (outcome = 'external-import') AS external,
    count(*) FILTER (outcome = 'outside-universe-import') AS outside,
    count(*) FILTER (outcome = 'unresolved-import') AS unresolved, count(*) AS specifiers
  FROM imports GROUP BY ALL)""",
        """SELECT *, unresolved / (resolved + unresolved) AS rate,
  unresolved / specifiers AS rate_of_all,
  unresolved / (resolved + unresolved) <= 0.2 AS within_limit FROM n"""),
    "python_extract": with_(
        PYTHON, "SELECT repo_id, source, level, module, name, broken FROM raw_imports"),
    "python_resolve": with_(
        PYTHON, "SELECT repo_id, source, specifier, outcome, target FROM py_imports"),
    "python_warnings": with_(
        PYTHON,
        """SELECT repo_id, 'deps' AS stage, outcome AS code, count(*) AS count,
  arg_min(specifier || ' in ' || source, (source, specifier)) AS detail
FROM py_imports WHERE outcome <> 'edge' GROUP BY ALL
UNION ALL SELECT 'shop', 'deps', 'unparsable-file', count(*), min(source)
FROM raw_imports WHERE broken"""),
    "edge_union": with_(
        SCRIPTS + "," + PYTHON.replace("files AS", "py_files AS").replace("JOIN files f", "JOIN py_files f"),
        """SELECT DISTINCT repo_id, source, target, 'import' AS kind, 1 AS weight FROM (
  SELECT * FROM imports UNION ALL SELECT * FROM py_imports) WHERE outcome = 'edge'"""),
    "node_report": with_(
        PARTNERS + """,
best AS (
  SELECT id, string_agg(partner, ', ' ORDER BY count DESC, partner) AS partners FROM (
    SELECT * FROM partners
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY count DESC, partner) <= 3) GROUP BY id),
held AS (SELECT parent AS id, count(*) AS n FROM nodes0 WHERE parent IS NOT NULL GROUP BY ALL)""",
        f"""SELECT repo_id, n.id,
  CASE WHEN kind = 'module' THEN n.id ELSE split_part(path, '/', -1) END AS name,
  kind || ' · ' || layer AS kind_line, churn >= 0.5 AS hot,
  CASE WHEN kind = 'module' THEN {grouped('coalesce(held.n, 0)')} ELSE '—' END AS files,
  {grouped('loc')} AS loc, {PLAIN_PERCENT} AS churn, {grouped('authors')} AS authors,
  CASE WHEN last_changed_at IS NULL THEN 'no change in last {DAYS} days'
    ELSE {ago(f'greatest({NOW} - last_changed_at, 0)')} END AS last_change,
  CASE WHEN last_changed_at IS NULL THEN 'node-out-of-window' END AS notice,
  coalesce(best.partners, '') AS partners,
  'https://github.com/acme/shop/' || CASE WHEN kind = 'module' THEN 'tree' ELSE 'blob' END
    || '/feat/main/' || rtrim(path, '/') AS url
FROM nodes n LEFT JOIN best ON n.id = best.id LEFT JOIN held ON n.id = held.id"""),
    "cold_share": with_(
        TOUCHED,
        """SELECT repo_id, count(*) FILTER (churn = 0) AS cold, count(*) AS files,
  count(*) FILTER (churn = 0) / count(*) AS share,
  count(*) FILTER (churn = 0) / count(*) > 0.5 AS mostly_cold
FROM nodes WHERE kind = 'file' GROUP BY ALL"""),
    "size_concentration": with_(
        NODES0 + """,
r AS (SELECT repo_id, kind, CASE WHEN kind = 'module' THEN 7.0 ELSE 1.5 END + sqrt(loc) / 11 AS r
  FROM nodes0)""",
        """SELECT repo_id, kind, round(max(r) / median(r), 6) AS radius_ratio,
  round((max(r) / median(r)) * (max(r) / median(r)), 6) AS area_ratio,
  round(max(r) * max(r) / sum(r * r), 9) AS largest_share FROM r GROUP BY ALL"""),
    "drawn_size": with_(
        NODES0,
        """SELECT repo_id, id,
  round(CASE WHEN kind = 'module' THEN 7.0 ELSE 1.5 END + sqrt(loc) / 11, 9) AS radius
FROM nodes0"""),
    "fuzzy_top7": with_(
        NODES0 + f""",
asked AS (SELECT q AS query, lower(q) AS lq FROM (VALUES {_search_values()}) v(q)),
walk AS (
  SELECT query, lq, id, path, lower(path) AS low, 1 AS step, 0 AS cursor, -1 AS previous,
    0 AS points, 0 AS head FROM asked, nodes0
  UNION ALL
  SELECT query, lq, id, path, low, step + 1, hit, hit,
    points + 100 + CASE WHEN hit = previous + 1 THEN 800 ELSE 0 END
      + CASE WHEN hit = 1 OR contains('/.-_ ', low[hit - 1]) THEN 600 ELSE 0 END,
    CASE WHEN step = 1 THEN hit ELSE head END
  FROM (SELECT *, CASE WHEN strpos(low[cursor + 1:], lq[step]) > 0
          THEN cursor + strpos(low[cursor + 1:], lq[step]) END AS hit FROM walk
        WHERE step <= length(lq))
  WHERE hit IS NOT NULL),
scored AS (
  SELECT 'shop' AS repo_id, query, id, path, (points
    + CASE WHEN contains(low, lq) THEN 1200 ELSE 0 END
    + CASE WHEN starts_with(low, lq) THEN 1000 ELSE 0 END
    - (head - 1) * 40 - length(path) * 6) / 100.0 AS score
  FROM walk WHERE step = length(lq) + 1)""",
        """SELECT repo_id, query, id, score,
  CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS INTEGER) AS rank
FROM scored QUALIFY rank <= 7"""),
    "interval_stats": with_(
        event_ctes("user_id") + """,
sorted AS (
  SELECT series, gap, row_number() OVER (PARTITION BY series ORDER BY gap) - 1 AS i,
    count(*) OVER (PARTITION BY series) AS n FROM gaps),
q AS (
  SELECT series, max(gap) FILTER (i = least(n - 1, n * 50 // 100)) AS median_gap,
    max(gap) FILTER (i = least(n - 1, n * 95 // 100)) AS p95_gap, max(gap) AS max_gap
  FROM sorted GROUP BY ALL)""",
        """SELECT series, frames, duration, avg_rate, coalesce(median_gap, 0) AS median_gap,
  coalesce(p95_gap, 0) AS p95_gap, coalesce(max_gap, 0) AS max_gap
FROM avgs LEFT JOIN q USING (series)"""),
    "gap_counts": with_(
        event_ctes("event_type"), "SELECT series, gap, count(*) AS n FROM gaps GROUP BY ALL"),
    "worst_1s_rate": worst("user_id", 1000),
    "worst_day_rate": worst("event_type", 86_400_000),
    "display_numbers": f"""WITH v AS (
  SELECT o_orderkey, floor(o_totalprice) AS v, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)
SELECT o_orderkey,
  CASE WHEN v >= 1000000 THEN ((w + 50000) // 1000000) || '.' || (w + 50000) % 1000000 // 100000 || 'm'
       WHEN v >= 1000 THEN ((w + 50) // 1000) || '.' || (w + 50) % 1000 // 100 || 'k'
       ELSE CAST(w AS VARCHAR) END AS compact,
  {grouped('v')} AS grouped,
  CASE WHEN v <= 0 THEN '0%' ELSE CAST(floor(least(v / 400000, 1.0) * 100 + 0.5) AS BIGINT) || '%'
  END AS percent,
  (o_orderkey % 3) || CASE WHEN o_orderkey % 3 = 1 THEN ' line' ELSE ' lines' END AS counted
FROM v""",
    "relative_times": f"""WITH v AS (
  SELECT o_orderkey, o_orderdate,
    greatest({NOW} - CAST(epoch(o_orderdate) AS BIGINT) - o_orderkey % 86400, 0) AS e FROM orders)
SELECT o_orderkey, {ago('e')} AS ago,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS instant FROM v""",
    "repo_names": """WITH v AS (
  SELECT c_custkey, c_custkey % 6 AS k, lower(replace(c_name, '#', '-')) AS n FROM customer)
SELECT c_custkey, CASE WHEN k = 5 THEN 'folder' ELSE n END AS name,
  CASE k WHEN 0 THEN 'https://github.com/acme/' || n || '/blob/main/src/a%20b%2Bc.ts'
         WHEN 1 THEN 'https://github.com/o%20r/' || n || '/blob/main/src/a%20b%2Bc.ts'
         WHEN 2 THEN 'https://github.com/a(b)/' || n || '/blob/main/src/a%20b%2Bc.ts' END AS url
FROM v""",
}

_ISO_NOW = datetime.fromtimestamp(NOW, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")

_CUSTOMER_NODES = """
n AS (
  SELECT 'customers' AS repo_id, 'n' || (c_custkey // 2) AS id,
    CASE WHEN c_nationkey > 20 THEN 'folder' ELSE 'file' END AS kind,
    CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS path,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'house' ELSE 'other' END AS layer,
    CAST(floor(c_acctbal) AS BIGINT) AS loc, floor(c_acctbal) / 4000 AS churn,
    c_nationkey AS commits, c_nationkey - 2 AS authors
  FROM customer)"""


def _range_rule(field: str, broken: str, message: str) -> str:
    return (
        f"SELECT repo_id, '/nodes/' || id || '/{field}' AS path, '{message}' AS message "
        f"FROM n WHERE {broken}"
    )


_ENUM = "must be equal to one of the allowed values"

ORACLES |= {
    "quality_ranges": with_(_CUSTOMER_NODES, " UNION ALL ".join([
        _range_rule("path", "path = ''", "must NOT have fewer than 1 characters"),
        _range_rule("kind", "kind = 'folder'", _ENUM),
        _range_rule("layer", "layer = 'house'", _ENUM),
        _range_rule("loc", "loc < 0", "must be >= 0"),
        _range_rule("authors", "authors < 0", "must be >= 0"),
        _range_rule("churn", "churn < 0", "must be >= 0"),
        _range_rule("churn", "churn > 1", "must be <= 1"),
    ])),
    "quality_duplicates": with_(
        _CUSTOMER_NODES, "SELECT repo_id, id, count(*) AS n FROM n GROUP BY ALL HAVING count(*) > 1"),
    "quality_edge_weights": with_(
        EDGES,
        """SELECT repo_id, source, target, weight AS expected,
  CASE WHEN source IN (SELECT id FROM mods)
    THEN weight + CASE WHEN source > target THEN 1 ELSE 0 END END AS stated
FROM module_edges
WHERE source > target OR source NOT IN (SELECT id FROM mods)"""),
    "quality_pairs": with_(
        NODES0 + f""",
stated AS (
  SELECT 'shop' AS repo_id, {path('l_partkey')} AS a,
    CASE WHEN l_suppkey % 7 = 0 THEN 'm' || (l_suppkey % 25) || '/' ELSE {path('l_suppkey')} END AS b,
    CAST(l_quantity AS BIGINT) AS count FROM lineitem),
known AS (
  SELECT s.*, x.kind AS ka, y.kind AS kb FROM stated s
  LEFT JOIN nodes0 x ON s.a = x.id LEFT JOIN nodes0 y ON s.b = y.id),
problems AS (
  SELECT repo_id, a || ' ' || b AS path, 'a must come before b' AS message FROM known WHERE a >= b
  UNION ALL SELECT repo_id, a || ' ' || b, 'count must be >= 3' FROM known WHERE count < 3
  UNION ALL SELECT repo_id, a || ' ' || b, 'must be of one kind' FROM known
    WHERE ka IS DISTINCT FROM kb
  UNION ALL SELECT repo_id, a || ' ' || b, 'must be unique' FROM stated
    GROUP BY repo_id, a, b HAVING count(*) > 1
  UNION ALL SELECT repo_id, ka, 'must NOT have more than 500 pairs' FROM known
    GROUP BY repo_id, ka HAVING count(*) > 500)""",
        "SELECT repo_id, message, count(*) AS n, min(path) AS first_path FROM problems GROUP BY ALL"),
    "quality_instants": """WITH v AS (
  SELECT event_id, event_id % 2100 AS y, event_id % 14 AS m, event_id % 33 AS d,
    event_id % 25 AS h, event_id % 61 AS mi, event_id % 62 AS s, event_id % 5 AS z FROM events)
SELECT event_id, coalesce(y >= 1 AND m BETWEEN 1 AND 12 AND d >= 1 AND d <=
    CASE WHEN m BETWEEN 1 AND 12 THEN day(last_day(make_date(greatest(y, 1), m, 1))) END
  AND h <= 23 AND mi <= 59 AND s <= 59 AND z < 3, false) AS valid
FROM v""",
    "version_gate": """SELECT p_partkey,
  CASE p_partkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'unsupported-version' ELSE 'malformed' END AS status,
  CASE p_partkey % 5 WHEN 1 THEN 'schemaVersion is not supported: 2.' || p_size
    WHEN 2 THEN 'schemaVersion is unreadable: v1.' || p_size
    WHEN 3 THEN 'schemaVersion is unreadable: 1' || p_size
    WHEN 4 THEN 'schemaVersion is missing' END AS detail
FROM part""",
    "run_validity": with_(
        NODES0,
        """SELECT repo_id, 'module' AS kind, 24 AS expected, count(*) FILTER (kind = 'module') AS found
FROM nodes0 GROUP BY repo_id HAVING found <> 24
UNION ALL SELECT repo_id, 'file', 2000, count(*) FILTER (kind = 'file') AS found
FROM nodes0 GROUP BY repo_id HAVING found <> 2000"""),
    "determinism": with_(
        TOUCHED,
        """SELECT repo_id, id, kind, parent, path, layer, loc, commits, authors, last_changed_at,
  'left' AS only_in FROM act WHERE loc % 25 = 0
UNION ALL
SELECT repo_id, id, kind, parent, path, layer, loc, commits + 1, authors, last_changed_at,
  'right' FROM act WHERE loc % 25 = 0"""),
    "document_roundtrip": with_(
        DOC_NODES,
        """SELECT repo_id, id, kind, parent, layer, loc, churn, last_changed_at FROM doc_nodes
WHERE repo_id IN (SELECT repo_id FROM doc_repos)"""),
    "document_edges": with_(
        DOC_NODES, "SELECT * FROM doc_edges WHERE repo_id IN (SELECT repo_id FROM doc_repos)"),
    "document_cochanges": with_(
        DOC_NODES,
        """SELECT p.repo_id, n.kind, p.a, p.b, p.count
FROM doc_pairs p LEFT JOIN doc_nodes n ON n.repo_id = p.repo_id AND n.id = p.a
WHERE p.repo_id IN (SELECT repo_id FROM doc_repos)"""),
    "document_folder_status": with_(
        DOC_NODES,
        """, placed AS (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY id) - 1 AS n FROM doc_nodes),
spoilt AS (SELECT repo_id, max(CASE WHEN id = 'm7/f7.ts' THEN 1 ELSE 0 END) AS json,
                  max(CASE WHEN id = 'm3/f3.ts' THEN n END) AS n FROM placed GROUP BY repo_id)
SELECT repo_id, CASE WHEN json = 1 OR n IS NOT NULL THEN 'malformed' ELSE 'ok' END AS status,
       CASE WHEN json = 1 THEN 'not valid JSON' WHEN n IS NOT NULL THEN 'not a node at index ' || n END AS detail
FROM doc_repos LEFT JOIN spoilt USING (repo_id)"""),
    "document_violations": "WITH c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS repo_id FROM customer)\n"
    + " UNION ALL ".join(
        f"SELECT repo_id, '{place}' AS path, '{message}' AS message FROM c WHERE {broken}"
        for place, message, broken in (
            ("/nodes/0/kind", _ENUM, "c_nationkey > 20"),
            ("/nodes/0/parent", "must have required property ''parent''", "c_nationkey = 13"),
            ("/nodes/0/path", "must NOT have fewer than 1 characters", "c_nationkey = 3"),
            ("/nodes/0/layer", _ENUM, "c_mktsegment = 'BUILDING'"),
            ("/nodes/0/loc", "must be >= 0", "floor(c_acctbal) < 0"),
            ("/nodes/0/churn", "must be <= 1", "c_nationkey = 4"),
            ("/nodes/0/commits", "must be integer", "c_nationkey = 6"),
            ("/nodes/0/authors", "must be integer", "c_nationkey = 8"),
            ("/nodes/0/lastChangedAt", 'must match format "date-time"', "c_nationkey = 5"),
            ("/nodes/0/description", "must be null", "c_nationkey = 7"),
            ("/nodes/0", "must NOT have additional properties", "c_nationkey = 11"),
            ("/schemaVersion", "must be equal to constant", "c_custkey % 10 = 0"),
            ("/repo/analysisWindowDays", "must be >= 1", "c_custkey % 9 = 0"),
            ("/repo/stats/languages/go", "must be <= 1", "c_custkey % 8 = 0"),
        )
    ),
    "document_order": """WITH v AS (
  SELECT l_orderkey || '-' || l_linenumber AS repo_id, CAST(l_partkey AS VARCHAR) AS p,
    CAST(l_suppkey AS VARCHAR) AS s, CAST(l_linenumber AS VARCHAR) AS x, CAST(l_linenumber % 3 AS VARCHAR) AS y,
    CAST(l_quantity AS INTEGER) % 5 AS m, l_linenumber % 5 AS n, l_returnflag AS a, l_linestatus AS b
  FROM lineitem),
found AS (
  SELECT repo_id, '/nodes' AS path FROM v WHERE p > s
  UNION ALL SELECT repo_id, '/edges' FROM v WHERE x > y OR (x = y AND p > s)
  UNION ALL SELECT repo_id, '/cochanges' FROM v WHERE m < n OR (m = n AND a > b))
SELECT repo_id, path, 'must be in stable order' AS message, count(*) AS n FROM found GROUP BY ALL""",
    "document_budget": with_(
        DOC_NODES + f""",
pieces AS (
  SELECT repo_id, 'n' AS section, '{{"id":"' || id || '","kind":"' || kind || '","parent":'
    || coalesce('"' || parent || '"', 'null') || ',"path":"' || path || '","layer":"' || layer
    || '","loc":' || loc || ',"churn":0.5,"commits":' || loc || ',"authors":1,"lastChangedAt":'
    || '"{_ISO_NOW}","description":null,"descriptionSource":null}}' AS line
  FROM doc_nodes
  UNION ALL
  SELECT repo_id, 'e', '{{"source":"' || source || '","target":"' || target
    || '","kind":"import","weight":1}}'
  FROM doc_edges WHERE repo_id IN (SELECT repo_id FROM doc_repos)
  UNION ALL
  SELECT repo_id, 'c', '{{"a":"' || a || '","b":"' || b || '","count":' || count || '}}'
  FROM doc_pairs WHERE repo_id IN (SELECT repo_id FROM doc_repos)
  UNION ALL
  SELECT repo_id, 'frame', '{{"schemaVersion":"1.0","repo":{{"name":"' || repo_id
    || '","remoteUrl":null,"analyzedAt":"{_ISO_NOW}","defaultBranch":"main",'
    || '"analysisWindowDays":90,"stats":{{"files":' || count(*) || ',"loc":' || sum(loc)
    || ',"commits":0,"languages":{{"typescript":1.0}}}}}},"nodes":['
    || '],"edges":[' || '],"cochanges":[' || ']}}'
  FROM doc_nodes WHERE kind = 'file' GROUP BY repo_id),
-- a line break per line, a comma before every element but the first of its list
sizes AS (
  SELECT repo_id, CAST(sum(n) AS BIGINT) AS bytes FROM (
    SELECT repo_id, sum(strlen(line)) + CASE WHEN section = 'frame' THEN 4 ELSE 2 * count(*) - 1 END
      AS n FROM pieces GROUP BY repo_id, section) GROUP BY repo_id)""",
        "SELECT repo_id, bytes, bytes <= 10000 AS within_limit FROM sizes"),
    "document_status": """WITH v AS (SELECT CAST(event_id AS VARCHAR) AS repo_id, event_id, props FROM events)
SELECT repo_id,
  CASE event_id % 6 WHEN 1 THEN 'ok' WHEN 2 THEN 'unsupported-version' ELSE 'malformed' END AS status,
  CASE event_id % 6
    WHEN 0 THEN CASE WHEN json_valid(props) THEN 'schemaVersion is missing' ELSE 'not valid JSON' END
    WHEN 2 THEN 'schemaVersion is not supported: ' || (event_id % 9 + 2) || '.0'
    WHEN 3 THEN '`nodes` array is missing'
    WHEN 4 THEN 'not a node at index 1'
    WHEN 5 THEN '`repo.stats` is missing' END AS detail
FROM v""",
}
ORACLES |= {
    f"document_folder_{kind}": ORACLES[whole]
    for kind, whole in (
        ("nodes", "document_roundtrip"), ("edges", "document_edges"), ("cochanges", "document_cochanges")
    )
}
