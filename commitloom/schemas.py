"""Table and document schemas. Instants are unix seconds, ids POSIX paths."""

FILES = "repo_id string, path string, content binary"
INVENTORY = "repo_id string, path string, entry_kind string"
COMMITS = "repo_id string, seq long, hash string, committed_at long, author_email string"
CHANGES = "repo_id string, seq long, pos int, status string, path string, old_path string"
UNIVERSE = (
    "repo_id string, id string, kind string, parent string, path string, "
    "layer string, loc long"
)
NODES = UNIVERSE + (
    ", churn double, commits long, authors long, last_changed_at long, "
    "description string, description_source string"
)
EDGES = "repo_id string, source string, target string, kind string, weight long"
COCHANGES = "repo_id string, kind string, a string, b string, count long"
WARNINGS = "repo_id string, stage string, code string, count long, detail string"
REPOS = (
    "repo_id string, name string, remote_url string, default_branch string, "
    "analyzed_at long, window_days int"
)

# the JSON document of one repository; JSON numbers are doubles, 3.0 is a whole one
DOCUMENT = """
schemaVersion string,
repo struct<name string, remoteUrl string, analyzedAt string, defaultBranch string,
  analysisWindowDays double,
  stats struct<files double, loc double, commits double, languages map<string,double>>>,
nodes array<struct<id string, kind string, parent string, path string, layer string,
  loc double, churn double, commits double, authors double, lastChangedAt string,
  description string, descriptionSource string>>,
edges array<struct<source string, target string, kind string, weight double>>,
cochanges array<struct<a string, b string, count double>>
"""
