"""Checks on documents and tables. Every check returns all violations as rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from commitloom.functions import fixed_values as fv
from commitloom.operators import resolution as res
from commitloom.sources.documents import is_type

# ------------------------------------------------- instants


def is_instant(value: Column) -> Column:
    """Strict RFC 3339: a real calendar day, no second 60, year 1 or later.

    The form is a matter of fixed positions; whether the day exists is left to
    the calendar of ``make_date``, and the times to plain comparison.
    """
    text = F.upper(value)
    day, clock = F.substring_index(text, "T", 1), F.substring_index(text, "T", -1)
    zone = F.regexp_extract(clock, r"(Z|[+-]\d\d:\d\d)$", 1)
    time = F.call_function("left", clock, F.length(clock) - F.length(zone))
    formed = (
        day.rlike(r"^\d{4}-\d\d-\d\d$") & time.rlike(r"^\d\d:\d\d:\d\d(\.\d+)?$")
        & (zone != "") & (text == F.concat_ws("T", day, clock)) & ~value.rlike(r"\s")
    )
    year, month, date = (F.get(F.split(day, "-"), n).try_cast("int") for n in range(3))
    real = (year > 0) & F.call_function("try_to_date", day).isNotNull() & (month > 0) & (date > 0)
    # equal widths, so text order is the order of the numbers
    in_day = (
        (F.substring(time, 1, 2) < "24") & (F.substring(time, 4, 2) < "60") & (F.substring(time, 7, 2) < "60")
    )
    in_zone = (zone == "Z") | ((F.substring(zone, 2, 2) < "24") & (F.substring(zone, 5, 2) < "60"))
    return F.coalesce(formed & real & in_day & in_zone, F.lit(False))


# ------------------------------------------------- documents

Check = Callable[[Column], list[tuple[Column, str]]]


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _integer(minimum: int) -> Check:
    def check(v: Column) -> list[tuple[Column, str]]:
        whole = is_type(v, "number") & (_number(v) == F.floor(_number(v)))
        return [
            (~whole, "must be integer"),
            (is_type(v, "number") & (_number(v) < minimum), f"must be >= {minimum}"),
        ]

    return check


def _share(v: Column) -> list[tuple[Column, str]]:
    numeric = is_type(v, "number")
    return [
        (~numeric, "must be number"),
        (numeric & (_number(v) < 0), "must be >= 0"),
        (numeric & (_number(v) > 1), "must be <= 1"),
    ]


def _string(nullable: bool = False, filled: bool = False, instant: bool = False) -> Check:
    types = ("string", "null") if nullable else ("string",)

    def check(v: Column) -> list[tuple[Column, str]]:
        value = F.try_variant_get(v, "$", "string")
        found = [(~is_type(v, *types), "must be " + ",".join(types))]
        if filled:
            found.append(
                (is_type(v, "string") & (value == ""), "must NOT have fewer than 1 characters")
            )
        if instant:
            found.append(
                (is_type(v, "string") & ~is_instant(value), 'must match format "date-time"')
            )
        return found

    return check


def _one_of(*allowed: str) -> Check:
    def check(v: Column) -> list[tuple[Column, str]]:
        known = is_type(v, "string") & F.try_variant_get(v, "$", "string").isin(*allowed)
        message = (
            "must be equal to one of the allowed values"
            if len(allowed) > 1
            else "must be equal to constant"
        )
        return [(~known, message)]

    return check


def _of_type(name: str) -> Check:
    return lambda v: [(~is_type(v, name), f"must be {name}")]


# The document contract, field by field.
ROOT = {
    "schemaVersion": _one_of(fv.SCHEMA_VERSION),
    "repo": _of_type("object"),
    "nodes": _of_type("array"),
    "edges": _of_type("array"),
    "cochanges": _of_type("array"),
}
REPO = {
    "name": _string(filled=True),
    "remoteUrl": _string(nullable=True),
    "analyzedAt": _string(instant=True),
    "defaultBranch": _string(filled=True),
    "analysisWindowDays": _integer(1),
    "stats": _of_type("object"),
}
STATS = {
    "files": _integer(0),
    "loc": _integer(0),
    "commits": _integer(0),
    "languages": _of_type("object"),
}
NODE = {
    "id": _string(filled=True),
    "kind": _one_of(*fv.KINDS),
    "parent": _string(nullable=True),
    "path": _string(filled=True),
    "layer": _one_of(*fv.LAYERS),
    "loc": _integer(0),
    "churn": _share,
    "commits": _integer(0),
    "authors": _integer(0),
    "lastChangedAt": _string(nullable=True, instant=True),
    "description": _of_type("null"),
    "descriptionSource": _of_type("null"),
}
EDGE = {
    "source": _string(filled=True),
    "target": _string(filled=True),
    "kind": _one_of("import"),
    "weight": _integer(1),
}
PAIR = {
    "a": _string(filled=True),
    "b": _string(filled=True),
    "count": _integer(1),
}


def _problem(path: Column, message: str | Column) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(path.alias("path"), message.alias("message"))


def _object_problems(value: Column, keys: Column, at: Column, fields: dict[str, Check]) -> Column:
    """Array of ``(path, message)`` of one JSON object with these keys, or of a non-object."""
    found = []
    for name, check in fields.items():
        field = F.try_variant_get(value, f"$.{name}", "variant")
        here = F.concat(at, F.lit(f"/{name}"))
        present = F.array_contains(keys, name)
        found.append(
            F.when(~present, _problem(here, f"must have required property '{name}'"))
        )
        found += [
            F.when(present & broken, _problem(here, message))
            for broken, message in check(field)
        ]
    extra = F.transform(
        F.filter(keys, lambda k: ~k.isin(*fields)),
        lambda _: _problem(
            F.when(at == "", "/").otherwise(at), "must NOT have additional properties"
        ),
    )
    wrong = F.array(_problem(F.when(at == "", "/").otherwise(at), "must be object"))
    return F.when(
        is_type(value, "object"), F.concat(F.array_compact(F.array(*found)), extra)
    ).otherwise(wrong)


# The lists of a document, and what holds for their elements.
LISTS = {"/nodes": NODE, "/edges": EDGE, "/cochanges": PAIR}
OBJECTS = {"": ROOT, "/repo": REPO, "/repo/stats": STATS}
SHARES = "/repo/stats/languages"


def _path(part: str) -> str:
    return "$" + part.replace("/", ".")


def _parts(part: Column) -> Column:
    """Array of ``(at, value)`` of what a part of the document ``v`` has to be checked."""
    def one(at: Column, value: Column) -> Column:
        return F.struct(at.alias("at"), value.alias("value"))

    def own(at: str) -> Column:
        value = F.try_variant_get("v", _path(at), "variant")
        return F.when(is_type(value, "object"), F.array(one(F.lit(at), value)))

    def elements(at: str) -> Column:
        return F.transform(
            F.try_variant_get("v", _path(at), "array<variant>"),
            lambda value, place: one(F.concat(F.lit(f"{at}/"), place.cast("string")), value),
        )

    shares = F.transform(
        F.map_entries(F.try_variant_get("v", _path(SHARES), "map<string,variant>")),
        lambda entry: one(F.concat(F.lit(f"{SHARES}/"), entry["key"]), entry["value"]),
    )
    # the root is checked in any case, also where there is no valid document
    found = F.when(part == "", F.array(one(F.lit(""), F.col("v")))).when(part == SHARES, shares)
    for at in OBJECTS:
        if at:
            found = found.when(part == at, own(at))
    for at in LISTS:
        found = found.when(part == at, elements(at))
    return found


def validate_documents(docs: DataFrame) -> DataFrame:
    """``(repo_id, path, message)`` for every contract violation of ``docs(repo_id, raw)``.

    A text is parsed once; a part of it after the other is cut into the values to check.
    Checks cost far more than their bytes, so the texts are dealt to all tasks first, as
    many as the session shuffles to whatever the bytes.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = docs.repartition(tasks, "repo_id", "raw").select("repo_id", F.try_parse_json("raw").alias("v"))
    parts = [*OBJECTS, SHARES, *LISTS]
    each = parsed.select("repo_id", "v", F.explode(F.array(*[F.lit(part) for part in parts])).alias("part"))
    values = each.select("repo_id", "part", F.inline(_parts(F.col("part"))))
    keyed = values.select(
        "*", F.map_keys(F.try_variant_get("value", "$", "map<string,variant>")).alias("keys")
    )
    at, value = F.col("at"), F.col("value")
    problems = F.when((F.col("part") == "") & value.isNull(), F.array(_problem(F.lit("/"), "must be valid JSON"))).when(
        F.col("part") == SHARES, F.array_compact(F.array(*[F.when(b, _problem(at, m)) for b, m in _share(value)]))
    )
    for part, fields in {**OBJECTS, **LISTS}.items():
        problems = problems.when(F.col("part") == part, _object_problems(value, F.col("keys"), at, fields))
    return keyed.select("repo_id", F.inline(problems))


def document_order(docs: DataFrame) -> DataFrame:
    """Lists of a document that are not in their stable order."""

    def unordered(name: str, key: Callable[[Column], Column]) -> Column:
        keys = F.transform(F.try_variant_get(F.try_parse_json("raw"), f"$.{name}", "array<variant>"), key)
        return F.coalesce(keys != F.array_sort(keys), F.lit(False))

    field = lambda e, n, t="string": F.try_variant_get(e, f"$.{n}", t)
    lists = F.array(
        F.when(unordered("nodes", lambda e: field(e, "id")), "/nodes"),
        F.when(
            unordered("edges", lambda e: F.struct(field(e, "source"), field(e, "target"))), "/edges"
        ),
        F.when(
            unordered(
                "cochanges",
                lambda e: F.struct(-field(e, "count", "long"), field(e, "a"), field(e, "b")),
            ),
            "/cochanges",
        ),
    )
    return docs.select("repo_id", F.explode(F.array_compact(lists)).alias("path")).withColumn(
        "message", F.lit("must be in stable order")
    )


# ------------------------------------------------- tables


def node_ranges(nodes: DataFrame) -> DataFrame:
    """Value violations of a node table, addressed ``/nodes/<id>/<field>``."""

    def rule(field: str, broken: Column, message: str) -> Column:
        path = F.concat(F.lit("/nodes/"), F.coalesce("id", F.lit("")), F.lit(f"/{field}"))
        return F.when(F.coalesce(broken, F.lit(True)), _problem(path, message))

    found = F.array(
        rule("id", F.length("id") < 1, "must NOT have fewer than 1 characters"),
        rule("path", F.length("path") < 1, "must NOT have fewer than 1 characters"),
        rule("kind", ~F.col("kind").isin(*fv.KINDS), "must be equal to one of the allowed values"),
        rule("layer", ~F.col("layer").isin(*fv.LAYERS), "must be equal to one of the allowed values"),
        rule("loc", F.col("loc") < 0, "must be >= 0"),
        rule("commits", F.col("commits") < 0, "must be >= 0"),
        rule("authors", F.col("authors") < 0, "must be >= 0"),
        rule("churn", F.col("churn") < 0, "must be >= 0"),
        rule("churn", F.col("churn") > 1, "must be <= 1"),
    )
    return nodes.select("repo_id", F.inline(F.array_compact(found)))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return (
        nodes.groupBy("repo_id", "id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def edge_weights(edges: DataFrame, file_edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Module edges whose stated weight differs from the file pairs beneath."""
    expected = res.module_edges(file_edges, universe).select(
        "repo_id", "source", "target", F.col("weight").alias("expected")
    )
    modules = universe.where(F.col("kind") == "module").select(
        "repo_id", F.col("id").alias("source")
    )
    stated = edges.join(modules, ["repo_id", "source"], "left_semi").select(
        "repo_id", "source", "target", F.col("weight").alias("stated")
    )
    return expected.join(stated, ["repo_id", "source", "target"], "full").where(
        ~F.col("expected").eqNullSafe(F.col("stated"))
    )


def pair_rules(
    pairs: DataFrame,
    nodes: DataFrame,
    min_count: int = fv.MIN_PAIR_COUNT,
    max_pairs: int = fv.MAX_PAIRS_PER_KIND,
) -> DataFrame:
    """Pairs out of order, below the minimum, of mixed kinds, repeated, or too many."""
    kinds = nodes.select("repo_id", "id", "kind")
    known = (
        pairs.drop("kind")
        .join(kinds.select("repo_id", F.col("id").alias("a"), F.col("kind").alias("ka")),
              ["repo_id", "a"], "left")
        .join(kinds.select("repo_id", F.col("id").alias("b"), F.col("kind").alias("kb")),
              ["repo_id", "b"], "left")
    )
    at = F.concat_ws(" ", "a", "b")
    found = F.array_compact(
        F.array(
            F.when(F.col("a") >= F.col("b"), _problem(at, "a must come before b")),
            F.when(F.col("count") < min_count, _problem(at, f"count must be >= {min_count}")),
            F.when(~F.col("ka").eqNullSafe(F.col("kb")), _problem(at, "must be of one kind")),
        )
    )
    single = known.select("repo_id", F.inline(found))
    repeated = (
        pairs.groupBy("repo_id", "a", "b").agg(F.count("*").alias("n")).where("n > 1")
        .select("repo_id", at.alias("path"), F.lit("must be unique").alias("message"))
    )
    crowded = (
        known.groupBy("repo_id", "ka").agg(F.count("*").alias("n"))
        .where(F.col("n") > max_pairs)
        .select(
            "repo_id", F.col("ka").alias("path"),
            F.lit(f"must NOT have more than {max_pairs} pairs").alias("message"),
        )
    )
    return reduce(DataFrame.unionByName, [single, repeated, crowded])


#: parts of a table that are compared by a digest each; as many rows at most are broadcast
DIGESTS = 1 << 16


def _row_hash(rows: DataFrame, seed: int) -> Column:
    """A 64-bit hash of all columns; nulls are told apart by their place, inside of nested values too."""
    nested = [F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) for f in rows.schema
              if isinstance(f.dataType, (ArrayType, StructType))]
    return F.xxhash64(F.lit(seed), *rows.columns, *[F.col(c).isNull() for c in rows.columns], *nested)


def _digests(rows: DataFrame, name: str) -> DataFrame:
    """Per part the rows' number and two sums of their hashes, which no order changes."""
    parts = rows.select(
        F.pmod(_row_hash(rows, 0), F.lit(DIGESTS)).alias("_part"), _row_hash(rows, 1).alias("h"), _row_hash(rows, 2).alias("k")
    )
    return parts.groupBy("_part").agg(
        F.struct(F.count("*"), F.bit_xor("h"), F.sum(F.col("k").cast("decimal(38,0)"))).alias(name)
    )


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only one of two runs has; empty when both agree.

    Rows are dealt by their hash to parts, whose digests need one aggregate a
    table. Only rows of parts whose digests differ are compared themselves.
    """
    right = right.select(*left.columns)
    both = _digests(left, "l").join(_digests(right, "r"), "_part", "full")
    unequal = F.broadcast(both.where(~F.col("l").eqNullSafe(F.col("r"))).select("_part"))

    def doubtful(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("_part", F.pmod(_row_hash(rows, 0), F.lit(DIGESTS)))
        return marked.join(unequal, "_part", "left_semi").drop("_part")

    some, others = doubtful(left), doubtful(right)
    one = some.exceptAll(others).withColumn("only_in", F.lit("left"))
    two = others.exceptAll(some).withColumn("only_in", F.lit("right"))
    return one.unionByName(two)


def unmet_counts(nodes: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Kinds whose node count is not the expected one, in every repository."""
    counts = nodes.groupBy("repo_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in expected]
    )
    problems = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(kind) != n,
                    F.struct(
                        F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("expected"),
                        F.col(kind).alias("found"),
                    ),
                )
                for kind, n in expected.items()
            ]
        )
    )
    return counts.select("repo_id", F.inline(problems))
