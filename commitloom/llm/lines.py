"""Operator 4: fuzzy duplicate lines, one of each group kept.

Distinct lines get a MinHash signature over all their character shingles: a
shingle is hashed once, each signature place takes the least value of its own
mixing of that hash. Bands of signature places are buckets; in each bucket every
line is held against two lines of it: the one that occurs most often, of which
the others tend to be variants, and the least by an order of the bucket's own.
Lines that a bucket still holds apart meet by their rarest shingles (`alike.py`), so
no like pair that shares a bucket is left out. Pairs count only if the exact Jaccard
similarity of their shingle sets reaches the threshold. Connected lines form a
component by distributed union-find, and of all places of a component's lines
the first, by document and place, is kept.

Characters are UTF-16 units here, of which a shingle is cut at a fixed cost.

All of it is DataFrame code. Defined cases: a null text has no line, an empty
text one blank line; blank lines are always kept; a line shorter than a shingle
is a shingle of its own; a null id comes before all others; rows equal in id and
text are one document; an empty table gives an empty one; other columns are
carried by `drop_lines` and ignored by `line_classes`. Lines are identified by a
64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom.llm import alike
from commitloom.llm.common import free, store
from commitloom.llm.components import components

#: characters of a shingle; signature places of a band, bands; the least similarity
SHINGLE, ROWS, BANDS, SIMILAR = 8, 4, 11, 0.8
#: bytes of a character; shingles of one row
UNIT, TOGETHER = 2, 16
BLANKS = " \t\r\x0b\f"


def recall(similarity: float, rows: int = ROWS, bands: int = BANDS) -> float:
    """The probability that two lines of a similarity share a bucket."""
    return alike.recall(similarity, rows, bands)


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) == ""


def _identified(docs: DataFrame, *others: Column) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("tie"),
        F.col("text").alias("text"),
        *others,
    )


def places(docs: DataFrame) -> DataFrame:
    """(id, line, at) of every line that is not blank; at: document and place."""
    lines = _identified(docs).select("doc", "tie", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return lines.where(~_blank(F.col("line"))).select(
        F.xxhash64("line").alias("id"), "line", F.struct("doc", "tie", "place").alias("at")
    )


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(id, line, n): every different line once, and how often it occurs."""
    return places(docs).groupBy("id", "line").agg(F.count("*").alias("n"))


def _wide(line: str) -> Column:
    """A line with all its characters of one width."""
    return F.encode(F.col(line), "UTF-16BE")


def _shingles(data: Column) -> Column:
    """Starts of a line's shingles in its bytes, from 1."""
    last = F.octet_length(data) - (SHINGLE * UNIT - 1)
    return F.sequence(F.lit(1), F.greatest(F.lit(1), last), F.lit(UNIT))


def _hashes(name: str) -> Column:
    """The different shingle hashes of a line, given as `_wide` makes it.

    The line is bound once, as a list's element: read from its row it would be copied
    for every shingle.
    """
    def hashed(data: Column) -> Column:
        return F.transform(
            _shingles(data), lambda start: F.xxhash64(F.substring(data, start, F.lit(SHINGLE * UNIT)))
        )

    return F.array_distinct(F.get(F.transform(F.array(F.col(name)), hashed), F.lit(0)))


def signatures(lines: DataFrame) -> DataFrame:
    """(id, n, s0, s1, ...): at each place the shingle hash next to the place's own point.

    Of the hashes combined with a drawn point by exclusive or the least one is as
    likely to be any shingle's, and two sets agree in it with the probability of
    their Jaccard similarity.
    """
    wide = lines.select("id", "n", _wide("line").alias("data")).withColumn(
        "last", F.greatest(F.lit(1), F.octet_length("data") - (SHINGLE * UNIT - 1))
    )
    starts = wide.select(
        "id", "n", "data", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(TOGETHER * UNIT))).alias("start")
    )
    # a place is brought up to date once for several shingles; behind the last one it is taken again
    each = [F.least(F.col("start") + k * UNIT, F.col("last")) for k in range(TOGETHER)]
    hashes = starts.select("id", "n", *(
        F.shiftright(F.xxhash64(F.substring("data", start, F.lit(SHINGLE * UNIT))), 32).cast("int").alias(f"h{k}")
        for k, start in enumerate(each)
    ))
    return hashes.groupBy("id").agg(
        F.max("n").alias("n"),
        *(F.min(F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(point)) for j in range(TOGETHER)))).alias(f"s{k}")
          for k, point in enumerate(alike.points(ROWS * BANDS, 4))),
    )


def buckets(signed: DataFrame) -> DataFrame:
    """(bucket, id, n): each line in a bucket of every band."""
    bands = F.array(*(
        F.xxhash64(F.lit(band), *(f"s{band * ROWS + row}" for row in range(ROWS))) for band in range(BANDS)
    ))
    return signed.select(F.explode(bands).alias("bucket"), "id", "n")


def links(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(a, b): similar lines by id, enough of them to connect all alike that share a bucket."""
    lines = store(distinct_lines(docs))
    shared = store(alike.members(buckets(signatures(lines))))
    free(docs.sparkSession)
    # the texts of those alone that share a bucket
    some = store(
        lines.join(shared.select("id").distinct(), "id", "left_semi").select("id", _wide("line").alias("data"), "n")
    )
    return alike.links(shared, some, _hashes, similarity)


def gone_places(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(doc, tie, gone): the places of the lines each document loses."""
    alike = links(docs, similarity)
    free(docs.sparkSession)
    found = components(alike).withColumnRenamed("node", "id")
    placed = places(docs).select("id", "at.*").join(found, "id", "left").select(
        F.coalesce("component", "id").alias("component"), "doc", "tie", "place"
    )
    first = placed.groupBy("component").agg(
        F.min(F.struct("doc", "tie", "place")).alias("first"), F.count("*").alias("n")
    ).where("n > 1").select("component", "first")
    gone = placed.join(first, "component").where(F.struct("doc", "tie", "place") > F.col("first"))
    # rows equal in id and text are one document
    return gone.groupBy("doc", "tie").agg(F.collect_set("place").alias("gone"))


def _with_kept(docs: DataFrame, similarity: float) -> DataFrame:
    """The columns but the text as `row`, text, n_lines, n_kept and the text of the kept lines."""
    rows = _identified(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    joined = rows.join(gone_places(docs, similarity), ["doc", "tie"], "left")
    split = joined.select("row", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    # sets of places: each step takes a document's lines once
    left = split.select("row", "text", "lines", F.when(
        F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    ).alias("left"))
    kept = F.transform("left", lambda place: F.get("lines", place))
    return left.select(
        "row",
        "text",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).when(F.col("left").isNull(), F.size("lines"))
        .otherwise(F.size("left")).cast("long").alias("n_kept"),
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def line_classes(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """doc_id, n_lines, n_removed, and the digest of the lines kept."""
    return _with_kept(docs.select("doc_id", "text"), similarity).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        "n_lines",
        (F.col("n_lines") - F.col("n_kept")).alias("n_removed"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """The documents with their kept lines; one that loses all its lines goes."""
    kept = _with_kept(docs, similarity)
    changed = F.col("n_kept") < F.col("n_lines")
    columns = []
    for name in docs.columns:
        value = F.col("text") if name == "text" else F.col(f"row.`{name}`")
        if name == "text":
            value = F.when(changed, F.col("kept_text")).otherwise(value)
        elif name == "n_chars":
            value = F.when(changed, F.length("kept_text")).otherwise(value).cast(docs.schema[name].dataType)
        columns.append(value.alias(name))
    return kept.where(~changed | F.col("kept_text").rlike(r"\S")).select(columns)
