"""Links between sets that are alike: shared MinHash buckets, then the exact Jaccard similarity.

In a bucket every member is held against two chosen ones, which links most of a
group of like members at a cost linear in the bucket. The others that a bucket still
holds apart after that, in different components, go on to an exact prefix-filter
join: their elements are ordered by how many of them hold it, rare first, and two
sets of similarity t must share one of the first n - ceil(t n) + 1 of a set's n
elements. What a whole family of unlike sets has in common comes last in that order,
so its members do not meet, and no bucket is ever compared pair by pair.

All of it is DataFrame code. Members are told apart by a 64-bit id and set
elements by a 64-bit hash.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom.llm.common import free, store
from commitloom.llm.components import components

#: an element's count, as far as it orders elements
MOST_HELD = (1 << 20) - 1


def recall(similarity: float, rows: int, bands: int) -> float:
    """The probability that two sets of a similarity share a bucket."""
    return 1 - (1 - similarity**rows) ** bands


def points(count: int, seed: int) -> list[int]:
    """Drawn 32-bit numbers; a signature place is the least of the hashes combined with one by exclusive or."""
    rng = random.Random(seed)
    return [rng.getrandbits(32) - (1 << 31) for _ in range(count)]


def members(rows: DataFrame) -> DataFrame:
    """(bucket, id, n, others) of buckets with company; others: the two the bucket has chosen."""
    rows = rows.repartition("bucket")
    # all columns go along so that the search for company and the join read the same shuffled rows
    found = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max("n").alias("n"))
    shared = found.where("least < most AND n > 0").select("bucket")
    # most buckets hold one member: the rows of the few others are picked without a sort of all
    few = rows.join(shared.hint("shuffle_hash"), "bucket")  # a semi join would go before the shuffle, which then runs twice
    bucket = Window.partitionBy("bucket")
    chosen = few.withColumns({
        "most": F.max(F.struct("n", "id")).over(bucket)["id"],
        "least": F.min(F.col("id").bitwiseXOR(F.col("bucket"))).over(bucket).bitwiseXOR(F.col("bucket")),
    })
    return chosen.select("bucket", "id", "n", F.array_distinct(F.array("most", "least")).alias("others"))


def _pairs(pairs: DataFrame) -> DataFrame:
    """(a, b), each pair (id, other) once."""
    return pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def chosen_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the two the bucket has chosen."""
    return _pairs(shared.select("id", F.explode("others").alias("other")).where("id <> other"))


def apart(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class) of members of buckets that hold more than one class, a component of the links.

    The members a bucket has chosen were held against all others of it; what is left to
    compare are the others among themselves.
    """
    found = components(links).withColumnRenamed("node", "id")
    unchosen = shared.where(~F.array_contains("others", F.col("id")))
    classed = unchosen.select("bucket", "id").join(found, "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("class")
    )
    mixed = classed.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
    return classed.join(mixed.select("bucket"), "bucket", "left_semi").select("id", "class").distinct()


def sharing_pairs(rest: DataFrame, items: DataFrame, hashes: Callable[[str], Column], similarity: float) -> DataFrame:
    """(a, b): the pairs of different classes of (id, class) that the prefix filter lets through.

    An element that one set alone holds links nothing, but stands first in its order.
    """
    sets = items.join(rest, "id").select("id", "class", hashes("data").alias("h"))
    sizes = store(sets.select("id", "class", F.size("h").alias("n")))
    # as in `members`: counts and join read the same shuffled rows, and only elements of several sets are looked up
    each = sets.select("id", F.explode("h").alias("h")).repartition("h")
    counted = each.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("least"), F.max("id").alias("most"))
    held = counted.where("least < most").select("h", "c")
    # rare first: one number an element, of its count and its hash, is sorted within each set; two elements of
    # one number make a pair more to compare, never one less
    number = F.shiftleft(F.least("c", F.lit(MOST_HELD)), 43).bitwiseOR(F.shiftrightunsigned("h", 21))
    numbered = each.join(held.hint("shuffle_hash"), "h").select("id", number.alias("h")).repartition("id")
    listed = numbered.groupBy("id").agg(F.sort_array(F.collect_list("h")).alias("h")).join(sizes, "id")
    # a set of n elements, m of them shared, is let go unless m - ceil(t n) + 1 of those are in its prefix
    m = F.size("h")
    length = (m - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    prefix = listed.where(length > 0).select(
        "id", "class", "n", m.alias("m"), F.posexplode(F.slice("h", F.lit(1), length)).alias("r", "h")
    ).select("h", "id", "class", "n", (F.col("m") - F.col("r") - 1).alias("after"))
    # written, so that both sides of the join read it and what led to it can go from the disks
    left = prefix = store(prefix)
    free(items.sparkSession)
    right = prefix.select(
        "h", F.col("id").alias("other"), F.col("class").alias("its"), F.col("n").alias("size"), F.col("after").alias("rest")
    )
    # at their first common element two sets have no more in common than it and what follows in both
    needed = (F.col("n") + F.col("size")) * (similarity / (1 + similarity))
    near = (F.least("n", "size") >= F.greatest("n", "size") * similarity - 1e-9) & (
        F.least("after", "rest") + 1 >= needed - 1e-9
    )
    return _pairs(left.join(right, "h").where((F.col("id") > F.col("other")) & (F.col("class") != F.col("its")) & near))


def similar(pairs: DataFrame, items: DataFrame, hashes: Callable[[str], Column], similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets' exact Jaccard similarity reaches the threshold; `hashes` reads a column's set."""
    left = items.select(F.col("id").alias("a"), F.col("data").alias("x"))
    right = items.select(F.col("id").alias("b"), F.col("data").alias("y"))
    sets = pairs.join(left, "a").join(right, "b").select("a", "b", hashes("x").alias("x"), hashes("y").alias("y"))
    counted = sets.select(
        "a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("both")
    )
    return counted.where(F.col("both") >= similarity * (F.col("nx") + F.col("ny") - F.col("both"))).select("a", "b")


def links(shared: DataFrame, items: DataFrame, hashes: Callable[[str], Column], similarity: float) -> DataFrame:
    """(a, b): links enough to connect all like items (id, n, data) that share a bucket.

    `shared` holds the stored members of the buckets.
    """
    spark = items.sparkSession
    near = store(similar(chosen_pairs(shared), items, hashes, similarity))
    free(spark)
    rest = store(apart(shared, near))
    free(spark)
    sharing = store(sharing_pairs(rest, items, hashes, similarity))
    free(spark)
    return near.unionByName(store(similar(sharing, items, hashes, similarity)))
