"""Operator 7: SimHash fingerprints of documents and a search within a Hamming radius.

A text's terms are its neighbouring word pairs, in lower case; a pair weighs as
many votes as it has characters, up to a bound, as short function words say
little. Each term's hash votes for or against every bit with its weight, and a
bit is set if the votes for it win. Votes are summed by one aggregate that
combines before it shuffles, two bits to a long. A search looks fingerprints up
in permuted block tables: with a radius of r, 2r blocks and a table for every r
of them, two fingerprints within the radius agree in all blocks of some table.

All of it is DataFrame code. Defined cases: a null text is empty; a text without
words has fingerprint zero, a single word is a term of its own; a null id comes
before all others; rows equal in id and text are one document and give a row each; the only document
follows itself; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom.llm.common import store

#: a term's most votes, and the radius of the search
HEAVIEST, RADIUS = 16, 3
LANES = 0x0000000100000001


def fingerprints(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The keys and `print`, the 64 bits as a long; rows of equal keys hold equal texts."""
    words = F.array_remove(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), "")
    listed = texts.select(*keys, words.alias("w"))
    pairs = F.arrays_zip(
        F.when(F.size("w") > 1, F.slice("w", 1, F.size("w") - 1)).otherwise(F.col("w")).alias("a"),
        F.when(F.size("w") > 1, F.slice("w", 2, F.size("w") - 1)).otherwise(F.col("w")).alias("b"),
    )
    terms = listed.select(*keys, F.inline_outer(pairs).alias("a", "b")).select(
        *keys,
        F.xxhash64("a", "b").alias("h"),
        F.least(F.octet_length("a") + F.octet_length("b"), F.lit(HEAVIEST)).cast("long").alias("votes"),
    )
    summed = terms.groupBy(*keys).agg(
        F.sum("votes").alias("total"),
        *(
            F.sum(F.col("votes") * F.shiftrightunsigned("h", bit).bitwiseAND(F.lit(LANES))).alias(f"for_{bit}")
            for bit in range(32)
        ),
    )
    value = F.lit(0).cast("long")
    for bit in range(32):
        low, high = F.col(f"for_{bit}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"for_{bit}", 32)
        for won, place in ((low, bit), (high, bit + 32)):
            signed = (1 << place) - (1 << 64 if place == 63 else 0)
            value = value.bitwiseOR(F.when(won * 2 > F.col("total"), F.lit(signed)).otherwise(F.lit(0)).cast("long"))
    return summed.select(*keys, value.alias("print"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def block_masks(radius: int) -> list[int]:
    """The bits of each permuted table."""
    blocks = max(1, 2 * radius)
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(bounds, bounds[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, max(1, blocks - radius))]


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, found) of all fingerprints of the index within the radius of a query's.

    Both hold distinct `print`s. A pair is given out by the first table that
    brings it together, so no pair comes twice and only pairs within the radius
    leave the join.
    """
    masks = [mask - (1 << 64 if mask >> 63 else 0) for mask in block_masks(radius)]
    listed = F.array(*map(F.lit, masks))

    def tables(prints: DataFrame, name: str) -> DataFrame:
        rows = prints.select(F.col("print").alias(name), F.posexplode(listed).alias("table", "mask"))
        return rows.select(name, "table", F.col(name).bitwiseAND(F.col("mask")).alias("block"))

    # Spark's size estimate leaves out the explosion and would broadcast what grows
    joined = tables(queries, "print").hint("merge").join(tables(index, "found"), ["table", "block"])
    differs = F.col("print").bitwiseXOR(F.col("found"))
    first = F.array_position(
        F.transform(listed, lambda mask: differs.bitwiseAND(mask) == 0), F.lit(True)
    )
    return joined.where(F.bit_count(differs) <= radius).where(first == F.col("table") + 1).select("print", "found")


def following(docs: DataFrame) -> DataFrame:
    """(doc, tie, n, copies, next_doc, next_tie): each document's successor by id, the first after the last.

    Ids are dealt out by range and ordered within each range; only the ranges'
    first ids, one row a partition, meet in one place.
    """
    ids = docs.groupBy("doc", "tie").agg(
        F.max(F.length("text")).cast("long").alias("n"), F.count("*").cast("int").alias("copies")
    )
    dealt = store(ids.repartitionByRange("doc", "tie").withColumn("part", F.spark_partition_id()))
    first = dealt.groupBy("part").agg(F.min(F.struct("doc", "tie")).alias("first"))
    parts = Window.orderBy("part")
    after = first.select(
        "part",
        F.coalesce(
            F.lead("first").over(parts),
            F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    order = Window.partitionBy("part").orderBy("doc", "tie")
    placed = dealt.withColumn("next", F.lead(F.struct("doc", "tie")).over(order)).join(F.broadcast(after), "part")
    nearest = F.coalesce("next", "after")
    return store(placed.select("doc", "tie", "n", "copies", nearest["doc"].alias("next_doc"), nearest["tie"].alias("next_tie")))


def identified(docs: DataFrame) -> DataFrame:
    """doc (a null id before all others), tie and the text without nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
    )


def edits(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(doc, tie, n, text, edited): the last quarter replaced by the start of the next document."""
    wanted = order.select(
        F.col("next_doc").alias("doc"), F.col("next_tie").alias("tie"),
        F.struct("doc", "tie").alias("of"), F.floor(F.col("n") / 4).cast("int").alias("k"),
    )
    heads = docs.join(wanted, ["doc", "tie"]).select(
        F.col("of.doc").alias("doc"), F.col("of.tie").alias("tie"),
        F.substring("text", F.lit(1), F.col("k")).alias("head"),
    ).dropDuplicates(["doc", "tie"])  # the next document may stand in many rows
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    joined = docs.join(order.select("doc", "tie", "n"), ["doc", "tie"]).join(heads, ["doc", "tie"])
    return joined.select("doc", "tie", "n", "text", F.concat(kept, F.col("head")).alias("edited"))


def compare_edits(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, and the search.

    `n_near` is the number of different fingerprints within the radius, its own
    left out, for the documents whose id 20 divides, the search's queries.
    """
    known = identified(docs)
    order = following(known)
    both = edits(known, order).select(
        "doc", "tie", "n", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(
            F.struct(F.lit(False).alias("changed"), F.col("text").alias("version")),
            F.struct(F.lit(True).alias("changed"), F.col("edited").alias("version")),
        )).alias("v"),
    ).select("doc", "tie", "n", "edited_sha256", "v.changed", "v.version")
    prints = fingerprints(both, "version", ["doc", "tie", "n", "edited_sha256", "changed"])
    paired = store(prints.groupBy("doc", "tie").agg(
        F.max("n").alias("n_chars"),
        F.max("edited_sha256").alias("edited_sha256"),
        F.max(F.when(~F.col("changed"), F.col("print"))).alias("print"),
        F.max(F.when(F.col("changed"), F.col("print"))).alias("edited_print"),
    ))
    index = paired.select("print").distinct()
    queries = paired.where("doc % 20 = 0").select("print").distinct()
    near = within(queries, index, radius).groupBy("print").agg((F.count("*") - 1).alias("n_near"))
    nexts = paired.select(F.col("doc").alias("next_doc"), F.col("tie").alias("next_tie"), F.col("print").alias("next_print"))
    linked = order.select("doc", "tie", "copies", "next_doc", "next_tie").join(nexts, ["next_doc", "next_tie"])
    whole = paired.join(linked, ["doc", "tie"]).join(near, "print", "left")
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return whole.select(
        F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        _hexadecimal("print").alias("fingerprint"),
        _hexadecimal("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        F.when(F.col("doc") % 20 == 0, F.col("n_near")).alias("n_near"),
    )


def _hexadecimal(value: str) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
