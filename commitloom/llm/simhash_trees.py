"""Operator 10: near-duplicate documents by SimHash, searched with BK-trees.

A fingerprint bit is set if it is set in over half of the hashes of a text's word
shingles, repeats included. Distinct fingerprints go to shards that two
fingerprints within the radius must share: four 16-bit blocks differ in at most
three bits only if one block is equal, and the same holds for four 12-bit blocks
of the rest, so sixteen tables of 28 bits lose no link. A shard's fingerprints
form a BK-tree: children are keyed by their Hamming distance to the parent, a
search follows only the edges within the radius. A shard gives out the links
that join two of its groups, never all pairs; components of all links follow.

The trees are built where their shard lies and not broadcast, as together they
grow with the data. For a wider radius no such blocks are selective; tables of
drawn bit positions then find a link with the probability `recall` states.

Defined cases: null and wordless texts have fingerprint zero and are linked like
any other; a text shorter than a shingle is one shingle; rows under one id are
judged each by its own text; a null id forms no link of its own and takes its
fingerprint's component; an empty table gives an empty one; other columns are kept by
`keep_one` and ignored elsewhere.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import binary, store
from commitloom.llm.components import components

SHINGLE, RADIUS = 3, 3
#: for a radius over three: drawn tables and the bits of each
TABLES, TABLE_BITS = 60, 14


def shingle_hashes(text: bytes, shingle: int):
    """64-bit hashes of a text's lower-cased word shingles, repeats included; none without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, size = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    spans = zip(starts, ends[size - 1 :].tolist(), strict=False)
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], "<u8")


def voted(hashes) -> int:
    """Unsigned 64-bit SimHash of shingle hashes; 0 without any."""
    import numpy as np

    votes = np.zeros(64, "i8")
    for some in range(0, len(hashes), 1 << 16):
        part = hashes[some : some + (1 << 16)].view("u1").reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """Unsigned 64-bit SimHash of a text's lower-cased word shingles; 0 without words."""
    return voted(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and print, the fingerprint's bits as a long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda batches: _prints(batches, shingle), "doc_id long, print long")


def _prints(batches: Iterator, shingle: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        prints = [fingerprint(text, shingle) for text in binary(batch.column("text"))]
        signed = pa.array(np.array(prints, "u8").view("i8"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], ["doc_id", "print"])


def shard_masks(radius: int) -> list[int]:
    """The bits of each table; fingerprints that agree in all of one table's share a shard."""
    if radius <= 3:
        masks = []
        for outer in range(4):
            rest = [b for b in range(4) if b != outer]
            for inner in range(4):
                # a block of 16 bits, and 4 bits of each other block
                mask = 0xFFFF << 16 * outer
                masks.append(mask | sum(0xF << 16 * block + 4 * inner for block in rest))
        return masks
    rng = random.Random(7)
    return [sum(1 << place for place in rng.sample(range(64), TABLE_BITS)) for _ in range(TABLES)]


def recall(distance: int) -> float:
    """The probability that drawn tables bring two fingerprints of a distance together."""
    apart = 1.0
    for k in range(TABLE_BITS):
        apart *= (64 - distance - k) / (64 - k)
    return 1 - (1 - apart) ** TABLES


class BKTree:
    """Fingerprints by Hamming distance; linked ones share a group."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.group = radius, [], [], []

    def near(self, value: int) -> list[int]:
        """Nodes within the radius of a value."""
        found, open_nodes, radius = [], [0] if self.values else [], self.radius
        while open_nodes:
            node = open_nodes.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            low, high = distance - radius, distance + radius
            open_nodes += [child for edge, child in self.children[node].items() if low <= edge <= high]
        return found

    def add(self, value: int) -> list[int]:
        """Insert a value; returns one node of every group it joins together."""
        joined = {}
        for node in self.near(value):
            joined.setdefault(self._root(node), node)
        new = len(self.values)
        if new:
            node = 0
            while True:
                below = self.children[node]
                edge = (self.values[node] ^ value).bit_count()
                if edge not in below:
                    below[edge] = new
                    break
                node = below[edge]
        self.values.append(value)
        self.children.append({})
        self.group.append(new)
        for root in joined:
            self.group[root] = new
        return list(joined.values())

    def _root(self, node: int) -> int:
        group = self.group
        while group[node] != node:
            group[node] = group[group[node]]
            node = group[node]
        return node


def _links(batches: Iterator, radius: int) -> Iterator:
    """Links of each shard; a partition has its shards one after the other."""
    import pyarrow as pa

    shard, tree, nodes = None, BKTree(radius), []
    for batch in batches:
        left, right = [], []
        names = ("table", "shard", "print", "node")
        for *key, value, node in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if key != shard:
                shard, tree, nodes = key, BKTree(radius), []
            for other in tree.add(value & 0xFFFFFFFFFFFFFFFF):
                left.append(nodes[other])
                right.append(node)
            nodes.append(node)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"]
        )


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, component_id) of every fingerprint of (doc_id, print, ...)."""
    distinct = store(prints.groupBy("print").agg(F.min("doc_id").alias("node")))
    masks = F.array(*(F.lit(mask - (mask >> 63 << 64)) for mask in shard_masks(radius)))
    sharded = distinct.where("node IS NOT NULL").select(
        F.posexplode(masks).alias("table", "mask"), "print", "node"
    ).select("table", F.col("print").bitwiseAND(F.col("mask")).alias("shard"), "print", "node")
    links = (
        sharded.repartition("table", "shard").sortWithinPartitions("table", "shard", "print", "node")
        .mapInArrow(lambda batches: _links(batches, radius), "a long, b long")
    )
    found = components(links)
    return distinct.join(found, "node", "left").select(
        "print", F.coalesce("component", "node").alias("component_id")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every document."""
    prints = store(fingerprints(docs, shingle))
    named = prints.join(classes(prints, radius), "print", "left")
    return named.select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """The documents without near-duplicates: the least id of each component stays.

    Rows without an id are kept; an id goes if all its rows are surplus.
    """
    prints = store(fingerprints(docs, shingle))
    judged = prints.join(classes(prints, radius), "print").where("doc_id IS NOT NULL")
    surplus = judged.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"))
    return docs.join(surplus.where("gone").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
