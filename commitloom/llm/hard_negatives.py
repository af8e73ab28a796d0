"""Operator 12: hard negatives of anchor vectors, searched under angular bounds.

Every vector of whole numbers keeps its norm and its angles to a few reference
directions. By the triangle inequality on the sphere the angle between two vectors
lies between the difference and the sum of their angles to any direction, so the
cosine, and times the norms the inner product, lies in a known interval, which is
widened by more than floating-point rounding can take from it. Only vectors whose
interval overlaps the window of scores asked for are scored, in whole numbers.

Rows go to cells by their nearest direction, cells are split into groups of bounded
size. An anchor is first held against one group of its own cell; the scores found
there narrow its windows. It is then sent to the groups of all cells whose interval
(from the cell's least and greatest angles) overlaps a window that is left; anchors
are salted so that no group gets more than `ASKED` of them at once. In a group,
anchors stream past the group's rows. Positives are searched without a window, their
scores make the windows of the negatives.

Defined cases: rows without an id, label or vector, or with a component that is null
or not finite, take no part; of the rows under one id the least by label and
components stands for it; vectors of different lengths are compared as if the
shorter ones ended in zeros; a zero vector scores 0 with all; an anchor without
positives, or a positive without negatives, gives no row; an empty table gives an
empty one; other columns are ignored, whatever their names. Scores are exact at any
size; those beyond a long are written as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom.llm.common import received, send, store

#: a component x becomes floor(SCALE * x)
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: a negative's score lies between these hundredths of the positive's
LOW, HIGH = 50, 95
#: rows from whose vectors the reference directions are chosen, and their number
SAMPLE, DIRECTIONS = 2_000, 12
#: rows of a group, and anchors that meet a group at once
GROUP, ASKED = 1 << 15, 1 << 15
#: anchors scored together
TOGETHER = 64
#: radians and share by which an interval is wider than computed
ANGLE_SLACK, SHARE_SLACK = 1e-6, 1e-9
#: products of norms below which double precision holds every partial sum exactly
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1

ROWS = "vec_id long, label int, vector array<double>, norm double, angles array<double>, cell int"
WINDOWS = "windows array<struct<slot:long,low:long,high:long,floor:long>>"
FOUND = "anchor_id long, slot long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """Components as whole numbers, in double precision, which holds them exactly."""
    return F.transform(vector, lambda x: _floor(x.cast("double") * SCALE))


def _floor(x: Column) -> Column:
    """The greatest whole number not above a double, as a double of any size."""
    large = F.abs(x) >= float(1 << 53)  # such a double is whole already
    return F.when(large, x).otherwise(F.floor(x).cast("double"))


def usable(rows: DataFrame, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, vector): one row an id, with whole components."""
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    taken = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col(vector).alias("vector")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite)
    whole = taken.select("vec_id", "label", quantised(F.col("vector")).alias("vector"))
    least = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return least.select("vec_id", "row.label", "row.vector")


def padded(vectors: list, width: int):
    """Vectors as the rows of a matrix, short ones ended in zeros."""
    import numpy as np

    made = np.zeros((len(vectors), width))
    for k, vector in enumerate(vectors):
        made[k, : len(vector)] = vector
    return made


def unit(matrix):
    """Rows at length one (zero rows stay), and their norms; large components do not overflow."""
    import numpy as np

    top = np.abs(matrix).max(axis=1, initial=0.0)
    small = matrix / np.where(top > 0, top, 1)[:, None]
    size = np.sqrt((small * small).sum(axis=1))
    return small / np.where(size > 0, size, 1)[:, None], top * size


def angles(units, directions):
    """Angles of unit vectors to the directions; a zero vector is at a right angle to all."""
    import numpy as np

    width = max(units.shape[1], directions.shape[1])
    wide = [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (units, directions)]
    return np.arccos(np.clip(wide[0] @ wide[1].T, -1, 1))


def choose_directions(rows: DataFrame, sample: int = SAMPLE, count: int = DIRECTIONS):
    """Directions far from each other among the first `sample` rows by a hash of the id.

    They only decide how tight the intervals are, never what is found.
    """
    import numpy as np

    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()
    if not some:
        return np.zeros((1, 1))
    units, norms = unit(padded([r.vector for r in some], max(1, max(len(r.vector) for r in some))))
    units = units[norms > 0]
    if not len(units):
        return np.eye(1)
    chosen = [units[0]]
    nearest = units @ chosen[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(units[int(nearest.argmin())])
        nearest = np.maximum(nearest, units @ chosen[-1])
    return np.array(chosen)


def _placed(batches: Iterator, directions) -> Iterator:
    """Norm, angles and cell of each row."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        vectors = [np.array(v) for v in batch.column("vector").to_pylist()]
        if not vectors:
            continue
        units, norms = unit(padded(vectors, max(1, max(map(len, vectors)))))
        found = angles(units, directions)
        flat = pa.array(found.ravel())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("vec_id", "label", "vector")), pa.array(norms),
             pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), flat),
             pa.array(found.argmin(axis=1), pa.int32())],
            [c.split()[0] for c in ROWS.split(", ")],
        )


def bounds(angles_a, norms_a, low_b, high_b, least_b, most_b):
    """(least, greatest) scores of vectors a with vectors or cells b.

    `low_b` and `high_b` are the angles of b (the same for a vector), `least_b` and
    `most_b` its norms. Arrays are (a, directions) and (b, directions).
    """
    import numpy as np

    apart = np.zeros((len(angles_a), len(low_b)))
    around = np.full(apart.shape, np.pi)
    for k in range(angles_a.shape[1]):
        own = angles_a[:, k, None]
        np.maximum(apart, own - high_b[None, :, k], out=apart)
        np.maximum(apart, low_b[None, :, k] - own, out=apart)
        np.minimum(around, own + high_b[None, :, k], out=around)
    top = np.cos(np.maximum(apart - ANGLE_SLACK, 0))
    bottom = np.cos(np.minimum(around + ANGLE_SLACK, np.pi))
    # a cosine below zero is the greater score for the shorter vector, and the other way round
    greatest = top * np.where(top > 0, most_b, least_b) * norms_a[:, None]
    least = bottom * np.where(bottom > 0, least_b, most_b) * norms_a[:, None]
    room = SHARE_SLACK * norms_a[:, None] * most_b + 1
    return least - room, greatest + room


def scores(matrix, vectors, exact: bool):
    """Inner products of whole vectors, (vectors, rows); Python's whole numbers where doubles would round."""
    import numpy as np

    if exact:
        return (vectors @ matrix.T).astype("i8")
    rows, asked = ([[int(x) for x in v] for v in m.tolist()] for m in (matrix, vectors))
    made = np.empty((len(asked), len(rows)), object)
    for i, a in enumerate(asked):
        for j, b in enumerate(rows):
            made[i, j] = min(max(sum(x * y for x, y in zip(a, b, strict=True)), LEAST), MOST)
    return made


class Group:
    """Rows of one group, ready to be asked."""

    def __init__(self, ids, labels, vectors, norms, angles):
        import numpy as np

        order = np.argsort(ids, kind="stable")  # ties of a score go to the smaller id
        self.ids, self.labels, self.norms = ids[order], labels[order], norms[order]
        self.matrix = padded([vectors[k] for k in order.tolist()], max(1, max(map(len, vectors))))
        self.angles = angles[order]

    def best(self, anchor_ids, labels, vectors, norms, angles, windows, same: bool, top: int) -> Iterator[tuple]:
        """(anchor, slot, id, score): the first `top` rows of every window of some anchors."""
        import numpy as np

        low, high = bounds(angles, norms, self.angles, self.angles, self.norms, self.norms)
        asked = np.array([min(max(w["low"], w["floor"]) for w in own) for own in windows], float)
        most = np.array([max(w["high"] for w in own) for own in windows], float)
        maybe = (high >= asked[:, None] - 1 - np.abs(asked[:, None]) * SHARE_SLACK) & (
            low <= most[:, None] + 1 + np.abs(most[:, None]) * SHARE_SLACK
        )
        maybe &= (self.labels[None] == labels[:, None]) == same
        if same:
            maybe &= self.ids[None] != anchor_ids[:, None]
        rows = np.flatnonzero(maybe.any(axis=0))
        if not len(rows):
            return
        width = max(self.matrix.shape[1], max(map(len, vectors)))
        own = padded(vectors, width)
        matrix = self.matrix[rows]
        if matrix.shape[1] < width:
            matrix = np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))
        exact = norms.max() * self.norms[rows].max() < EXACT
        found = scores(matrix, own, exact)
        for k, anchor in enumerate(anchor_ids.tolist()):
            at = np.flatnonzero(maybe[k, rows])
            some = found[k, at]
            for window in windows[k]:
                inside = np.flatnonzero((some >= max(window["low"], window["floor"])) & (some <= window["high"]))
                if len(inside) > top and exact:
                    # the limit of the first `top`, whatever ties with it
                    limit = np.partition(some[inside], len(inside) - top)[len(inside) - top]
                    inside = inside[some[inside] >= limit]
                first = sorted(inside.tolist(), key=lambda x: (-some[x], x))[:top]
                for x in first:
                    yield anchor, window["slot"], int(self.ids[rows[at[x]]]), int(some[x])


def _searched(batches: Iterator, same: bool, top: int) -> Iterator:
    """A group's rows come first, then the anchors that ask it; groups come one after the other."""
    import numpy as np
    import pyarrow as pa

    names = ("cell", "part", "salt", "vec_id", "label", "vector", "norm", "angles", "windows")
    key, rows, group, held = None, [], None, []

    def ask() -> Iterator:
        nonlocal group, held
        if rows and group is None:
            group = Group(*_columns(rows))
        if group is not None and held:
            ids, labels, vectors, norms, own = _columns([h[:5] for h in held])
            found = list(group.best(ids, labels, vectors, norms, own, [h[5] for h in held], same, top))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found, strict=True)], [c.split()[0] for c in FOUND.split(", ")]
                )
        held = []

    def _columns(some):
        ids, labels, vectors, norms, own = zip(*some, strict=True)
        return np.array(ids), np.array(labels), list(vectors), np.array(norms), np.array(own)

    for batch in batches:
        for *its, vec_id, label, vector, norm, own, windows in zip(
            *(batch.column(n).to_pylist() for n in names), strict=True
        ):
            if its != key:
                yield from ask()
                key, rows, group = its, [], None
            if windows is None:
                rows.append((vec_id, label, vector, norm, own))
            else:
                held.append((vec_id, label, vector, norm, own, windows))
                if len(held) == TOGETHER:
                    yield from ask()
    yield from ask()


def search(rows: DataFrame, asking: DataFrame, salts: int, same: bool, top: int) -> DataFrame:
    """What each group finds for the anchors that ask it.

    `rows` have `cell` and `part`; `asking` has the groups (cell, part) an anchor asks and
    its `windows`. Every salt of a group is a task's own copy of its rows.
    """
    columns = ["cell", "part", "salt", "vec_id", "label", "vector", "norm", "angles"]
    none = F.lit(None).cast(WINDOWS.split(" ", 1)[1])
    copied = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        *columns, none.alias("windows")
    )
    salted = asking.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).select(*columns, "windows")
    return (
        copied.unionByName(salted)
        .repartition("cell", "part", "salt")
        .sortWithinPartitions("cell", "part", "salt", F.col("windows").isNotNull())
        .mapInArrow(lambda batches: _searched(batches, same, top), FOUND)
    )


def _asking(batches: Iterator, cells: Broadcast) -> Iterator:
    """The cells an anchor asks beside its own group: those whose interval overlaps a window."""
    import numpy as np
    import pyarrow as pa

    number, low_b, high_b, least_b, most_b = received(cells)
    for batch in batches:
        if not batch.num_rows:
            continue
        windows = batch.column("windows").to_pylist()
        own, norms = np.array(batch.column("angles").to_pylist()), np.array(batch.column("norm"))
        low, high = bounds(own, norms, low_b, high_b, least_b, most_b)
        asked = np.array([min(max(w["low"], w["floor"]) for w in some) for some in windows], float)
        most = np.array([max(w["high"] for w in some) for some in windows], float)
        overlap = (high >= asked[:, None] - 1 - np.abs(asked[:, None]) * SHARE_SLACK) & (
            low <= most[:, None] + 1 + np.abs(most[:, None]) * SHARE_SLACK
        )
        found = [number[x].tolist() for x in overlap]
        columns = {n: batch.column(n) for n in batch.schema.names}
        yield pa.RecordBatch.from_pydict({**columns, "cells": pa.array(found, pa.list_(pa.int32()))})


class Index:
    """Placed rows in groups, and what is known of their cells; the cells are as few as the directions."""

    def __init__(self, rows: DataFrame, group: int = GROUP, asked: int = ASKED):
        self.spark, self.asked = rows.sparkSession, asked
        directions = choose_directions(rows)
        placed = store(rows.mapInArrow(lambda batches: _placed(batches, directions), ROWS))
        self.width, width = len(directions), range(len(directions))
        cells = placed.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"),
            F.array(*(F.min(F.col("angles")[k]) for k in width)).alias("low"),
            F.array(*(F.max(F.col("angles")[k]) for k in width)).alias("high"),
        ).orderBy("cell").collect()
        self.cells = cells
        self.parts = {r.cell: -(-r.n // group) for r in cells}
        splits = F.create_map(*(F.lit(x) for pair in self.parts.items() for x in pair)) if cells else None
        self.splits = (lambda cell: F.element_at(splits, cell)) if cells else (lambda cell: F.lit(1))
        self.rows = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), self.splits(F.col("cell"))).cast("int"))

    def best(self, anchors: DataFrame, same: bool, top: int) -> DataFrame:
        """(anchor_id, slot, vec_id, score, rank) of anchors (rows with `windows`)."""
        import numpy as np

        salts = max(1, -(-anchors.count() // self.asked))
        first = store(search(self.rows, anchors, salts, same, top))
        # a window's last score among those found in the own group is a floor if there are enough
        floors = _first(first, top).groupBy("anchor_id", "slot").agg(
            F.when(F.count("*") == top, F.min("score")).alias("floor")
        ).where("floor IS NOT NULL")
        known = floors.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))
        narrowed = anchors.join(known.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left").withColumn(
            "windows", F.transform("windows", lambda w: F.struct(
                w["slot"].alias("slot"), w["low"].alias("low"), w["high"].alias("high"),
                F.greatest(w["floor"], F.coalesce(F.element_at("floors", w["slot"]), w["floor"])).alias("floor"),
            )),
        ).drop("floors")
        cells = send(self.spark, (
            np.array([r.cell for r in self.cells]), np.array([r.low for r in self.cells]).reshape(-1, self.width),
            np.array([r.high for r in self.cells]).reshape(-1, self.width),
            np.array([r.least for r in self.cells]), np.array([r.most for r in self.cells]),
        ))
        names = ["vec_id", "label", "vector", "norm", "angles", "cell", "part", "windows"]
        told = narrowed.select(*names).mapInArrow(
            lambda batches: _asking(batches, cells), f"{ROWS}, part int, {WINDOWS}, cells array<int>"
        )
        each = told.select(
            "vec_id", "label", "vector", "norm", "angles", "windows", F.col("cell").alias("home"),
            F.col("part").alias("home_part"), F.explode("cells").alias("cell"),
        ).withColumn("part", F.explode(F.sequence(F.lit(0), self.splits(F.col("cell")) - 1)))
        others = each.where("cell <> home OR part <> home_part").drop("home", "home_part")
        return _first(first.unionByName(search(self.rows, others, salts, same, top)), top)


def _first(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(
    rows: DataFrame, vector: str, label: Column, is_anchor: Column, group: int = GROUP, asked: int = ASKED
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores of the rows (vec_id, a vector, ...)."""
    index = Index(store(usable(rows, vector, label)), group, asked)

    def window(slot: Column, low: Column, high: Column) -> Column:
        whole = [c.cast("long") for c in (slot, low, high, low)]
        return F.struct(*(c.alias(n) for c, n in zip(whole, ("slot", "low", "high", "floor"), strict=True)))

    anchors = index.rows.where(is_anchor)
    everything = F.array(window(F.lit(0), F.lit(LEAST), F.lit(MOST)))
    positives = store(index.best(anchors.withColumn("windows", everything), True, POSITIVES).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    score = F.col("positive_score").cast("decimal(38,0)")
    # whole numbers n with LOW * score <= 100 * n <= HIGH * score
    low, high = F.ceil(score * LOW / 100), F.floor(score * HIGH / 100)
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(window(F.col("positive_id"), low, high)).alias("windows")
    )
    negatives = index.best(anchors.join(windows, "vec_id"), False, NEGATIVES)
    return negatives.select(
        "anchor_id", F.col("slot").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    ).join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
