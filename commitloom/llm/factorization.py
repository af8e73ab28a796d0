"""Operator 8: a quality score by a factorisation machine.

A text becomes hashed words, structure statistics and its length; a statistic is
a one-hot bin among the learning rows' quantiles. The score is a sigmoid of
bias, linear weights and all pairwise interactions of low rank, which the
sum-of-squares identity gives in time linear in the features present.

The machine learns on the driver from at most `SAMPLE` labelled documents, the
first by a hash of their id; their features are made by tasks. Scoring reads
every text whole; the learned parameters it sends to tasks have a fixed size.

Defined cases: a null text is empty and has a score; labels without a quality or
a document are not used, of a document's repeated labels the least counts; with
no learning rows, or one class alone, the score is the share of that class,
smoothed; repeated documents are scored each; an empty table gives an empty one;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import binary, received, send, release

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: most labelled documents learned from
SAMPLE = 12_000
#: hashed words, bins of a statistic, rank of the interactions
WORDS, BINS, RANK = 4096, 10, 8
STEPS, ROWS, RATE, SHRINK = 1200, 128, 0.05, 1e-5


class WordPlaces(dict):
    """Places of hashed words; forgets them all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh32_intdigest

        if len(self) > 500_000:
            self.clear()
        place = self[word] = xxh32_intdigest(word) % WORDS
        return place


STATISTICS = (
    "upper", "digit", "mark", "space", "wide", "line_break", "bar", "length", "word_length", "words_per_line",
    "different_words", "different_lines", "marked_words", "short_words", "common_mark",
)


def statistics(text: bytes, words: list[bytes]):
    """Structure statistics of a text, all 0 for an empty one."""
    import numpy as np

    if not text:
        return np.zeros(len(STATISTICS))
    counts = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    size, n = len(text), max(1, len(words))
    marks = np.concatenate([counts[33:48], counts[58:65], counts[91:97], counts[123:127]])
    lines = [line for line in text.split(b"\n") if line]
    ends = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return np.array([
        counts[65:91].sum() / size, counts[48:58].sum() / size, marks.sum() / size, counts[32] / size,
        counts[128:].sum() / size, counts[10] / size, counts[124] / size, np.log1p(size),
        sum(map(len, words)) / n, n / max(1, len(lines)), len(set(words)) / n,
        len(set(lines)) / max(1, len(lines)), ends / n, sum(len(w) <= 2 for w in words) / n,
        np.delete(marks, [11, 13]).max() / size,
    ])


def features(text: bytes, places: WordPlaces):
    """Hashed words (places, damped and normalised counts) and the statistics."""
    import numpy as np

    words = text.split()
    found = np.bincount(np.fromiter(map(places.__getitem__, text.lower().split()), "i8"), minlength=1)
    at = np.flatnonzero(found)
    values = np.log1p(found[at])
    return at, values / max(1e-9, np.sqrt((values**2).sum())), statistics(text, words)


@dataclass
class Machine:
    """Bias, linear weights and factors; the statistics' bin edges; how many rows it learned from."""

    bias: float
    linear: object
    factors: object
    edges: object

    def rows(self, at, values, stats):
        """All features of a row: places and values."""
        import numpy as np

        bins = [WORDS + k * BINS + np.searchsorted(e, s, "right") for k, (e, s) in enumerate(zip(self.edges, stats, strict=True))]
        return np.concatenate([at, np.array(bins, "i8")]), np.concatenate([values, np.full(len(bins), 0.5)])

    def score(self, at, values, stats) -> float:
        import numpy as np

        at, values = self.rows(at, values, stats)
        vx = self.factors[at] * values[:, None]
        pairs = 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum())
        margin = self.bias + self.linear[at] @ values + pairs
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def learn(rows: list[tuple], labels: list[int]) -> Machine:
    """Fit by adaptive gradient steps on the logistic loss; rows are (places, values, statistics)."""
    import numpy as np

    size = WORDS + len(STATISTICS) * BINS
    rng = np.random.default_rng(8)
    y = np.array(labels, "f8")
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.zeros(BINS - 1)] * len(STATISTICS)
    if len(y):
        stats = np.array([s for _, _, s in rows])
        edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in stats.T]
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, RANK)), edges)
    if not len(y) or y.min() == y.max():
        return machine
    machine.factors = rng.normal(0, 0.02, (size, RANK))
    full = [machine.rows(*row) for row in rows]
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-8), np.full((size, RANK), 1e-8), 1e-8
    rounds = -(-STEPS * ROWS // len(y))
    for _ in range(min(rounds, STEPS)):
        order = rng.permutation(len(y))
        for start in range(0, len(y), ROWS):
            some = order[start : start + ROWS]
            at = np.concatenate([full[i][0] for i in some])
            x = np.concatenate([full[i][1] for i in some])
            sizes = np.array([len(full[i][0]) for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = machine.factors[at] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
            margin = machine.bias + np.add.reduceat(machine.linear[at] * x, starts) + pairs
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]
            each = np.repeat(error, sizes) / len(some)
            slope = each * x
            used, place = np.unique(at, return_inverse=True)
            g = np.bincount(place, slope) + SHRINK * machine.linear[used]
            by_factor = slope[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            h = np.stack([np.bincount(place, by_factor[:, f]) for f in range(RANK)], axis=1)
            h += SHRINK * machine.factors[used]
            seen_linear[used] += g**2
            seen_factors[used] += h**2
            seen_bias += error.mean() ** 2
            machine.linear[used] -= RATE * g / np.sqrt(seen_linear[used])
            machine.factors[used] -= RATE * h / np.sqrt(seen_factors[used])
            machine.bias -= RATE * error.mean() / np.sqrt(seen_bias)
    return machine


def fold(column: str = "doc_id") -> Column:
    """The part a document belongs to, by its id's checksum."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learn from at most `sample` labelled documents outside the held-out part."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold() != HELD_OUT)
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # at most `sample` pairs of numbers
    texts = rows.join(F.broadcast(chosen), "doc_id")
    made = texts.mapInArrow(_features, "doc_id long, quality int, places binary, counts binary, stats binary")
    import numpy as np

    found = sorted(made.collect(), key=lambda r: (r.doc_id, r.places, r.quality))[:sample]
    listed = [
        (np.frombuffer(r.places, "i4"), np.frombuffer(r.counts, "f4"), np.frombuffer(r.stats, "f8")) for r in found
    ]
    machine = learn(listed, [int(r.quality > 0) for r in found])
    # the driver goes on to other stages; what training took would stay with its process
    del found, listed
    release()
    return machine


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    places = WordPlaces()
    names = ["doc_id", "quality", "places", "counts", "stats"]
    for batch in batches:
        made = [features(text, places) for text in binary(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality").cast(pa.int32()),
             *(pa.array([column.astype(kind).tobytes() for column in columns], pa.binary())
               for kind, columns in zip(("i4", "f4", "f8"), zip(*made, strict=True), strict=True))], names,
        )


def scored(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """`row`, the whole document, and its score."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = rows.withColumn("score", F.lit(0.0)).schema
    sent = send(docs.sparkSession, machine)

    def batch_scores(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places, learned = WordPlaces(), received(sent)
        for batch in batches:
            column = batch.column("row").field(text)
            scores = [learned.score(*features(t, places)) for t in binary(column)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    return rows.mapInArrow(batch_scores, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    texts = docs.select("doc_id", "text")
    found = scored(texts, train(texts, labels))
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (fold("row.doc_id") == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the machine does not reject."""
    machine = train(docs.select("doc_id", "text"), labels)
    kept = scored(docs, machine).where(F.col("score") >= THRESHOLD)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
