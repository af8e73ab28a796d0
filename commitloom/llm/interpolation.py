"""Operator 6: a bigram model by deleted interpolation, and the score of every text.

A token's probability mixes the maximum-likelihood estimates of its bigram and of
its unigram with an even share for every token; the weights depend on how often
the context was seen. Documents are dealt to learning, to setting weights and to
scoring by their id. The weights are learned by expectation-maximisation on the
counts of the second part, held out ("deleted") from the counts the estimates
come from; the final estimates use both.

Counts are looked up by shuffles alone. Documents are read in chunks, each a
bounded number of tokens kept as places in the chunk's sorted word hashes. A
chunk asks for each different word and word pair once; requests go to shards by
hash, so a word that every document uses is one request a chunk and no shard is
hot. A shard sums its chunks' counts and answers each in the order it was asked.
Words and pairs are told apart by 64-bit hashes.

Defined cases: a null or wordless text is its end token; a null id's number is
that of an empty text; repeated rows are counted and scored each; without
learning documents every estimate but the even share is 0; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import binary, free, store

FOLDS, SCORED, WEIGHING = 5, 1, 0
#: tokens of a chunk, but for the rest of its last document
CHUNK = 1_500_000
END = 1
#: context-frequency buckets (powers of two) and steps of the counts EM sees, in powers of two
BUCKETS, STEP, ROUNDS = 20, 0.25, 60
WORDS, PAIRS = 0, 1


def packed(keys) -> bytes:
    """Ascending 64-bit keys as differences, each in as few bytes as the widest needs."""
    import numpy as np

    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    planes = gaps.astype("<u8").view("u1").reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes()


def unpacked(data: bytes, count: int):
    import numpy as np

    keys = np.empty(count, "u8")
    if count:
        width = data[0]
        planes = np.zeros((count - 1, 8), "u1")
        planes[:, :width] = np.frombuffer(data, "u1", offset=9).reshape(count - 1, width)
        keys[0] = int.from_bytes(data[1:9], "little")
        keys[1:] = keys[0] + np.cumsum(planes.view("<u8")[:, 0], dtype="u8")
    return keys


def squeezed(values) -> bytes:
    """Whole numbers below 2**32 as compressed byte planes."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def token_hashes(text: bytes) -> list[int]:
    from xxhash import xxh64_intdigest

    return [*map(xxh64_intdigest, text.lower().split()), END]


def pair_keys(hashes):
    """A key for each token and the one before; an end comes before a text."""
    import numpy as np

    before = np.concatenate([np.array([END], "u8"), hashes[:-1]])
    keys = before * np.uint64(0x9E3779B97F4A7C15) + hashes * np.uint64(0xC2B2AE3D27D4EB4F)
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    return keys ^ (keys >> np.uint64(29))


CHUNKS = (
    "chunk long, part int, ids array<long>, sizes array<long>, n_words long, words binary, tokens binary"
)


def _chunks(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    open_chunks: dict[int, list] = {}
    held: dict[int, int] = {}

    def closed(part: int):
        nonlocal number
        ids, sizes, hashes = open_chunks.pop(part)
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        row = {
            "chunk": number, "part": part, "ids": ids, "sizes": sizes, "n_words": len(words),
            "words": packed(words), "tokens": squeezed(tokens),
        }
        number += 1
        return pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([
        ("chunk", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())), ("n_words", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()),
    ])
    for batch in batches:
        rows = zip(
            batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(),
            binary(batch.column("text")), strict=True,
        )
        for doc_id, part, text in rows:
            ids, sizes, hashes = open_chunks.setdefault(part, [[], [], []])
            found = token_hashes(text)
            ids.append(doc_id)
            sizes.append(len(found))
            hashes.append(np.array(found, "u8"))
            held[part] = held.get(part, 0) + len(found)
            if held[part] >= CHUNK:
                held[part] = 0
                yield closed(part)
    for part in sorted(open_chunks):
        yield closed(part)


REQUESTS = "shard int, chunk long, part int, kind int, n long, keys binary, counts binary"


def _asked(tokens, words):
    """Different words and pairs of a chunk with their counts and where tokens find them."""
    import numpy as np

    hashes = words[tokens]
    pairs, places, counts = np.unique(pair_keys(hashes), return_inverse=True, return_counts=True)
    return pairs, places, counts, np.bincount(tokens, minlength=len(words))


def _requests(batches: Iterator, shards: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([
        ("shard", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()),
        ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
    ])
    bounds = np.array([(s << 64) // shards for s in range(shards)], "u8")
    for batch in batches:
        for row in batch.to_pylist():
            words, tokens = unpacked(row["words"], row["n_words"]), expanded(row["tokens"])
            pairs, _, pair_counts, word_counts = _asked(tokens, words)
            out = []
            for kind, keys, counts in ((WORDS, words, word_counts), (PAIRS, pairs, pair_counts)):
                cuts = [*np.searchsorted(keys, bounds), len(keys)]
                for shard in range(shards):
                    low, high = cuts[shard], cuts[shard + 1]
                    if low < high:
                        out.append({
                            "shard": shard, "chunk": row["chunk"], "part": row["part"], "kind": kind,
                            "n": high - low, "keys": packed(keys[low:high]), "counts": squeezed(counts[low:high]),
                        })
            yield pa.RecordBatch.from_pylist(out, schema)


ANSWERS = "chunk long, part int, kind int, shard int, totals binary, held binary, known long, size long, held_size long"


def _answers(batches: Iterator) -> Iterator:
    """Totals of each shard; `known`, `size`, `held_size`: its words, tokens and held-out tokens."""
    import pyarrow as pa

    schema = pa.schema([
        ("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()),
        ("totals", pa.binary()), ("held", pa.binary()), ("known", pa.int64()), ("size", pa.int64()),
        ("held_size", pa.int64()),
    ])
    group, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["shard"], row["kind"]) != group:
                if rows:
                    yield from (pa.RecordBatch.from_pylist([r], schema) for r in _answer(rows))
                group, rows = (row["shard"], row["kind"]), []
            rows.append(row)
    if rows:
        yield from (pa.RecordBatch.from_pylist([r], schema) for r in _answer(rows))


def _answer(rows: list[dict]) -> Iterator[dict]:
    import numpy as np

    keys, places = np.unique(np.concatenate([unpacked(r["keys"], r["n"]) for r in rows]), return_inverse=True)
    counts = [expanded(r["counts"]) for r in rows]
    learned = np.concatenate([c * (r["part"] != SCORED) for r, c in zip(rows, counts, strict=True)])
    deleted = np.concatenate([c * (r["part"] == WEIGHING) for r, c in zip(rows, counts, strict=True)])
    totals = np.bincount(places, learned, len(keys)).astype("i8")
    held = np.bincount(places, deleted, len(keys)).astype("i8")
    kind, shard = rows[0]["kind"], rows[0]["shard"]
    if kind == WORDS:
        yield {
            "chunk": None, "part": None, "kind": kind, "shard": shard, "totals": None, "held": None,
            "known": int((totals > 0).sum()), "size": int(totals.sum()), "held_size": int(held.sum()),
        }
    at = 0
    for row in rows:
        own = places[at : at + row["n"]]
        at += row["n"]
        yield {
            "chunk": row["chunk"], "part": row["part"], "kind": kind, "shard": shard,
            "totals": _numbers(totals[own]), "held": _numbers(held[own]) if row["part"] == WEIGHING else None,
            "known": None, "size": None, "held_size": None,
        }


def _numbers(values) -> bytes:
    """Counts of any size, compressed."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(values.astype("<i8").view("u1").reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _as_numbers(parts: list[bytes]):
    import numpy as np
    import zstandard

    out = []
    for data in parts:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(8, -1)
        out.append(np.ascontiguousarray(planes.T).view("<i8")[:, 0])
    return np.concatenate(out)


class Resolved:
    """A chunk with the corpus counts of its words and pairs."""

    def __init__(self, row: dict, held: bool):
        import numpy as np

        words, tokens = unpacked(row["words"], row["n_words"]), expanded(row["tokens"])
        pairs, places, self.counts, _ = _asked(tokens, words)
        answers = sorted(row["answers"], key=lambda a: (a["kind"], a["shard"]))

        def column(kind: int, name: str):
            return _as_numbers([a[name] for a in answers if a["kind"] == kind])

        word_totals, pair_totals = column(WORDS, "totals"), column(PAIRS, "totals")
        if len(word_totals) != len(words) or len(pair_totals) != len(pairs):
            raise RuntimeError("a chunk's answers do not match its requests")
        if held:
            word_totals = word_totals - column(WORDS, "held")
            pair_totals = pair_totals - column(PAIRS, "held")
        end = int(np.searchsorted(words, END))
        before = np.concatenate([[end], tokens[:-1]])
        if held:  # one row a different pair
            first = np.empty(len(pairs), "i8")
            first[places[::-1]] = np.arange(len(places))[::-1]
            tokens, before, self.pair = tokens[first], before[first], pair_totals
        else:
            self.pair = pair_totals[places]
        self.word, self.context = word_totals[tokens], word_totals[before]


def buckets(context):
    """The bucket of a context's count."""
    import numpy as np

    return np.minimum(np.frexp(context.astype("f8"))[1], BUCKETS - 1)


def estimates(pair, word, context, size: int):
    import numpy as np

    bigram = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
    return bigram, word / max(size, 1)


def _cells(batches: Iterator, size: int) -> Iterator:
    """Held-out tokens by context bucket and by steps of both estimates."""
    import numpy as np
    import pyarrow as pa

    names = ["bucket", "x", "y", "n", "bigram", "unigram"]
    for batch in batches:
        for row in batch.to_pylist():
            found = Resolved(row, held=True)
            bigram, unigram = estimates(found.pair, found.word, found.context, size)

            def steps(p):
                return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-18)) / STEP), 1).astype("i4")

            key = np.stack([buckets(found.context), steps(bigram), steps(unigram)])
            cells, place = np.unique(key, axis=1, return_inverse=True)
            place = place.ravel()
            sums = [np.bincount(place, found.counts * v) for v in (np.ones(len(bigram)), bigram, unigram)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype("i4")) for c in cells), *map(pa.array, sums)], names)


def learned_weights(cells: list, even: float):
    """Weights (bucket, estimate) of bigram, unigram and even share, by expectation-maximisation.

    `cells` are (bucket, n, mean bigram, mean unigram). A bucket without held-out
    tokens takes the weights of all.
    """
    import numpy as np

    def fit(rows) -> np.ndarray:
        weights = np.array([0.5, 0.3, 0.2])
        if not len(rows):
            return weights
        n, p = rows[:, 0], np.column_stack([rows[:, 1], rows[:, 2], np.full(len(rows), even)])
        for _ in range(ROUNDS):
            shares = weights * p
            shares *= (n / shares.sum(axis=1))[:, None]
            weights = np.maximum(shares.sum(axis=0) / n.sum(), 1e-9)
            weights /= weights.sum()
        return weights

    rows = np.array([[n, x, y] for _, n, x, y in cells]).reshape(-1, 3)
    own = np.array([b for b, *_ in cells])
    every = fit(rows)
    return np.array([fit(rows[own == b]) if (own == b).any() else every for b in range(BUCKETS)])


def _scores(batches: Iterator, known: int, size: int, weights) -> Iterator:
    import numpy as np
    import pyarrow as pa

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for batch in batches:
        for row in batch.to_pylist():
            found = Resolved(row, held=False)
            bigram, unigram = estimates(found.pair, found.word, found.context, size)
            w = weights[buckets(found.context)]
            mixed = np.log10(w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2] / (known + 1))
            base = np.log10((found.word + 0.5) / (size + 0.5 * (known + 1)))
            starts = np.concatenate([[0], np.cumsum(row["sizes"])[:-1]])
            sums = [np.add.reduceat(v, starts) for v in ((found.word > 0).astype("i8"), base, mixed)]
            full = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(np.full(full, row["part"] == SCORED)),
                 pa.array(row["sizes"], pa.int64()), pa.array(sums[0]), pa.array(np.full(full, size)),
                 pa.array(sums[1]), pa.array(sums[2])], names,
            )


def fold(column: str = "doc_id") -> Column:
    """The part a document belongs to, by its id's checksum."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)).cast("int")


def score_texts(docs: DataFrame) -> DataFrame:
    """Each document's tokens, known tokens, smoothed unigram score and model score."""
    spark = docs.sparkSession
    part = F.when(fold() == SCORED, SCORED).when(fold() == WEIGHING, WEIGHING).otherwise(2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), "text")
    chunks = store(rows.mapInArrow(_chunks, CHUNKS))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    requests = chunks.mapInArrow(lambda batches: _requests(batches, shards), REQUESTS)
    answers = store(
        requests.repartition("shard").sortWithinPartitions("shard", "kind", "chunk").mapInArrow(_answers, ANSWERS)
    )
    free(spark)
    counts = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("known", "size", "held_size"))).first()
    known, size, held = counts
    answered = answers.where("chunk IS NOT NULL").groupBy("chunk").agg(
        F.collect_list(F.struct("kind", "shard", "totals", "held")).alias("answers")
    )
    deleted = answers.where(f"part = {WEIGHING}").groupBy("chunk").agg(
        F.collect_list(F.struct("kind", "shard", "totals", "held")).alias("answers")
    )
    cells = chunks.where(f"part = {WEIGHING}").join(deleted, "chunk").mapInArrow(
        lambda batches: _cells(batches, size - held),
        "bucket int, x int, y int, n double, bigram double, unigram double",
    ).groupBy("bucket", "x", "y").agg(F.sum("n").alias("n"), F.sum("bigram").alias("p"), F.sum("unigram").alias("q"))
    listed = [(r.bucket, r.n, r.p / r.n, r.q / r.n) for r in cells.orderBy("bucket", "x", "y").collect()]
    weights = learned_weights(listed, 1 / (known + 1))
    return chunks.join(answered, "chunk").mapInArrow(
        lambda batches: _scores(batches, known, size, weights),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
