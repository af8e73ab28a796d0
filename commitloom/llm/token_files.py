"""Operator 1: token ids as Parquet lists, written in document order and read selectively.

`write_tokens` encodes whole texts after one range shuffle and writes one row a
document, ascending by id: ids as a dictionary-encoded integer list, document
ids and counts as delta-encoded integers, small row groups and pages with page
indexes, metadata in a struct of its own. `read_tokens` adds each document's
place in the whole token stream; a reader that selects documents or columns
touches only their pages.

Defined cases: a null text is empty and holds the end id only; a null document
id sorts first; repeated rows and repeated ids are all kept, equal ids ordered
by their text's hash; an empty table gives an empty one; other columns go to
`meta` if asked for and are ignored otherwise, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitloom.llm.common import binary, text_or_empty
from commitloom.llm.word_encoder import word_encoder

#: Parquet settings of the files; the ids' dictionary holds a whole vocabulary
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#file_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, metadata: Iterable[str] = ()
) -> None:
    """Encode `text` of every row and write the token files to `path`."""
    meta = [F.col(name) for name in metadata]
    rows = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_or_empty().alias("text"),
            F.xxhash64("text").alias("tie"),
            *([F.struct(*meta).alias("meta")] if meta else []),
        )
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    kept = ", meta " + rows.schema["meta"].dataType.simpleString() if meta else ""
    rows.mapInArrow(
        lambda batches: _encode(batches, tokenizer, end_id),
        f"doc_id long, file long, file_start long, n_tokens long, ids array<int>{kept}",
    ).write.options(**FILE_OPTIONS).parquet(path)


def _encode(batches: Iterator, tokenizer: str, end_id: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    encoder, file, start = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = [b"".join(encoder.words(t)[1]) + end for t in binary(batch.column("text"))]
        counts = np.array([len(t) // 4 for t in texts], "i8")
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(texts), "<i4"))
        )
        columns = {
            "doc_id": batch.column("doc_id"),
            "file": pa.array(np.full(len(texts), file)),
            "file_start": pa.array(start + offsets[:-1]),
            "n_tokens": pa.array(counts),
            "ids": ids,
        }
        if "meta" in batch.schema.names:
            columns["meta"] = batch.column("meta")
        start += int(offsets[-1])
        yield pa.RecordBatch.from_pydict(columns)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with `start`, the number of ids of all documents before.

    Only the counts are read to place the files: one row a file, the bound of
    what is broadcast.
    """
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(places), "file")
    return placed.withColumn("start", F.col("base") + F.col("file_start")).drop("base")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC of the ids, from rows of `read_tokens`."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _checksums(batches: Iterator) -> Iterator:
    import zlib

    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids")
        data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
        ends = (ids.offsets.to_numpy() * 4).tolist()
        sums = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )
