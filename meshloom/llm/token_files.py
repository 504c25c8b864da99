"""Token ids in Parquet files that can be read selectively.

A document is a row: doc_id, part, row_start, n_tokens and a list of ids. The list is dictionary-encoded (its distinct ids
fit the dictionary page, so an id takes as many bits as the vocabulary needs); the sorted numbers are delta-encoded. Row groups and
pages are kept small and the writer adds page indexes, so that a reader of a few documents, or of the counts alone, reads
little. File k holds the k-th range of doc_ids, sorted; a document's start is its place in the part plus the tokens of the
parts before, so no global sort position is ever computed in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read_table
from .tokens import encoder, vocabulary_size

FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}


def _encoded(tokenizer: str, end_id: int, bounds: list[int], kind: str):
    edges, end = np.array(bounds, np.int64), np.array([end_id], kind).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found, places = model.column(batch.column(1))
                raw, places = found.astype(kind).tobytes(), (found.astype(kind).itemsize * places).tolist()
                ids = [raw[a:b] + end for a, b in zip(places, places[1:], strict=False)]
                part = [0 if x is None else int(np.searchsorted(edges, x, "right")) for x in batch.column(0).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(part, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "part", "packed"])

    return rows


def _placed(kind: str):
    """From rows sorted by part and doc_id: each one's place in its part, and its ids as a list."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                starts, lists = [], [np.zeros(0, kind)]
                for part, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if part != now:
                        now, total = part, 0
                    lists.append(np.frombuffer(packed, kind))
                    starts.append(total)
                    total += len(lists[-1])
                counts = list(map(len, lists[1:]))
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                values = pa.array(np.concatenate(lists).astype(np.int32))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "part", "row_start", "n_tokens", "ids"])

    return rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all rows to `path`, in ascending order of doc_id.

    A null text has the end id alone. A null doc_id comes first. Rows with one doc_id are ordered by their ids. Other
    columns are ignored. An empty table writes files without rows."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(map(int, texts.select("doc_id").na.drop().approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)))) if n > 1 else []
    # what is shuffled has 16 bits for an id where all ids fit
    kind = "<u2" if max(vocabulary_size(tokenizer) - 1, end_id) < 1 << 16 else "<u4"
    ranged = texts.mapInArrow(_encoded(tokenizer, end_id, bounds, kind), "doc_id long, part int, packed binary").repartitionById(n, F.col("part"))
    placed = ranged.sortWithinPartitions("part", "doc_id", "packed").mapInArrow(_placed(kind), "doc_id long, part int, row_start long, n_tokens long, ids array<int>")
    placed.write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The documents of written files. start counts the ids of all documents before. Only asked-for columns are read."""
    files = spark.read.schema("doc_id long, part int, row_start long, n_tokens long, ids array<int>").parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row a part, and there are at most as many parts as shuffle partitions: small enough to broadcast at any size
    base = F.broadcast(parts.select("part", F.coalesce(before, F.lit(0)).alias("base")))
    return files.join(base, "part").withColumn("start", F.col("base") + F.col("row_start")).select(*columns)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in batch.column(3)]
        yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
