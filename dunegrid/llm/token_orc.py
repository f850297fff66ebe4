"""Token ids in ORC files, written in document order and read back by stripe.

Spark's ORC writer stores the id lists with integer run-length encoding, keeps
row-index statistics per ``row_stride`` rows and a Bloom filter on the document
id.  A scan is split between stripes, so many tasks read one file, and a
look-up of document ids skips files, stripes and row groups from metadata.

File columns: ``doc_id``, ``shard`` (number of the file in document order),
``start_in_shard`` (ids of the shard's documents before this one), ``n_tokens``
and ``ids``.

Rows with a NULL text hold the end id only; a NULL doc_id sorts first; equal
doc_ids follow each other in the order of their texts' hashes, so repeated rows
are repeated documents.  An empty table gives no file rows.  Other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunegrid.llm import tokens
from dunegrid.llm.common import prepare, slices, text_or_empty

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()),
    T.StructField("start_in_shard", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
#: Characters encoded before their ids leave the worker.
BLOCK_CHARS = 2_000_000


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Rows of SCHEMA in ascending doc_id order, one shard per sorted partition."""
    prepare(docs.sparkSession)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
            .withColumn("shard", F.spark_partition_id()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start, end = tokens.encoder(tokenizer), 0, np.array([end_id], "<u4").tobytes()
        for b in batches:
            sizes = pc.binary_length(b.column("text")).to_pylist()
            for lo, hi in slices(b.num_rows, sizes, BLOCK_CHARS):
                ids = [x + end for x in enc.encode(b.column("text").slice(lo, hi - lo).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                    pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("shard").slice(lo, hi - lo),
                     pa.array(start + ends - n), pa.array(n), lists], names=SCHEMA.names)
                start += int(ends[-1])

    return rows.mapInArrow(encode, SCHEMA)


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                    stripe_bytes: int = 16 << 20, row_stride: int = 1000) -> None:
    """Encode ``docs`` (doc_id, text) and write the files below ``path``."""
    (encode_sorted(docs, tokenizer, end_id).write.mode("overwrite")
     .option("compression", "lz4").option("orc.stripe.size", stripe_bytes)
     .option("orc.create.index", "true").option("orc.row.index.stride", row_stride)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with ``doc_ids``, those documents only (pruned by row
    index and Bloom filter)."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32."""
    prepare(spark)
    rows = read_token_orc(spark, path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file
              .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start")))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(data[4 * x:4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("shard"), b.column("start_in_shard"),
                 pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"])

    read = rows.select("doc_id", "shard", "start_in_shard", "ids").mapInArrow(
        crc, "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
