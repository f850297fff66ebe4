"""Sharding whole groups by longest-processing-time scheduling.

Rows with equal texts form a group that must not be split.  Groups sorted by
size go, one after another, to the least-loaded shard, held in a heap.  At any
scale the heap sees a bounded number of units: a group of at least
1 / (shards * units_per_shard) of all bytes is a unit by itself (there can be
no more than shards * units_per_shard of them), and smaller groups are first
gathered by hash into that many bundles.  So the driver schedules at most
2 * shards * units_per_shard units, and a bundle is too small to unbalance a
shard.  Slots number a shard's rows by doc_id.

A NULL text counts as empty and belongs to the empty text's group; a NULL
doc_id takes its shard's first slots; repeated rows are one group with a slot
each; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare, text_or_empty
from dunegrid.operators.ordering import with_position
from dunegrid.session import materialize


def least_loaded(units: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest-processing-time schedule of (size, key) units; ties go to the
    smaller key and the smaller shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(units, key=lambda u: (-u[0], u[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def placed_rows(docs: DataFrame, shards: int = 24, units_per_shard: int = 500, row_bytes: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus ``row_bytes``), text_crc32, group (of the text), shard."""
    spark = docs.sparkSession
    prepare(spark)
    raw = F.encode(text_or_empty(), "UTF-8")
    units = shards * units_per_shard
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + row_bytes).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("group")), "shard-rows")
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") * units >= F.lit(total)
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(units)))
    found = (groups.filter(large).select("group", "size")  # at most `units` rows
             .unionByName(groups.filter(~large).groupBy(bundle.alias("group")).agg(F.sum("size").alias("size"))))
    plan = least_loaded([(r["size"], r["group"]) for r in found.collect()], shards)
    lookup = spark.createDataFrame(list(plan.items()) or [("", 0)], "unit string, shard int")
    own = F.broadcast(lookup.select(F.col("unit").alias("group"), F.col("shard").alias("own_shard")))
    bundled = F.broadcast(lookup.select("unit", F.col("shard").alias("bundle_shard")))
    return (rows.join(own, "group", "left").join(bundled, bundle == F.col("unit"), "left")
            .select("doc_id", "size", "text_crc32", "group",
                    F.coalesce("own_shard", "bundle_shard").alias("shard")))


def shard_rows(docs: DataFrame, shards: int = 24, units_per_shard: int = 500, row_bytes: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus ``row_bytes``), text_crc32, shard, slot."""
    placed = placed_rows(docs, shards, units_per_shard, row_bytes).drop("group")
    placed = with_position(placed, ["shard", "doc_id", "text_crc32"])
    first = placed.groupBy("shard").agg(F.min("pos").alias("first_pos"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("first_pos")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write whole rows below ``path``, one folder ``_shard=N`` per shard."""
    placed = placed_rows(docs, shards).select("doc_id", F.col("group").alias("_group"), F.col("shard").alias("_shard"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"),
                       F.md5(F.encode(text_or_empty(), "UTF-8")).alias("_text"))
    # by doc_id as well, so that copies of one text do not meet
    both = rows.join(placed.distinct(), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text") == F.col("_group")))
    both.select("row.*", "_shard").write.mode("overwrite").partitionBy("_shard").parquet(path)
