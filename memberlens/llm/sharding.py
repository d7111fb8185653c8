"""Shards of near-equal bytes by longest-processing-time scheduling of groups that stay together.

Groups of equal texts are never split. A group that alone holds at least one part in
shards * UNITS_PER_SHARD of all bytes is a unit of its own (there cannot be more of them than
that many); all smaller groups fall by hash into as many bundles. So the heap sees at most
2 * shards * UNITS_PER_SHARD units, whatever the number of documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memberlens.llm.common import stored, utf8_size

UNITS_PER_SHARD = 1000
SIZE_PER_ROW = 8  # fixed value: bytes of a row besides its text


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (unit, size): largest unit first, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[unit] = shard
    return out


def _units(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` plus `unit`: the group itself if it is large, else its bundle."""
    bundles = shards * UNITS_PER_SHARD
    total = rows.agg(F.sum("size")).first()[0] or 0
    # map-side sums: a group with a third of all rows arrives as one row per task
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    large = stored(groups.where(F.col("bytes") * bundles >= total).select("group", (F.xxhash64("group")).alias("own")))
    # at most `bundles` rows by the condition above
    return (rows.join(F.broadcast(large), "group", "left")
            .withColumn("unit", F.when(F.col("own").isNotNull(), F.col("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string"))).drop("own"))


def sharded(docs: DataFrame, shards: int = 24, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row as (id_col, size, text_crc32, shard, slot).

    A null text counts as empty, so both form one group. Slots run from 0 without gaps in each
    shard; within a shard they follow units, then ids. An id may be null or repeated: each row
    gets a slot of its own. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(id_col), (utf8_size(F.col(text)) + SIZE_PER_ROW).alias("size"),
                              F.crc32(body.cast("binary")).alias("text_crc32"), F.sha2(body, 256).alias("group")))
    placed = stored(_units(rows, shards).drop("group"))
    loads = placed.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    n_rows = sum(r["n"] for r in loads)
    shard_of = longest_first([(r["unit"], r["bytes"]) for r in loads], shards)
    # rows of a large unit are numbered in several slices: as many as keep slices near one bundle
    slices = {r["unit"]: 1 + r["n"] * shards * UNITS_PER_SHARD // max(1, n_rows) for r in loads}
    plan = spark.createDataFrame([(u, s, slices[u]) for u, s in shard_of.items()], "unit string, shard int, slices long")
    cut = placed.join(F.broadcast(plan), "unit").withColumn("slice", F.pmod(F.xxhash64(id_col), F.col("slices")))
    counts = sorted((r["shard"], r["unit"], r["slice"], r["n"]) for r in cut.groupBy("shard", "unit", "slice").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, fill = [], [0] * shards
    for shard, unit, piece, n in counts:
        starts.append((unit, piece, fill[shard]))
        fill[shard] += n
    offsets = spark.createDataFrame(starts, "unit string, slice long, first long")
    order = Window.partitionBy("unit", "slice").orderBy(F.col(id_col).asc_nulls_last())
    return (cut.join(F.broadcast(offsets), ["unit", "slice"]).withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
            .select(id_col, "size", "text_crc32", "shard", "slot"))
