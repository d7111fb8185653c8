"""Exact duplicate removal with a Bloom filter of the hashes that may repeat.

Pass one counts hits of filter slots; the slots hit twice form a second, blocked
filter. Pass two probes it: a row it rejects is certainly unique and passes straight
through, and only the rest is shuffled to find groups exactly. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import BREAKS, stored, without

BLOCK_BITS = 32768  # fixed value: bits of one bitmap of bitmap_construct_agg
BITS_PER_ROW = 16
BROADCAST_BYTES = 128 << 20  # a filter up to this size is sent to every executor

_INTERNAL = ("_block", "_at", "_bits", "_least", "_digest", "_maybe", "_row")


def normalised_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BREAKS, " "), 256)


def _address(digest: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a digest and its two bit positions there."""
    bits = F.xxhash64(digest)
    low = F.pmod(bits, F.lit(BLOCK_BITS)).cast("int")
    high = F.pmod(F.shiftrightunsigned(bits, 24), F.lit(BLOCK_BITS)).cast("int")
    return F.pmod(F.hash(digest), F.lit(blocks)), F.array_distinct(F.array(low, high))


def repeat_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """Blocked filter (`_block`, `_bits`) of the slots that two rows of `digests._digest` have hit."""
    block, at = _address(F.col("_digest"), blocks)
    slots = digests.select(block.alias("_block"), F.explode(at).alias("_at"))
    twice = slots.groupBy("_block", "_at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def flag_possible_repeats(rows: DataFrame, bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """`rows` (with `_digest`) plus `_maybe`: false only where no other row has the digest."""
    n = rows.count()
    blocks = max(1, -(-n * bits_per_row // BLOCK_BITS))
    seen = stored(repeat_filter(rows.select("_digest"), blocks))
    if blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES:
        seen = F.broadcast(seen)
    block, at = _address(F.col("_digest"), blocks)
    probed = rows.withColumns({"_block": block, "_at": at}).join(seen, "_block", "left")

    def hit(position: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, position % 8) == 1

    maybe = F.coalesce(F.col("_bits").isNotNull() & F.forall("_at", hit), F.lit(False))
    return probed.withColumn("_maybe", maybe).drop("_block", "_at", "_bits")


def mark_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row as (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after white space runs become one space; null counts as
    empty. The smallest id of a group stays, a null id only if the group has no other; of rows
    that repeat id and text exactly one is kept. Other columns are not needed and not read.
    An empty table gives an empty result.
    """
    rows = stored(docs.select(F.col(id_col), normalised_digest(F.col(text)).alias("_digest"), F.monotonically_increasing_id().alias("_row")))
    flagged = flag_possible_repeats(rows)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    again = flagged.where("_maybe")
    groups = again.groupBy("_digest").agg(F.min(order).alias("_least"), F.count(F.lit(1)).alias("group_size"))
    repeated = again.join(groups, "_digest").select(
        id_col, F.col("_least.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_least.row")).alias("kept"), F.col("_digest").alias("text_sha256"))
    single = flagged.where("not _maybe").select(
        id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_digest").alias("text_sha256"))
    return single.unionByName(repeated)


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns; the rules are those of `mark_copies`.

    Unique rows are not shuffled. Of rows that share id and normalised text the smallest in
    column order stays. Input columns named like an internal one (`_digest` and so on) are lost.
    """
    docs = without(docs, *_INTERNAL)
    flagged = flag_possible_repeats(docs.withColumn("_digest", normalised_digest(F.col(text))))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.struct(*docs.columns).alias("row"))
    firsts = flagged.where("_maybe").groupBy("_digest").agg(F.min(order).alias("_least")).select("_least.row.*")
    return flagged.where("not _maybe").select(*docs.columns).unionByName(firsts)
