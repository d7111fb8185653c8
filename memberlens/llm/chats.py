"""Chat formatting after collapsing cumulative snapshots of conversations.

A logger that stores a conversation after every turn leaves many logs that are beginnings of
longer ones. Rolling hashes over turns give every beginning a key; anti-joins on (length, key)
remove the logs that some longer log begins with, and the rest is rendered turn by turn, so
that no conversation has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import stored

BLOCK = 1024  # turns numbered together; longer conversations are numbered block by block
_KEY = ("h1", "h2", "h3", "h4")


def _halves(value: Column, *names: str) -> list[Column]:
    """A 64-bit hash as two 32-bit numbers, whose sums cannot overflow."""
    return [value.bitwiseAND(F.lit(0xFFFFFFFF)).alias(names[0]), F.shiftrightunsigned(value, 32).alias(names[1])]


def _running(rows: DataFrame, columns: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Replace `columns` by their running sums over each conversation, by blocks and then within blocks."""
    sums = rows.groupBy("conv", "block").agg(*[F.sum(c).alias(f"{c}_sum") for c in columns])
    earlier = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), *[F.coalesce(F.sum(f"{c}_sum").over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns])
    within = Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(within) for c in columns})
    joined = local.join(before, F.col("conv").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block")))
    return joined.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in columns}).select(*rows.columns)


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn as (conv, turn, role, text, position, h1..h4): the key covers the turns up to its position.

    Positions run from 1 in the order of turn, role, text. Exact repetitions of a turn count once; null roles and
    texts count as empty, a null conversation is one of its own, a null turn comes first.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.withColumns({"block": F.floor(F.col("turn") / BLOCK), "position": F.lit(1).cast("long")})
    rows = _running(rows, ("position",), order)
    first, second = F.xxhash64("position", "role", "text"), F.xxhash64("text", "role", "position", F.lit("second"))
    rows = rows.select("*", *_halves(first, "h1", "h2"), *_halves(second, "h3", "h4"))
    return _running(rows, _KEY, order).drop("block")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def collapsed(turns: DataFrame, conv: str = "conv_id", **columns: str) -> DataFrame:
    """Rendered turns of the maximal conversations: conv, position, n_turns, n_logs, rendered.

    A conversation is dropped if a longer one begins with all its turns. Of equal conversations the smallest id stays
    (null only if alone) and n_logs tells how many there were. Joining the rendered turns by position gives the text.
    """
    marked = stored(prefixes(turns, conv, **columns))
    lengths = marked.groupBy(F.col("conv").alias("_c")).agg(F.max("position").alias("n_turns"))
    ends = marked.select("conv", "position", *_KEY).join(lengths, F.col("conv").eqNullSafe(F.col("_c")))
    # equal beginnings collapse in the tasks: a first turn that millions share is one row here
    inner = ends.where("position < n_turns").select("position", *_KEY).distinct()
    whole = ends.where("position = n_turns").groupBy("position", *_KEY).agg(
        F.min("conv").alias("keep"), F.count(F.lit(1)).alias("n_logs")).join(inner, ["position", *_KEY], "left_anti")
    kept = stored(whole.select("keep", F.col("position").alias("n_turns"), "n_logs"))
    return (marked.join(kept, F.col("conv").eqNullSafe(F.col("keep")))
            .select(F.col("conv").alias(conv), "position", "n_turns", "n_logs", rendered_turn(F.col("role"), F.col("text")).alias("rendered")))
