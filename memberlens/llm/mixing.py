"""Mixing sources to target weights by repeating documents.

Sizes are summed per source, targets give repetition rates, and a document is emitted
floor(rate) times plus one hash-seeded draw with the fraction as its probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import stored, without, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix"
BROADCAST_SOURCES = 200_000  # so many rates are sent to every executor; with more, the join shuffles

_ADDED = ("size", "source_size", "target", "copies", "taken", "copy", "_source", "_rate")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Target per source of `sized` (_source, size): one row per source.

    Sources in code point order, null last, take the weights in turn. Targets add up to the
    total size; none exceeds `most` times its source's size. What is above is shared again by
    weight until none is above, which is the level w * level with sources filled in the
    order of size per weight: the first place where the next source is not full.
    """
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy("per_weight", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = (weighed.withColumn("per_weight", F.col("cap") / F.col("w"))
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
              .withColumn("level", F.col("left") / F.col("w_left")))
    # only where the level does not exceed the source's own limit are all later ones unfilled too
    level = F.min(F.when(F.col("level") <= F.col("per_weight"), F.struct("per_weight", F.col("_source").isNull(), "_source", "level"))).over(everything)["level"]
    return (filled.withColumn("at", level)
            .withColumn("target", F.when(F.col("per_weight") <= F.col("at"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("at")))
            .select("_source", "source_size", "target", F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("_rate")))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the seed and the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: str = SEED,
          weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """`docs` plus size, source_size, target, copies (how often the mix takes the row) and taken.

    Size is the number of words, 0 for null. A null source is a source of its own. Rows with one
    id draw the same number. Input columns named like an added one are replaced. One row per
    source passes through a window; documents are not shuffled while the rates are few.
    """
    docs = without(docs, *[c for c in _ADDED if c not in (text, source, id_col)])
    sized = docs.withColumns({"size": word_count(F.col(text)), "_source": F.col(source)})
    rates = stored(source_targets(sized.select("_source", "size"), weights, most))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.alias("d").join(rates.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of", "_source")
    whole = F.floor("_rate")
    copies = (whole + F.when(draw(F.col(id_col), seed) < F.col("_rate") - whole, 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("_rate")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as `mixed` takes it, with the input's columns."""
    columns = docs.columns
    return mixed(docs, **options).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
