"""Audit of the raw tables. Every report reads the whole table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.functions.exprs import count_where
from memberlens.functions.ranking import exact_quantiles
from memberlens.functions.scalars import beside
from memberlens.operators.clean import duplicate_keys
from memberlens.schema import EVENT_KEY, TIER_HISTORY
from memberlens.session import cut_lineage, small_side


EXAMPLES = 6
_SPAN = float(2**64)


def column_sketches(df: DataFrame, by: Sequence[str] = (), examples: int = EXAMPLES) -> DataFrame:
    """A mergeable profile of every column, per group: column, type, n_rows, n_null, smallest, largest, distinct, samples.

    `distinct` is an HLL sketch; `samples` are the values of least hash with their hashes. A first pass counts, a second one collects
    only values whose hash lies so low that about sixteen times the wanted number of them are expected, so buffers stay small.
    """
    fields = [f for f in df.schema.fields if f.name not in by]
    text = {f.name: F.col(f.name).cast("string") for f in fields}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        v = text[f.name]
        aggs += [F.count(v).alias(f"_c{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"), F.hll_sketch_agg(v).alias(f"_d{i}")]
    counted = cut_lineage(df.groupBy(*by).agg(*aggs))
    share = [F.lit(16.0 * examples) / F.greatest(F.hll_sketch_estimate(f"_d{i}"), F.lit(1)) for i in range(len(fields))]
    limits = [F.when(x < 1, (F.lit(-_SPAN / 2) + x * F.lit(_SPAN))).otherwise(F.lit(_SPAN / 2)).alias(f"_t{i}") for i, x in enumerate(share)]
    limited = counted.select(*by, *limits)
    keys = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    renamed = small_side(limited.withColumnsRenamed({c: f"_by_{c}" for c in by})) if by else limited
    rows = df.join(renamed, reduce(lambda a, b: a & b, keys)) if by else beside(df, renamed)
    picked = [F.slice(F.sort_array(F.collect_set(F.when(text[f.name].isNotNull() & (F.xxhash64(text[f.name]) <= F.col(f"_t{i}")),
                                                        F.struct(F.xxhash64(text[f.name]).alias("hash"), text[f.name].alias("value"))))), 1, examples).alias(f"_s{i}") for i, f in enumerate(fields)]
    sampled = rows.groupBy(*by).agg(*picked)
    both = counted.join(sampled.withColumnsRenamed({c: f"_by_{c}" for c in by}), reduce(lambda a, b: a & b, keys)) if by else beside(counted, sampled)
    each = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("n_rows"), (F.col("_rows") - F.col(f"_c{i}")).alias("n_null"),
                 F.col(f"_lo{i}").alias("smallest"), F.col(f"_hi{i}").alias("largest"), F.col(f"_d{i}").alias("distinct"), F.col(f"_s{i}").alias("samples"))
        for i, f in enumerate(fields)])
    return both.select(*by, F.explode(each).alias("r")).select(*by, "r.*")


def merged_profile(sketches: DataFrame, by: Sequence[str] = (), examples: int = EXAMPLES) -> DataFrame:
    """Profiles of any groups merged per column (and `by`): counts, extremes, approximate distinct count and sample values."""
    whole = sketches.groupBy(*by, "column", "type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("approx_distinct"),
        F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.collect_list("samples").alias("_s"))
    # `examples` values for each group that was merged
    least = F.slice(F.array_sort(F.array_distinct(F.flatten("_s"))), 1, examples)
    return whole.withColumn("samples", F.transform(least, lambda x: x["value"])).drop("_s")


def table_profile(df: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Per column: type, row count, null count, approximate distinct count, smallest and largest value and a few sample values."""
    return merged_profile(column_sketches(df, examples=examples), examples=examples)


def row_counts(tables: dict[str, tuple[DataFrame, int]], tolerance_pct: float = 5.0) -> DataFrame:
    """Actual against expected row counts; flags deviations above the tolerance."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("actual"),
                    F.lit(int(expected)).cast("long").alias("expected"))
             for name, (df, expected) in tables.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    off = F.abs(F.col("actual") - F.col("expected")) / F.col("expected") * 100.0
    return merged.withColumn("pct_diff", off).withColumn(
        "flag", F.when(off > tolerance_pct, "WARNING").otherwise("OK"))


def id_masks(df: DataFrame, column: str = "member_id") -> DataFrame:
    """Digit-masked id shapes with counts; the most frequent one is dominant."""
    mask = F.regexp_replace(F.col(column).cast("string"), r"[0-9]", "#")
    shapes = df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n_rows"))
    best = shapes.agg(F.min(F.struct(-F.col("n_rows"), F.col("mask"))).alias("_b"), F.sum("n_rows").alias("_n"))
    return (beside(shapes, best.select(F.col("_b.mask").alias("_top"), "_n"))
            .select("mask", "n_rows", (F.col("n_rows") / F.col("_n")).alias("share"),
                    (F.col("mask") == F.col("_top")).alias("is_dominant")))


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage of every column, from one aggregation."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("_n") - F.col(f"_{i}")).alias("n_null"),
                              ((F.col("_n") - F.col(f"_{i}")) / F.col("_n") * 100.0).alias("null_pct"))
                     for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def date_format_census(df: DataFrame, column: str) -> DataFrame:
    """How many values start like an ISO date and how many like a day-first date."""
    typed = isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType))
    text = F.col(column).cast("string")
    iso, day_first = text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.rlike(r"^\d{2}/\d{2}/\d{4}")
    counted = df.agg(F.lit(column).alias("column_name"), F.count(F.col(column)).alias("n_values"),
                     count_where(iso).alias("iso_count"), count_where(day_first).alias("day_first_count"))
    mixed = (F.col("iso_count") > 0) & (F.col("day_first_count") > 0) & F.lit(not typed)
    return counted.withColumn("is_mixed", mixed)


def json_parseability(df: DataFrame, column: str = "tier_history") -> DataFrame:
    """Nulls, valid and unreadable JSON lists, kept apart."""
    text = F.col(column)
    ok = text.isNotNull() & F.from_json(text, TIER_HISTORY).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_total"), count_where(text.isNull()).alias("n_null"),
                  count_where(ok).alias("n_valid"), count_where(text.isNotNull() & ~ok).alias("n_failure"))


def duplicate_audit(events: DataFrame, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Number of repeated keys and of the rows that carry them."""
    return duplicate_keys(events, key).agg(
        F.count(F.lit(1)).alias("n_duplicate_keys"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_duplicate_rows"))


def worst_duplicates(events: DataFrame, key: Sequence[str] = EVENT_KEY, top: int = 500) -> DataFrame:
    """The keys with the most copies (a top-k report)."""
    return duplicate_keys(events, key).orderBy(F.desc("n_rows"), *key).limit(top)


def session_distribution(events: DataFrame, column: str = "session_duration_sec") -> DataFrame:
    value = F.col(column)
    stats = events.agg(F.count(value).alias("n_values"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"),
                       count_where(value > 14400).alias("over_4h"), count_where(value > 28800).alias("over_8h"))
    cuts = exact_quantiles(events.select(F.col(column).cast("double").alias(column)), column,
                           {"p50": .5, "p90": .9, "p95": .95, "p99": .99})
    return beside(stats, cuts).withColumn("clip_upper", F.lit(14400.0))


def amount_bounds(transactions: DataFrame, column: str = "transaction_amount") -> DataFrame:
    value = F.col(column)
    stats = transactions.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"),
                             count_where(value < 0).alias("n_negative"), count_where(value == 0).alias("n_zero"))
    cuts = exact_quantiles(transactions.select(F.col(column).cast("double").alias(column)), column,
                           {"p01": .01, "p99": .99})
    return beside(stats, cuts)


def category_distribution(df: DataFrame, column: str = "transaction_type") -> DataFrame:
    """Value counts and shares of a column as stored and after trimming and lower-casing."""
    raw = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n_rows"))
    both = raw.withColumn("stage", F.lit("raw")).unionByName(
        raw.groupBy(F.lower(F.trim("category")).alias("category")).agg(F.sum("n_rows").alias("n_rows"))
        .withColumn("stage", F.lit("normalised")))
    total = both.groupBy("stage").agg(F.sum("n_rows").alias("_n"))
    return (both.join(small_side(total), "stage")
            .select("stage", "category", "n_rows", (F.col("n_rows") / F.col("_n")).alias("share")))
