"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.session import checkpoint_dir

#: Characters between words, as a regular expression for Spark, DuckDB and Python alike.
BREAKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` below the shared checkpoint folder and read it back.

    Cuts lineage so that a lost executor re-reads files; readers keep column pruning.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` minus the columns an operator is about to add, whatever their letter case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often `body` mentions it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def arrow_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 32) -> None:
    """Bound what Spark hands to a Python worker at once: whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def shipped(module: str) -> None:
    """Send the module's functions along with tasks, so that workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache(name: str, build: Callable):
    """An object that lives as long as the Python worker process and serves all its tasks."""
    kept = sys.modules.setdefault("llm_worker_cache", types.ModuleType("llm_worker_cache")).__dict__
    if name not in kept:
        kept[name] = build()
    return kept[name]


shipped(__name__)
