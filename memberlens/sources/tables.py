"""Readers and writers: parquet and CSV in; parquet, CSV and JSON out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.session import RECORDS_PER_FILE

# Empty text is written as a quoted empty field and null as \\N; an unquoted empty field would read as null.
_CSV = {"header": True, "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan. Zone-less timestamps are read as session-zone (UTC) timestamps."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass)."""
    return spark.read.options(**_CSV, emptyValue="", enforceSchema=False).schema(schema).csv(path)


def write_monthly(df: DataFrame, path: str) -> None:
    """One folder per observation date; only the dates present in `df` are replaced.

    Files follow the rows: rebalancing splits large months and joins the parts of small ones by their size.
    """
    (df.withColumn("observation_date", F.to_date("observation_date"))
     .hint("rebalance", "observation_date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .partitionBy("observation_date").parquet(path))


def read_monthly(spark: SparkSession, path: str, dates: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if dates is not None:
        df = df.where(F.col("observation_date").isin([F.lit(d).cast("date") for d in dates]))
    return df.withColumn("observation_date", F.col("observation_date").cast("timestamp"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header. Empty text and null stay distinguishable when read back, and spaces are kept."""
    df.write.mode("overwrite").options(**_CSV, emptyValue='""').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in the place of another one."""
    fs, new = _files(spark, source)
    _, old = _files(spark, target)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{source} cannot take the place of {target}")


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


_MONTH = "observation_date="
_MARKERS = "_manifest"


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    """Hadoop's file system of a path, and the path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def built_dates(spark: SparkSession, path: str) -> set[str]:
    """Observation dates already present below `path` (listing of partition folders only)."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return set()
    names = [status.getPath().getName() for status in fs.listStatus(root) if status.isDirectory()]
    return {n[len(_MONTH):] for n in names if n.startswith(_MONTH)}


def file_state(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of all files below a path; none if it does not exist."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    found, base = [], len(fs.makeQualified(root).toString())
    files = fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString()[base:], f.getLen(), f.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, inputs: Sequence[str], version: str = "") -> str:
    """Hash of names, sizes and times of all input files, and of the version of the code that reads them."""
    state = [version, *[(p, file_state(spark, p)) for p in inputs]]
    return hashlib.sha256(json.dumps(state).encode()).hexdigest()


def _marker(path: str, date: str) -> str:
    return f"{path}/{_MARKERS}/{_MONTH}{date}"


def _stored_files(spark: SparkSession, path: str, date: str) -> list[list]:
    return [[n, size] for n, size, _ in file_state(spark, f"{path}/{_MONTH}{date}") if not n.rsplit("/", 1)[-1].startswith(("_", "."))]


def valid_dates(spark: SparkSession, path: str, dates: Sequence[str], mark: str) -> set[str]:
    """Dates whose marker carries the fingerprint and lists exactly the files that are there."""
    out = set()
    for date in dates:
        fs, where = _files(spark, _marker(path, date))
        if fs.exists(where):
            stream = fs.open(where)
            try:
                told = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            if told == {"fingerprint": mark, "files": _stored_files(spark, path, date)}:
                out.add(date)
    return out


def build_missing(spark: SparkSession, path: str, dates: Sequence[str],
                  build: Callable[[list[str]], DataFrame], inputs: Sequence[str] = (), version: str = "") -> DataFrame:
    """Build and store the observation dates that are not stored as they should be, then read all of them.

    A date counts as stored if its marker says so: it is removed before the date is written and written after it, with the
    fingerprint of the input files and the files stored. Dates that were half written, changed, or built from other inputs are
    built again. Without `inputs`, `path` must identify them.
    """
    mark = fingerprint(spark, inputs, version)
    valid = valid_dates(spark, path, dates, mark)
    missing = [d for d in dates if d not in valid]
    if missing:
        for d in missing:
            fs, where = _files(spark, _marker(path, d))
            fs.delete(where, False)
        write_monthly(build(missing), path)
        for d in missing:
            fs, where = _files(spark, _marker(path, d))
            stream = fs.create(where, True)
            try:
                stream.write(bytearray(json.dumps({"fingerprint": mark, "files": _stored_files(spark, path, d)}).encode()))
            finally:
                stream.close()
    return read_monthly(spark, path, dates)


def prior_month(date: str) -> str:
    """Same day one calendar month earlier, clamped to the month end."""
    import pandas as pd

    return str((pd.Timestamp(date) - pd.DateOffset(months=1)).date())
