"""Token counts: pieces are counted once per distinct pre-token and joined to each text's pre-token frequencies.

A pre-token is a stretch of text that no vocabulary piece can reach across, so its count does
not depend on its surroundings. Counts of the most frequent pre-tokens, bounded in number, are
sent to every executor; a text's remaining pre-tokens are rare ones and are joined by shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import arrow_batches, shipped, stored, utf8_size

shipped(__name__)

FREQUENT = 200_000  # pre-tokens whose counts are sent to every executor, at most
FREQUENT_CHARS = 64  # length of such a pre-token, at most
LIMIT = 4096
_HELD = 300_000  # pre-tokens counted in memory before they are passed on

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACE = " ▁"  # the library reads both as the same symbol
#: From fine to coarse: a pattern of pre-tokens, and what a piece must not contain for it to hold.
PATTERNS = (
    (f"[{_SPACE}]*[{_LATIN}]+|[{_SPACE}]*[^{_SPACE}\n{_LATIN}]+|[{_SPACE}]+|\n", f"[{_LATIN}][^{_LATIN}]|[^{_LATIN}▁][{_LATIN}]|[^▁]▁|\n"),
    (f"[{_SPACE}]*[^{_SPACE}\n]+|[{_SPACE}]+|\n", "[^▁]▁|\n"),
)


def load_model(content: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


def pretoken_pattern(model) -> str:
    """The finest pattern that the vocabulary permits."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    for pattern, across in PATTERNS:
        if not any(re.search(across, p) for p in pieces):
            return pattern
    raise ValueError("pieces of this vocabulary reach across words and lines")


def pretokens(text: str | None, pattern: re.Pattern) -> list[str]:
    """A text's pre-tokens; the library puts one space before any text."""
    return pattern.findall(" " + text) if text else []


def piece_counts(distinct: list[str], model) -> list[int]:
    """Number of pieces of each pre-token. A line end before it keeps the library's own leading space apart."""
    base = len(model.encode("\n"))
    return [len(x) - base for x in model.encode(["\n" + p for p in distinct], num_threads=1)]


def frequencies(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Distinct pre-tokens of all texts (`pre`, `n`), summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = re.compile(pattern), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(pretokens(t, split))
            if len(held) >= _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pre", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pre", "n"])

    return docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))


def counted(distinct: DataFrame, content: bytes) -> DataFrame:
    """`distinct` plus `pieces`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(content)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(piece_counts(b.column("pre").to_pylist(), model), pa.int64())], ["pre", "n", "pieces"])

    return distinct.mapInArrow(run, "pre string, n long, pieces long")


def frequent(counts: DataFrame, most: int = FREQUENT) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: all from a frequency on, chosen so that there are at most `most`."""
    short = counts.where(F.length("pre") <= FREQUENT_CHARS)
    # frequencies cut to four leading binary digits: a few hundred rows
    cut = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 4, 0)), greatest(length(bin(n)) - 4, 0))")
    level, total = None, 0
    for r in short.groupBy(cut.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        level = r["level"]
    return {} if level is None else {r["pre"]: r["pieces"] for r in short.where(F.col("n") >= level).select("pre", "pieces").collect()}


def token_counts(docs: DataFrame, model_path: str, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Every row as (id_col, n_bytes, n_tokens, over_limit); null counts as empty, with no tokens.

    Rows are counted one by one, so repeated rows and null ids each get their own result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    content = Path(model_path).read_bytes()  # the driver's file; tasks get its content
    pattern = pretoken_pattern(load_model(content))
    counts = stored(counted(frequencies(docs, pattern, text), content))
    known = spark.sparkContext.broadcast(frequent(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table = re.compile(pattern), known.value
        rest_type = pa.list_(pa.struct([("pre", pa.string()), ("times", pa.int64())]))
        for b in batches:
            sums, rest = [], []
            for t in b.column("_text").to_pylist():
                n, rare = 0, Counter()
                for p in pretokens(t, split):
                    pieces = table.get(p)
                    if pieces is None:
                        rare[p] += 1
                    else:
                        n += pieces
                sums.append(n)
                rest.append([{"pre": p, "times": k} for p, k in rare.items()])
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_id"), b.column("_bytes"), pa.array(sums, pa.int64()), pa.array(rest, rest_type)],
                                             ["_row", "_id", "_bytes", "_n", "_rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), utf8_size(F.col(text)).alias("_bytes"), F.col(text).cast("string").alias("_text"))
    summed = stored(rows.mapInArrow(run, f"_row long, _id {kind}, _bytes long, _n long, _rest array<struct<pre: string, times: long>>"))
    rare = summed.select("_row", F.explode("_rest").alias("r")).select("_row", F.col("r.pre").alias("pre"), F.col("r.times").alias("times"))
    joined = rare.join(counts.select("pre", "pieces"), "pre").select("_row", F.lit(None).cast(kind).alias("_id"), F.lit(None).cast("long").alias("_bytes"), (F.col("times") * F.col("pieces")).alias("_n"))
    total = summed.select("_row", "_id", "_bytes", "_n").unionByName(joined).groupBy("_row").agg(F.max("_id").alias(id_col), F.max("_bytes").alias("n_bytes"), F.sum("_n").alias("n_tokens"))
    return total.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
