"""Quality rules with thresholds taken from the data, per language and source.

Each measure of a text is an integer. Its sketch is a histogram over values cut to their six
leading binary digits (at most 3 % off), so sketches merge by adding counts, in any order
and with the same result. A group's sketch is merged with that of its language, which counts as PRIOR_TEXTS
texts, and this one with that of all texts in the same way: the fewer texts a group has, the more it is
judged like its language. Fences lie so many times the distance of the outer quantiles from the median away from
the median. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import let, stored, without, words_of

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of words
SKETCH_DIGITS = 6
PRIOR_TEXTS = 50  # texts that the next larger sketch counts for
#: Measures a text is judged by and the least distance of a fence from the median, in its own units (rates per 1000, length in 1/100):
#: one bin of the sketch, but for repeated lines, which are rare in any group and ordinary in lists and verse.
MEASURES = {"symbol_rate": 1, "dup_line_rate": 300, "repeat_rate": 1, "word_length": 1}
LOW, HIGH = 10, 90  # percent: the outer quantiles
REACH = 6  # fences lie so many times the distance of an outer quantile from the median away from it

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_ADDED = (*BASE, "kept", *MEASURES, *(f"{m}_limit" for m in MEASURES), "_words", "_lines", "_w", "_lang", "_source")


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text."""

    def covered(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - 2)
        windows = F.transform(starts, lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")))

        def marked(s: Column) -> Column:
            def twin(x: Column, j: Column) -> Column:
                before = (j > 0) & (F.get(s, j - 1)["h"] == x["h"])
                after = (j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == x["h"])
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            at = F.transform(F.filter(s, twin), lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        return let(F.sort_array(windows), marked)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(covered(words)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus the base columns and the measures. A null text has no words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"),
                        _repeat_words(w).alias("repeated"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    out = docs.withColumns({"_w": let(words_of(F.col(text)), of_words), "_lines": let(lines, of_lines),
                            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long")})
    out = out.withColumns({"n_words": F.col("_w.n"), "word_chars": F.col("_w.chars"), "n_dup_lines": F.col("_lines.dup"), "n_repeat_words": F.col("_w.repeated")})
    rate = lambda part, whole, scale: F.expr(f"coalesce(({part}) * {scale} div nullif({whole}, 0), 0)")
    return out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED),
        "symbol_rate": rate("n_symbols", "word_chars", 1000), "dup_line_rate": rate("n_dup_lines", "_lines.n", 1000),
        "repeat_rate": rate("n_repeat_words", "n_words", 1000), "word_length": rate("word_chars", "n_words", 100)}).drop("_w", "_lines")


def _cut(value: str) -> str:
    """The value's six leading binary digits; exact below 64."""
    return f"shiftleft(shiftright({value}, greatest(length(bin({value})) - {SKETCH_DIGITS}, 0)), greatest(length(bin({value})) - {SKETCH_DIGITS}, 0))"


def sketches(judged: DataFrame, measures=tuple(MEASURES)) -> DataFrame:
    """Counts per (_lang, _source, measure, bin): the mergeable sketch of every group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures]))
    return (judged.select("_lang", "_source", pairs.alias("p")).select("_lang", "_source", "p.measure", F.expr(_cut("p.v")).alias("bin"))
            .groupBy("_lang", "_source", "measure", "bin").agg(F.count(F.lit(1)).alias("n")))


def shrunk(sketch: DataFrame) -> DataFrame:
    """Weight of every bin per (_lang, _source, measure): the group's own counts and PRIOR_TEXTS texts spread like its language."""
    sketch = sketch.groupBy("_lang", "_source", "measure", "bin").agg(F.sum("n").alias("n"))
    per = lambda *by: sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n")).withColumn("texts", F.sum("n").over(Window.partitionBy(*by, "measure")))
    every = per().select(F.col("measure").alias("_m"), F.col("bin").alias("_b"), (F.col("n") / F.col("texts")).alias("share"))
    lang = per("_lang")
    langs = lang.select("_lang", "measure", "texts").distinct().join(every, F.col("measure") == F.col("_m")).drop("_m")
    own = lang.select(F.col("_lang").alias("_l"), F.col("measure").alias("_m"), F.col("bin").alias("_bin"), F.col("n").alias("_n"))
    langs = langs.join(own, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m")) & (F.col("_b") == F.col("_bin")), "left")
    langs = stored(langs.select(F.col("_lang").alias("_l"), F.col("measure").alias("_m"), F.col("_b"), ((F.coalesce("_n", F.lit(0)) + F.col("share") * PRIOR_TEXTS) / (F.col("texts") + PRIOR_TEXTS)).alias("share")))
    groups = sketch.select("_lang", "_source", "measure").distinct().join(langs, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m"))).drop("_l", "_m")
    counts = sketch.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), F.col("measure").alias("_m"), F.col("bin").alias("_bin"), F.col("n").alias("_n"))
    both = groups.join(counts, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("measure") == F.col("_m")) & (F.col("_b") == F.col("_bin")), "left")
    return both.select("_lang", "_source", "measure", F.col("_b").alias("bin"), (F.coalesce("_n", F.lit(0)) + F.col("share") * PRIOR_TEXTS).alias("weight"))


def quantiles(weighted: DataFrame) -> DataFrame:
    """Median and outer quantiles per (_lang, _source, measure); a group's bins are a few hundred at most."""
    by = ("_lang", "_source", "measure")
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = weighted.withColumns({"upto": F.sum("weight").over(up), "texts": F.sum("weight").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # sums of shares: a quantile is reached also where rounding leaves it short
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("texts") * p - 1e-6, F.col("bin")))
    return ranked.groupBy(*by).agg(at(LOW).alias("low"), at(50).alias("middle"), at(HIGH).alias("high"))


def thresholds(judged: DataFrame) -> DataFrame:
    """One row per (_lang, _source) with a low and a high fence for each measure."""
    q = quantiles(shrunk(stored(sketches(judged))))
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair]), F.col("measure"))
    below, above = F.greatest(REACH * (F.col("middle") - F.col("low")), floor), F.greatest(REACH * (F.col("high") - F.col("middle")), floor)
    fences = q.select("_lang", "_source", "measure", F.struct((F.col("middle") - below).alias("low"), (F.col("middle") + above).alias("high")).alias("fence"))
    return fences.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{m}_limit") for m in MEASURES])


def judged_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep=None) -> DataFrame:
    """`docs` (or its columns `keep`) plus base columns, measures, their limits and `kept`.

    Thresholds come from the texts that pass the base rules, over all rows of each language
    and source; null is a value of its own for both. Input columns named like an added one are
    replaced. An empty table gives an empty result.
    """
    docs = without(docs, *[c for c in _ADDED if c not in (text, lang, source)])
    keep = list(docs.columns) if keep is None else list(keep)
    rows = measured(docs, text).withColumns({"_lang": F.col(lang), "_source": F.col(source)}).select(*keep, *BASE, *MEASURES, "_lang", "_source")
    if text not in keep:
        rows = stored(rows)
    limits = stored(thresholds(rows.where("not base_failed")))
    limits = limits.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    if limits.count() <= 200_000:  # one row per language and source
        limits = F.broadcast(limits)
    joined = rows.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s", "_lang", "_source")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"{m}_limit.low"), F.col(f"{m}_limit.high"))
    return joined.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False))))


def passed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `judged_quality` keeps."""
    return judged_quality(docs, **options).where("kept").select(*docs.columns)
