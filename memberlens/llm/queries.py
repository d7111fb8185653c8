"""The operators of this package as named queries over the test tables, with comparison SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.llm import chats, collocations, exact_dedup, licenses, mixing, near_dedup, packing, quality, runs, sharding, substrings, tokens, toxicity
from memberlens.llm.common import let, table, words_of


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged_quality(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.collapsed(table(spark, sf_dir, "conversations"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                      F.array_join("expressions", "; ").alias("expressions"), "binding", "permissive")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.grouped(table(spark, sf_dir, "documents"), size=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = runs.periodic_runs(docs.select("doc_id", partly_periodic("text", "doc_id").alias("text")), keep=("doc_id",))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return out.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def partly_periodic(text: str, id_col: str) -> Column:
    """The text; where the id's checksum ends with 0, its words made periodic from one on as the query's contract says. A null id has no checksum."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda _, i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    changed = let(words_of(F.col(text)), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))
    return F.when(h % 10 == 0, changed).otherwise(F.col(text))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"), least=100, longest=5, top=2000)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"), window=20, keep=("doc_id",))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_license_scan": op4_license_scan,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_near_dedup": op7_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL = {
    "op3_chat_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, role, text, row_number() OVER w AS position, string_agg(role || chr(31) || text || chr(30), '') OVER w AS beginning, count(*) OVER (PARTITION BY conv_id) AS n_turns
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
k AS (SELECT min(conv_id) AS keep, count(*) AS n_logs FROM p
      WHERE position = n_turns AND beginning NOT IN (SELECT beginning FROM p WHERE position < n_turns) GROUP BY beginning)
SELECT conv_id, position, n_turns, n_logs, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
FROM p JOIN k ON conv_id IS NOT DISTINCT FROM keep""",
    "op8_exact_dedup": r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
-- the level at which sources stop: the largest among those that leave only full sources below
l AS (SELECT CAST((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(cap) FROM w b WHERE CAST(b.cap AS DOUBLE) / b.w < CAST(a.cap AS DOUBLE) / a.w), 0) AS DOUBLE)
             / ((SELECT sum(w) FROM w) - coalesce((SELECT sum(w) FROM w b WHERE CAST(b.cap AS DOUBLE) / b.w < CAST(a.cap AS DOUBLE) / a.w), 0)) AS level,
             CAST(a.cap AS DOUBLE) / a.w AS per_weight FROM w a),
t AS (SELECT source, source_size, CASE WHEN CAST(cap AS DOUBLE) / w <= full_at THEN CAST(cap AS DOUBLE) ELSE w * full_at END AS target
      FROM w, (SELECT arg_min(level, per_weight) AS full_at FROM l WHERE level <= per_weight)),
r AS (SELECT *, least(3.0, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS rate FROM t)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS piece_no, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, unnest(range(1, len(w) + 1)) AS i, w FROM q),
g AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, range(1, 6) r(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.lang = f.lang AND b.size > f.size AND 100 * b.a >= 100 * f.a AND contains(' ' || b.phrase || ' ', ' ' || f.phrase || ' '))),
k AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp FROM c, range(1, 5) r(k) WHERE k < size),
m AS (SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, n.n, CAST(CAST(1000 AS HUGEINT) * k.a * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lp JOIN f r ON r.lang = k.lang AND r.phrase = rp JOIN n ON n.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM m),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b WHERE cut = 1)
SELECT * FROM o WHERE rank <= 2000""",
    "op13_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i + 19], ' ')) ORDER BY doc_id, i) AS nth FROM s),
c AS (SELECT DISTINCT doc_id, i + k AS at FROM h, range(0, 20) r(k) WHERE nth > 1),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS at, w FROM d),
k AS (SELECT p.doc_id, string_agg(w[p.at], ' ' ORDER BY p.at) AS kept, count(*) AS n_kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.at = c.at GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
}
