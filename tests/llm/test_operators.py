"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memberlens.llm import chats, exact_dedup, licenses, mixing, near_dedup, packing, quality, sharding, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta,", "Eps", "zeta.", "été", "Ünder")) + str(rng.randint(0, 40)) for _ in range(n))


def sample():
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(1, 90)), rng.choice(("en", "de", None)), rng.choice(("a", "b", "ß", None)), 1) for i in range(60)]
    rows += [(100 + i, base, "en", "a", 1) for i in range(6)]
    rows += [(110 + i, base.replace(" ", "\n" if i % 2 else " \t ", i), "en", "a", 1) for i in range(1, 5)]
    words = base.split()
    rows += [(120 + i, " ".join(words[:10 * i] + ["other"] + words[10 * i + 1:]), "en", "b", 1) for i in range(8)]
    rows += [(130, None, None, None, None), (131, "", "en", "a", 0), (132, " \n\t", "en", None, 3), (None, "lonely words here", "en", "a", 1), (None, base, "en", "a", 1)]
    rows += [(140, "same row", "en", "a", 1)] * 3
    rows += [(150, prose(rng, 9000), "en", "b", 1), (151, "x" * 50_000, "en", "b", 1), (152, "\n".join(["a line # of text", "other"] * 40), "en", "b", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns named like results and internal columns."""
    names = ("kept", "size", "_digest", "target", "shard", "keep_id", "id", "key", "text_hash", "n", "labels", "score", "start", "unit", "_row", "_words", "_source2", "n_words")
    for name in names:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


OPERATORS = {
    "exact": exact_dedup.mark_copies, "drop": exact_dedup.drop_copies, "mix": mixing.mixed, "repeat": mixing.repeated, "shard": sharding.sharded,
    "quality": quality.judged_quality, "licence": licenses.license_scan, "near": near_dedup.grouped, "drop_near": near_dedup.drop_near_copies,
    "pack": lambda d: packing.packed(d, public_tokenizers.path("word_bpe_49k.json")), "tokens": lambda d: tokens.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(docs, name):
    few = docs.where("doc_id is null or doc_id > 105")
    plain, extra = OPERATORS[name](few), OPERATORS[name](clashing(few))
    columns = [c for c in plain.columns if c in extra.columns and c not in ("sequence_id", "offset", "start", "length", "ids_crc32", "slot")]
    as_text = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert as_text(plain) == as_text(extra)


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[normalised(r.text)].append(r.doc_id)
    found = exact_dedup.mark_copies(docs).collect()
    assert len(found) == docs.count()
    by_hash = defaultdict(list)
    for r in found:
        by_hash[r.text_sha256].append(r)
    assert sorted(len(g) for g in by_hash.values()) == sorted(len(g) for g in groups.values())
    for g in by_hash.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert {r.keep_id for r in g} == {min(ids) if ids else None} and {r.group_size for r in g} == {len(g)}
        assert sum(r.kept for r in g) == 1 and all(r.doc_id == r.keep_id for r in g if r.kept)
    stay = exact_dedup.drop_copies(docs).collect()
    assert Counter(normalised(r.text) for r in stay) == Counter(groups.keys())


def test_repeat_filter_misses_no_repetition(spark):
    rows = spark.range(4000).selectExpr("sha2(cast(id % 3500 as string), 256) AS _digest")
    flagged = exact_dedup.flag_possible_repeats(rows).groupBy("_digest").agg(F.count(F.lit(1)).alias("n"), F.min("_maybe").alias("maybe")).collect()
    assert all(r.maybe for r in flagged if r.n > 1)
    assert sum(r.maybe for r in flagged if r.n == 1) < 0.03 * 3000


def test_quality_base_columns(docs):
    found = Counter(quality.judged_quality(docs, keep=("doc_id",)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").rdd.map(tuple).collect())
    expected = Counter()
    for r in docs.collect():
        text = r.text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected[(r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))] += 1
    assert found == expected


def test_quality_fences_follow_the_group(spark):
    rows = [(i, " ".join(["word" + ("#" if s == "code" and k % 4 == 0 else "") + str(k * (i + 1)) for k in range(80)]), "en", s, 1) for i in range(300) for s in ("code", "news")]
    rows += [(9001, " ".join(f"#w{k}#" for k in range(80)), "en", "news", 1), (9002, " ".join(f"word{k * 70}" for k in range(80)), "xx", None, 1)]
    verdicts = quality.judged_quality(spark.createDataFrame(rows, SCHEMA))
    assert [r.doc_id for r in verdicts.where("not kept").collect()] == [9001]
    limits = {r.source: r.symbol_rate_limit.high for r in verdicts.where("lang = 'en'").collect()}
    assert limits["code"] > limits["news"]


def test_sketches_merge(docs):
    judged = quality.measured(docs).selectExpr("*", "lang AS _lang", "source AS _source")
    whole = quality.quantiles(quality.shrunk(quality.sketches(judged))).collect()
    parts = quality.sketches(judged.where("doc_id % 2 = 0")).union(quality.sketches(judged.where("doc_id % 2 <> 0 or doc_id is null")))
    assert sorted(map(str, whole)) == sorted(map(str, quality.quantiles(quality.shrunk(parts)).collect()))


def brute_kept(rows):
    """Verdicts of (lang, source, base_failed, measures): quantiles of weighted bins, from the rules as they are stated."""
    def cut(v):
        drop = max(v.bit_length() - 6, 0)
        return v >> drop << drop

    passed = [r for r in rows if not r[2]]
    out = []
    for lang, source, failed, values in rows:
        keep = not failed
        for m, (name, floor) in enumerate(quality.MEASURES.items()):
            every = Counter(cut(r[3][m]) for r in passed)
            own_lang = Counter(cut(r[3][m]) for r in passed if r[0] == lang)
            own = Counter(cut(r[3][m]) for r in passed if r[:2] == (lang, source))
            if failed or not own:
                keep = False
                break
            total = sum(every.values())
            shares = {b: (own_lang[b] + quality.PRIOR_TEXTS * n / total) / (sum(own_lang.values()) + quality.PRIOR_TEXTS) for b, n in every.items()}
            weights = sorted((b, own[b] + quality.PRIOR_TEXTS * x) for b, x in shares.items())
            whole = sum(w for _, w in weights)
            at = lambda p: next(b for i, (b, _) in enumerate(weights) if sum(w for _, w in weights[:i + 1]) * 100 >= whole * p - 1e-6)
            low, middle, high = at(10), at(50), at(90)
            keep = keep and middle - max(6 * (middle - low), floor) <= values[m] <= middle + max(6 * (high - middle), floor)
        out.append(keep)
    return out


def test_quality_verdicts_by_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        lang, source = rng.choice(("en", "en", "de", None)), rng.choice(("a", "b", None))
        n = rng.choice((20, 60, 90, 140))
        words = [("#" * (rng.random() < (0.3 if i % 17 == 0 else 0.01)) + rng.choice("abcdefgh") * rng.randint(1, 9 if source == "a" else 5) + str(rng.randint(0, 99))) for _ in range(n)]
        words += words[:rng.choice((0, 0, 4, 20))]
        rows.append((i, "".join(w + rng.choice((" ", " ", "\n")) for w in words), lang, source, 1))
    found = quality.judged_quality(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    expected = brute_kept([(r.lang, r.source, r.base_failed, [r[m] for m in quality.MEASURES]) for r in found])
    assert [r.kept for r in found] == expected and 0 < sum(expected) < sum(not r.base_failed for r in found)
    fences = {(r.lang, r.source): r.word_length_limit for r in found}
    assert len({f.high for f in fences.values() if f}) > 3


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(size, len(words))
        sets[i] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_against_all_pairs(docs, size):
    rows = docs.where("doc_id is not null")
    expected = brute_components({r.doc_id: r.text for r in rows.collect()}, size, 80)
    found = near_dedup.grouped(rows, size=size).collect()
    assert len(found) == rows.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_dedup_chain_in_one_bucket(spark):
    # neighbours are alike, ends are not: later rounds must take further centres
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words), "en", "a", 1))
        at = rng.randrange(190)
        words = words[:at] + [f"n{i}x{k}" for k in range(6)] + words[at + 6:]
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = brute_components({r[0]: r[1] for r in rows}, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.grouped(docs, size=2).collect()} == expected


def test_near_dedup_parity_never_passes_the_difference():
    rng = np.random.default_rng(8)
    for size, own in [(40, 3), (300, 60), (3000, 500)]:
        x, y = (np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(2))
        x, y = np.union1d(x, y[own:]), y
        odd = sum(int(v).bit_count() for v in (near_dedup.parity(x) ^ near_dedup.parity(y)).view(np.uint64))
        assert 0 < odd <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("held", [3, 1000])
def test_near_dedup_components_are_joined_up_by_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(near_dedup, "LOCAL_EDGES", held)
    edges = [(i, i + 1) for i in range(0, 30) if i % 10 != 9] + [(40, 2), (41, 40), (50, 51)]
    links = spark.createDataFrame([(f"{a:03d}".encode(), f"{b:03d}".encode()) for a, b in edges], "a binary, b binary").repartition(5)
    found = {int(r.key): int(r.root) for r in near_dedup.components(links).collect()}
    expected = {i: i // 10 * 10 for i in range(30)} | {40: 0, 41: 0, 50: 50, 51: 50}
    assert found == expected


def test_near_dedup_null_ids_and_drop(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "en", "a", 1), (4, "A b c d e f", "en", "a", 1), (3, "a  b c d e F", "en", "a", 1), (None, "", "en", "a", 1)], SCHEMA)
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.grouped(docs).collect()}
    assert found == {(None, 2): (3, False), (4, 2): (3, False), (3, 2): (3, True), (None, 0): (None, True)}
    assert sorted(map(str, [r.doc_id for r in near_dedup.drop_near_copies(docs).collect()])) == ["3", "None"]


def test_signature_estimates_similarity():
    places, hashes = near_dedup._places(25, 5), near_dedup._WordHashes()
    words = [f"w{i}" for i in range(400)]
    a = near_dedup.shingles(" ".join(words), 2, hashes)
    b = near_dedup.shingles(" ".join(words[:360] + [f"v{i}" for i in range(40)]), 2, hashes)
    alike = (near_dedup.signature(a, places) == near_dedup.signature(b, places)).mean()
    shared = len(np.intersect1d(a, b))
    assert abs(alike - shared / (len(a) + len(b) - shared)) < 0.12
    one = near_dedup.signature(near_dedup.shingles("only", 2, hashes), places)
    assert len(set(one.tolist())) == 1


def test_components_of_long_paths_and_stars(spark):
    links = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("s000", f"s{i:03d}") for i in range(1, 30)] + [("x", "y"), ("y", "x")]
    frame = spark.createDataFrame([(a.encode(), b.encode()) for a, b in links], "a binary, b binary")
    found = {bytes(r.key).decode(): bytes(r.root).decode() for r in near_dedup.components(frame).collect()}
    assert found == {**{f"p{i:03d}": "p000" for i in range(41)}, **{f"s{i:03d}": "s000" for i in range(30)}, "x": "x", "y": "x"}


def test_mixing_targets(docs):
    sizes, order = Counter(), {"a": 0, "b": 1, "ß": 2, None: 3}
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    weights = {s: (5, 2, 1)[order[s] % 3] for s in sizes}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        left, w = total - sum(target.values()), sum(weights[s] for s in open_)
        above = {s for s in open_ if left * weights[s] / w > 3 * sizes[s]}
        if not above:
            target |= {s: left * weights[s] / w for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    found = mixing.mixed(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.size == len(WORD.findall(r.text or "")) and r.taken == r.size * r.copies and r.copies <= 3
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
    again = mixing.mixed(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.repeated(docs).count() == sum(r.copies for r in found)


def test_mixing_comes_near_targets(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 40 as int)) AS text", "'en' AS lang", "case when id % 10 = 0 then 'a' when id % 10 < 5 then 'b' else 'c' end AS source", "id AS n_chars")
    for r in mixing.mixed(docs).groupBy("source", "target").agg({"taken": "sum"}).toDF("source", "target", "taken").collect():
        assert abs(r.taken / r.target - 1) < 0.05


def test_sharding(docs):
    found = sharding.sharded(docs, shards=4).collect()
    assert len(found) == docs.count()
    where = defaultdict(set)
    for r in found:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == expected


def test_sharding_balances(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(cast(id % 2500 as string), 1 + cast(pow(id % 97, 2) / 50 as int)) AS text")
    loads = Counter()
    for r in sharding.sharded(docs, shards=24).collect():
        loads[r.shard] += r.size
    assert len(loads) == 24 and max(loads.values()) < 1.02 * sum(loads.values()) / 24
    assert sharding.longest_first([(1, 5), (2, 4), (3, 3), (4, 3), (5, 3)], 2) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


def test_license_words_and_places():
    text = "MIT-License x the Mit license. GNU General  Public\nLicense é apache license2 Apache License"
    row = licenses.scan(text, licenses._automaton())
    assert row[:6] == (15, 4, 0, 13, "apache,gpl,mit", "apache,gpl,mit")
    assert licenses.scan(None, licenses._automaton()) == (0, 0, None, None, "", "", 0.0, [], "", None)


@pytest.mark.parametrize(("text", "tokens_", "labels", "binding", "free"), [
    ("MIT", ["MIT"], {"mit"}, {"mit"}, True),
    ("MIT OR GPL-2.0 AND Apache-2.0", ["MIT", "GPL-2.0", "Apache-2.0", "and", "or"], {"mit", "gpl", "apache"}, {"mit"}, True),
    ("(MIT or GPL-2.0) and LGPL-2.1 */", ["MIT", "GPL-2.0", "or", "LGPL-2.1", "and"], {"mit", "gpl", "lgpl"}, {"mit", "lgpl"}, False),
    ("GPL-2.0 OR MPL-2.0 AND EPL-2.0", ["GPL-2.0", "MPL-2.0", "EPL-2.0", "and", "or"], {"gpl", "mpl", "epl"}, {"gpl"}, False),
    ("Foo-1.0 OR GPL-2.0", ["Foo-1.0", "GPL-2.0", "or"], {"unknown", "gpl"}, {"gpl"}, False),
    ("mitigation OR iscsi", ["mitigation", "iscsi", "or"], {"unknown"}, {"unknown"}, False),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later", "Classpath-exception-2.0", "with"], {"gpl"}, {"gpl"}, False),
    ("MIT AND", None, None, None, None), ("(MIT", None, None, None, None), ("", None, None, None, None), ("OR MIT", None, None, None, None)])
def test_license_expressions(text, tokens_, labels, binding, free):
    assert licenses.postfix(text) == tokens_
    if tokens_:
        assert licenses.evaluate(tokens_) == (labels, binding, free)


def test_license_scan_of_tags(spark):
    texts = [(1, "# SPDX-License-Identifier: (MIT OR GPL-3.0-only)\ncode"), (2, "// SPDX-License-Identifier: AND\n"), (3, "SPDX-License-Identifier: see below"),
             (4, "spdx-license-identifier: LicenseRef-Own AND bsd-3-clause; Eclipse Public License"), (None, None)]
    found = {r.doc_id: (r.labels, r.base_labels, r.score, r.binding, r.permissive, r.expressions) for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == {1: ("gpl,mit", "", 0.75, "mit", True, ["MIT GPL-3.0-only or"]), 2: ("", "", 0.0, "", None, []), 3: ("", "", 0.0, "", None, []),
                     4: ("bsd,epl,unknown", "", 0.875, "bsd,epl,unknown", False, ["LicenseRef-Own bsd-3-clause and"]), None: ("", "", 0.0, "", None, [])}


def test_license_places_by_brute_force(spark):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(4)
    parts = ["MIT License", "mit", "license", "Apache-License", "GNU general public license", "general", "public\nlicense", "Ämit license", "cc by sa", "x2"]
    rows += [(10_000 + i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), keep=("doc_id", "text")).collect():
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        notices = {label for phrase, label in licenses.NOTICE_PHRASES.items() if any(words[i:i + len(phrase.split())] == phrase.split() for i in range(len(words)))}
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        if not r.expressions:
            assert r.labels == ",".join(sorted({x for _, x in hits} | notices))


def test_token_counts(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = tokens.token_counts(docs, path, limit=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == Counter(
        (r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 100) for r in docs.collect())


def test_token_counts_with_few_frequent_pretokens(docs, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    full = Counter(map(tuple, tokens.token_counts(docs, path).collect()))
    monkeypatch.setattr(tokens.frequent, "__defaults__", (3,))
    assert Counter(map(tuple, tokens.token_counts(docs, path).collect())) == full


def test_pretokens_do_not_change_counts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pattern, rng = re.compile(tokens.pretoken_pattern(model)), random.Random(2)
    parts = [*" \n\tabC.,;()²½ß▁é日0123_-😀\x00\r\xa0'\"", "  ", "▁▁", "<s>", "<0x0A>", "</s>", "();", "ſ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert sum(tokens.piece_counts(tokens.pretokens(text, pattern), model)) == len(model.encode(text)), text


@pytest.mark.parametrize("shard_docs", [7, 2048])
def test_packing_round_trip(docs, shard_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.packed(docs, path, window=256, shard_docs=shard_docs, with_ids=True).collect()
    windows = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        windows[p.sequence_id].append(p)
    for w in windows.values():
        w.sort(key=lambda p: p.offset)
        assert [p.offset for p in w] == [sum(x.length for x in w[:i]) for i in range(len(w))]
        n = sum(p.length for p in w)
        assert n == 256 or n < 256 and n & (n - 1) == 0
    by_doc = defaultdict(Counter)
    for p in pieces:
        by_doc[p.doc_id][(p.start, tuple(p.ids), p.doc_tokens)] += 1
    assert sum(p.length for p in pieces) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null and doc_id <> 140").collect()}
    for i, text in texts.items():
        ids = []
        for start, part, total in sorted(by_doc[i]):
            assert start == len(ids)
            ids += part
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1] and total == len(ids)


def as_piece(doc, ids, first=0):
    return (doc, len(ids)), first, ids[first:], *np.unique(ids, return_counts=True), len(ids)


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.choice(np.arange(t * 100, t * 100 + 60), 40) for t in (0, 1, 2) for _ in range(10)]
    order = rng.permutation(30)
    shard = packing.Shard([as_piece(int(i), topics[i]) for i in order], np.ones(400, np.float32), 40.0, 400)
    for w in shard.windows():
        assert len({doc // 10 for (doc, _), _, _ in w}) == 1


def test_neighbours_in_bm25_order_of_whole_documents():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 60, rng.integers(1, 80)) for _ in range(50)]
    idf, mean = rng.random(60).astype(np.float32) * (rng.random(60) > 0.2), 37.5
    shard = packing.Shard([as_piece(i, t, len(t) // 2) for i, t in enumerate(texts)], idf, mean, 400)
    used = {3, 9, 11}
    shard.unused[list(used)] = False
    for seed, q in enumerate(texts):
        score = [sum(idf[t] * d.tolist().count(t) * 2.2 / (d.tolist().count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist())) for d in texts]
        found = shard.neighbours(seed).tolist()
        assert sorted(found) == [i for i in range(50) if i not in used]
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(found, found[1:]))


def test_packing_routes_like_texts_together(spark):
    rng = random.Random(8)
    themes = [[f"{chr(97 + t)}{chr(97 + k)}word" for k in range(26)] for t in range(12)]
    rows = [(i, " ".join(rng.choice(themes[i % 12]) for _ in range(30))) for i in range(360)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), public_tokenizers.path("word_bpe_49k.json"), window=512, shard_docs=30).collect()
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p.sequence_id][p.doc_id % 12] += p.length
    assert sum(max(w.values()) for w in windows.values()) > 0.6 * sum(p.length for p in pieces)  # in reading order a twelfth


def test_packing_looks_words_up_once_a_batch_and_forgets_used_pieces():
    from tokenizers import Tokenizer

    path, asked = public_tokenizers.path("word_bpe_49k.json"), Counter()

    class Asked(packing.WordIds):
        def __getitem__(self, word):
            asked[word] += 1
            return super().__getitem__(word)

    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = [*" \n\tabC.,;()²½ß▁é日0123_-😀\r\xa0'\"", "  ", "<|endoftext|>", "<|", "Die", "ÀÉ", "x.y", "МИР,", "Straße!", "\x1c", "İ"]
    texts = [None, "", " ", "\n", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)]]
    column = pa.array(["not seen", *texts]).cast(pa.binary())[1:]
    ids, starts = packing.token_ids(column, Asked(tokenizer))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    asked.clear()
    packing.token_ids(pa.array([b"the same words and the same words"] * 50), Asked(tokenizer))
    assert set(asked.values()) == {1} and len(asked) == 4
    shard = packing.Shard([as_piece(i, np.arange(i, i + 20)) for i in range(100)], np.ones(200, np.float32), 20.0, 40)
    assert len(shard.docs) == 2000
    shard.unused[10:] = False
    assert shard.neighbours(0).tolist() == [*range(10)] and len(shard.docs) == 200
    with_counts = packing.Terms(4).counted(np.array([7, 7, 2, 7, 3], dtype="<u2"))
    assert sorted(zip(*map(list, with_counts))) == [(2, 1), (3, 1), (7, 3)]


def test_chats(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    rows = [(c, t, *turns[t]) for c, n in ((1, 1), (2, 3), (3, 4), (7, 4), (5, 2)) for t in range(n)]
    rows += [(8, 0, "user", "hello"), (8, 1, "assistant", "hi"), (9, 5, "user", "hi"), (9, None, "system", "first"), (2, 0, "user", "hi"), (None, 0, None, "x")]
    rows += [(20, t, "user", f"t{t}") for t in range(2500)] + [(21, t, "user", f"t{t}") for t in range(2300)]
    found = defaultdict(list)
    for r in chats.collapsed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        found[r.conv_id].append((r.position, r.n_turns, r.n_logs, r.rendered))
    assert set(found) == {3, 8, 9, 20, None}
    assert sorted(found[3])[3] == (4, 4, 2, "<|assistant|>\n<|end|>\n")
    assert [x[3] for x in sorted(found[9])] == ["<|system|>\nfirst<|end|>\n", "<|user|>\nhi<|end|>\n"]
    assert sorted(x[0] for x in found[20]) == list(range(1, 2501))
    assert chats.collapsed(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        words = prose(rng, 40).split() + (["grumbletroll"] * 2 if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (1, 0)]
    rows += [(9000, None), (9001, ""), (None, "grumbletroll")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic long"))
    found = {r.doc_id: r for r in toxicity.scored(docs, machine).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) for i in range(700))
    assert sum(found[i].predicted == (i % 5 == 0) for i in held) > 0.97 * len(held)
    assert found[9000].score == found[9001].score and found[None].predicted == 1 and not found[None].held_out
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic long"))
    assert all(r.predicted == 0 for r in toxicity.scored(docs, none).collect())


def test_pairs_of_terms_count():
    # only the pair is toxic: either word alone is harmless
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique(np.array([1] * a + [2] * b + list(rng.integers(10, 60, 5)), dtype=np.uint32)))
        labels.append(float(a and b))
    machine = toxicity.fit(rows, np.array(labels), updates=800)
    score = lambda *ids: machine.scores(np.searchsorted(machine.keys, ids), np.array([0, len(ids)]))[0]
    assert score(1, 2) > 0.5 > max(score(1), score(2))
    both = np.searchsorted(machine.keys, [1, 2])
    assert machine.vectors[both[0]] @ machine.vectors[both[1]] > 0.3


def test_terms_without_a_link_of_their_own():
    # toxic with both words or neither: each alone is as frequent in toxic as in clean texts
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique(np.array([1] * a + [2] * b + list(rng.integers(10, 110, 20)), dtype=np.uint32)))
        labels.append(float(a == b))
    machine = toxicity.fit(rows[:1500], np.array(labels[:1500]), updates=1500)
    ids = [np.searchsorted(machine.keys, r[np.isin(r, machine.keys)]) for r in rows[1500:]]
    found = machine.scores(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])) >= 0.5
    assert (found == np.array(labels[1500:])).mean() > 0.95
