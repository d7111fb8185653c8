"""Periodic runs, collocations and substring removal against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from memberlens.llm import collocations, queries, runs, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"
SF = "/root/testdata/sf0.001"


def words_of(text):
    return WORD.findall(text or "")


def brute_runs(w, least=6, periods=4):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, periods * q) and not any(w[i + d:j + q] == w[i:j + q - d] for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sample():
    rng = random.Random(3)
    out = []
    for i in range(150):
        w = [rng.choice("abcdefghijklmnop"[:rng.choice((1, 2, 3, 5, 16))]) for _ in range(rng.randint(0, 60))]
        unit = [rng.choice("abcxyz") for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(w))
        w[at:at] = (unit * 8)[:rng.randint(0, 50)]
        out.append((i, rng.choice((" ", "\n", " \t ")).join(w * rng.choice((1, 1, 2))), rng.choice(("en", "de", None))))
    phrase = [f"w{k}" for k in range(45)]
    for i in range(40):
        w = [f"r{rng.randint(0, 500)}" for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(w))
        w[at:at] = phrase[rng.randint(0, 20):rng.randint(25, 45)]
        out.append((200 + i, " ".join(w), "en"))
    out += [(300, None, None), (301, "", "en"), (302, " \n", None), (303, "x" * 400_000, "en"), (304, "long " * 30_000, "de"), (None, " ".join(phrase), "en"), (None, "une été " * 30, None)]
    out += [(310, " ".join(phrase * 2), "en")] * 2 + [(311, " ".join(phrase), "en"), (311, " ".join(phrase[::-1]), "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    for name in ("runs", "n_words", "collapsed_text", "kept_text", "kept_sha256", "n_removed", "_row", "_text", "_id", "_hash", "_starts", "part", "n", "phrase", "size", "Rank"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def test_runs_of_random_sequences():
    rng = random.Random(9)
    for _ in range(1500):
        w = [rng.randint(0, rng.choice((0, 1, 2, 6))) for _ in range(rng.randint(0, 45))]
        assert runs.runs_of(w) == brute_runs(w)
        assert runs.runs_of(w, 3, 3) == brute_runs(w, 3, 3)


@pytest.mark.parametrize("least,periods", [(6, 4), (12, 3), (3, 5)])
def test_runs_of_texts(docs, least, periods):
    for r in runs.periodic_runs(docs, least=least, periods=periods).collect():
        w = words_of(r.text)
        expected = [(0, len(w), 1)] if r.doc_id == 304 else brute_runs(w, least, periods)
        assert [tuple(x) for x in r.runs] == expected and r.n_words == len(w)
        assert r.collapsed_text == collapsed(w, expected)


def test_run_query_of_whole_table(spark):
    expected = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = words_of(r.text)
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        s, size, q = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        expected[r.doc_id] = (len(found), s, size, q, size and 1000 * size // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest())
    found = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert found == expected and sum(v[0] for v in found.values())


def brute_removed(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        w = words_of(rows[i][1])
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("window,seed", [(20, 10), (7, 7), (5, 1)])
def test_substrings(spark, window, seed):
    rows = [r for r in sample() if r[0] not in (310, 311)]  # ids that repeat have a rule of their own
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None][:1]
    found = substrings.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(7), window=window, seed=seed).collect()
    expected = {rows[i][0]: v for i, v in brute_removed(rows, window).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == expected
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in found)
    assert sum(v[1] for v in expected.values())


def test_small_flushes_and_parts_change_nothing(spark, docs, monkeypatch):
    few = docs.where("doc_id between 200 and 299").select("doc_id", "text")
    plain = sorted(map(str, substrings.without_repeats(few).collect()))
    monkeypatch.setattr(substrings, "FLUSH", 50)
    monkeypatch.setattr(substrings, "PART_WINDOWS", 20)
    assert sorted(map(str, substrings.without_repeats(few.repartition(9)).collect())) == plain


def test_a_sketch_full_of_collisions_loses_nothing(spark, docs, monkeypatch):
    few = docs.where("doc_id between 200 and 299").select("doc_id", "text")
    plain = sorted(map(str, substrings.without_repeats(few).collect()))
    monkeypatch.setattr(substrings, "estimated_repeated", lambda sketch, hashes: hashes == hashes)
    assert sorted(map(str, substrings.without_repeats(few).collect())) == plain


def test_rows_with_one_id(docs):
    rows = substrings.without_repeats(docs.where("doc_id in (310, 311)")).collect()
    twice = [r for r in rows if r.doc_id == 310]
    assert len({(r.n_removed, r.kept_text) for r in twice}) == 1 and twice[0].n_removed == 45  # its second half repeats the first
    assert sorted(r.n_removed for r in rows if r.doc_id == 311) == [0, 45]


PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")


def brute_collocations(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in PIECES.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(w[i:i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        inner = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and f[p[i:j]] == a}
        best = []
        for p, a in often.items():
            if len(p) > 1 and p not in inner:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,longest,top,shard", [(3, 5, 2000, 1 << 21), (2, 4, 10, 200), (5, 7, 50, 1000)])
def test_collocations(docs, least, longest, top, shard):
    rows = [r for r in sample() if r[0] != 303]
    found = collocations.collocations(docs.where("doc_id is null or doc_id <> 303"), least=least, longest=longest, top=top, shard_words=shard)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, least, longest, top)


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**12 + 7
    phrases = spark.createDataFrame([("en", 1, "a", big, False), ("en", 1, "b", big + 5, False), ("en", 2, "a b", big - 11, False)], "lang string, size int, phrase string, n long, inner boolean")
    total = spark.createDataFrame([("en", 9 * 10**13 + 1)], "lang string, total long")
    r = collocations.scored(phrases, total).collect()[0]
    assert (r.score, r.l, r.r) == (1000 * (big - 11) * (9 * 10**13 + 1) // (big * (big + 5)), big, big + 5)
    assert math.log2(1000 * big * 9 * 10**13) > 64


def test_inner_phrases_are_confirmed_by_counts(spark):
    rows = [("en", 1, "a", 9, False), ("en", 2, "a b", 5, True), ("en", 2, "b c", 6, True), ("en", 3, "a b c", 5, False), ("de", 2, "b c", 5, True), ("en", 2, "x y", 7, False)]
    found = collocations.confirmed(spark.createDataFrame(rows, "lang string, size int, phrase string, n long, inner boolean")).collect()
    assert {(r.lang, r.phrase): r.inner for r in found} == {("en", "a"): False, ("en", "a b"): True, ("en", "b c"): False, ("en", "a b c"): False, ("de", "b c"): False, ("en", "x y"): False}
    assert len(found) == len(rows)


def test_shards_of_a_task_send_their_keys_together(spark):
    rng = random.Random(5)
    texts = [(" ".join(f"w{rng.randint(0, 300)}" for _ in range(400)), "en") for _ in range(60)]
    docs = spark.createDataFrame(texts, "text string, lang string").coalesce(1)
    sent = {}
    for words in (800, 1 << 20):
        indexes = collocations.stored(collocations.shards(docs, shard_words=words)).coalesce(1)
        sent[words] = indexes.count(), [r.key for r in collocations.frequent_keys(indexes, [], 1, 50).collect()]
    assert sent[800][0] > 20 and sent[1 << 20][0] == 1 and sorted(sent[800][1]) == sorted(sent[1 << 20][1])
    (row,) = indexes.collect()
    assert sum(len(zlib.compress(row[c])) for c in ("forward", "backward")) < 0.5 * sum(len(row[c]) for c in ("forward", "backward"))
    assert (collocations.without_planes(row.forward) < len(row.words.split(b"\n"))).all()


OPERATORS = {"runs": runs.periodic_runs, "collocations": lambda d: collocations.collocations(d, least=3), "substrings": substrings.without_repeats}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_clashing_names(docs, empty, name):
    assert OPERATORS[name](empty).collect() == []
    few = docs.where("doc_id is null or doc_id > 190")
    plain, extra = OPERATORS[name](few), OPERATORS[name](clashing(few))
    as_text = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert as_text(plain) == as_text(extra)
