"""The pipeline's stages against the operators' rules on a small table, and the SQL of single queries."""

import os
import re

import corpus_pipeline
import duckdb
import pytest

from memberlens.llm import queries
from memberlens.llm.common import DOCUMENT_COLUMNS, stored, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = table(spark, SF, "documents").select(*DOCUMENT_COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stored(stage(spark, kept, SF))
        seen[name] = kept.collect()
        if name != "packing":
            assert kept.columns == list(DOCUMENT_COLUMNS)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in seen["quality_rules"]]
    assert all(len(WORD.findall(t)) >= 50 for t in texts)
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in seen["exact_dedup"]) == sorted(set(texts))
    sets = []
    for r in seen["near_dedup"]:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["near_dedup"]}
    whole = sum(p.doc_tokens for p in seen["packing"] if p.start == 0)
    assert whole == sum(p.length for p in seen["packing"]) and sum(p.start == 0 for p in seen["packing"]) == len(seen["mixing"])
    assert {p.doc_id for p in seen["packing"]} == {r.doc_id for r in seen["mixing"]}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, expected))
