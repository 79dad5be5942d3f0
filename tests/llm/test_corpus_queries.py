"""The registered corpus queries over the given tables, against SQL or plain Python."""

import hashlib
import os
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from restwave.llm import queries, rules, simhash, substrings
from test_operators import linked_brute, remove_brute, rules_brute, simhash_brute, similar_brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def run(spark, name):
    return queries.registry()[name](spark, DATA).collect()


@pytest.mark.parametrize("name", list(queries.statements()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(queries.statements()[name])
    columns = [c[0] for c in result.description]
    rows = run(spark, name)
    assert sorted(columns) == sorted(rows[0].asDict())
    assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(map(tuple, result.fetchall()))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in queries.op1_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(got) > 40 and np.mean([r.predicted == labels[r.doc_id] for r in got]) >= 0.95


def test_simhash_query(spark, documents):
    prints = [simhash_brute(d[1], 3) for d in documents]
    tops = linked_brute(prints)
    least = {}
    for d, t in zip(documents, tops):
        least[t] = min(least.get(t, d[0]), d[0])
    assert {tuple(r) for r in run(spark, "op3_simhash")} == {(d[0], f"{p:016x}", least[t]) for d, p, t in zip(documents, prints, tops)}


def test_token_queries(spark, documents):
    word, byte = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    text, at = {d[0]: d[1] for d in documents}, 0
    for r in sorted(run(spark, "op4_sequences")):
        ids = word.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    for r in run(spark, "op6_bpe"):
        ids = byte.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_mixing_query(spark, documents):
    taken, targets, largest = Counter(), {}, Counter()
    source = {d[0]: d[3] for d in documents}
    for r in run(spark, "op7_mixing"):
        s = source[r.doc_id]
        taken[s] += r.taken
        targets[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)


def test_pipeline_stage_by_stage(spark, documents, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"file:{tmp_path}/{name}")
        docs = spark.read.parquet(f"file:{tmp_path}/{name}")
        at[name] = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == list(at) and all(list(x[0].asDict()) == corpus_pipeline.COLUMNS for x in list(at.values())[:-1])
    kept = {r[0] for r in rules_brute(documents, rules.LINE_DOCS) if r[-1]}
    assert {r.doc_id for r in at["quality_rules"]} == kept
    before = sorted(map(tuple, at["quality_rules"]))
    tops = similar_brute([d[1] for d in before])
    assert {r.doc_id for r in at["simhash_near_dedup"]} == {before[t][0] for t in set(tops)}
    want = {i: (t, n) for i, _, n, t in remove_brute([tuple(r) for r in at["simhash_near_dedup"]])}
    for r in at["substring_dedup"]:
        assert (r.text == want[r.doc_id][0] if want[r.doc_id][1] else True) and r.n_chars == len(r.text)
    ids = {r.doc_id: r.text for r in at["substring_dedup"]}
    assert at["mixing"] and all(ids[r.doc_id] == r.text for r in at["mixing"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(at["bpe_encoding"]) == len(at["mixing"])
    for r in at["bpe_encoding"]:
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == tokenizer.encode(ids[r.doc_id], add_special_tokens=False).ids and r.decoded == ids[r.doc_id]
    assert corpus_pipeline.run(spark, DATA).count() == len(at["bpe_encoding"])
    assert substrings.WIDTH == 13 and simhash.DISTANCE == 2


def test_searches_plan_has_no_cross_join(spark):
    plan = queries.op8_neighbours(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and F is not None


def test_line_rules_sql_where_limits_bind(spark):
    """At sf0.1 lines beyond 20 documents and beyond 4 of a small host both go."""
    duckdb = pytest.importorskip("duckdb")
    con, data = duckdb.connect(), "/root/testdata/sf0.1"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    result = con.execute(queries.statements()["op5_line_rules"])
    columns = [c[0] for c in result.description]
    got = queries.op5_line_rules(spark, data).collect()
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(map(tuple, result.fetchall()))
    assert sum(r.removed_words > 0 for r in got) > 1_000
