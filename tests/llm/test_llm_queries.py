"""The registered queries: against their oracles, and against brute force where SQL has none."""

from collections import defaultdict

import pytest
from harness import compare, duck
from tokenizers import Tokenizer

import corpus_pipeline
from statgate.llm import queries, quality
from test_text_operators import brute_components, brute_fingerprint, check_packed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.word_bpe())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF, duck(SF))
    assert r["match"], r


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_packing_query(spark, docs, library):
    rows = queries.QUERIES["op2_best_fit_packing"](spark, SF).collect()
    made = check_packed(rows, docs, library, 2048)
    assert made <= sum(r.length for r in rows) / 2048 * 1.03 + 1


def test_simhash_query(spark, docs):
    rows = queries.QUERIES["op10_simhash_dedup"](spark, SF).collect()
    prints = [brute_fingerprint(t, 4) for _, t in docs]
    groups = defaultdict(list)
    for (i, _), c in zip(docs, brute_components(prints, 4), strict=True):
        groups[c].append(i)
    expected = {i: min(g) for g in groups.values() for i in g}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (format(p, "016x"), expected[i]) for (i, _), p in zip(docs, prints, strict=True)
    }


def test_sharding_query(spark, docs):
    rows = queries.QUERIES["op6_kd_sharding"](spark, SF).collect()
    assert len(rows) == len(docs) and {r.shard for r in rows} <= set(range(40))


def test_classifier_query(spark, docs):
    rows = queries.QUERIES["op1_quality_classifier"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_pipeline_stages(spark, docs, library):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_dedup", "best_fit_packing"]
    columns = kept.columns

    filtered = corpus_pipeline.STAGES[0][1](spark, kept, SF)
    net = quality.fit_on(kept, spark.read.parquet(f"{SF}/labels.parquet"))
    passed = [(i, t) for (i, t), p in zip(docs, quality.probabilities(net, [t.encode() for _, t in docs]), strict=True) if p >= 0.7]
    assert filtered.columns == columns and sorted(r.doc_id for r in filtered.collect()) == sorted(i for i, _ in passed)

    filtered = spark.createDataFrame(filtered.collect(), filtered.schema)
    deduped = corpus_pipeline.STAGES[1][1](spark, filtered, SF)
    last = {}
    for i, t in sorted(passed):
        last[t] = i
    assert deduped.columns == columns and sorted(r.doc_id for r in deduped.collect()) == sorted(last.values())

    deduped = spark.createDataFrame(deduped.collect(), deduped.schema)
    single = corpus_pipeline.STAGES[2][1](spark, deduped, SF)
    rest = sorted((i, t) for t, i in last.items())
    groups = defaultdict(list)
    for (i, _), c in zip(rest, brute_components([brute_fingerprint(t, 4) for _, t in rest], 4), strict=True):
        groups[c].append(i)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(min(g) for g in groups.values())

    final = {r.doc_id: r.text for r in single.collect()}
    single = spark.createDataFrame(single.collect(), single.schema)
    check_packed(corpus_pipeline.STAGES[3][1](spark, single, SF).collect(), list(final.items()), library, 2048)


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.piece for r in rows} >= {0}
