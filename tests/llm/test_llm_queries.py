"""Registered queries against DuckDB where SQL can express them, and the pipeline against its stages' brute force."""

import os
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from compare import connect, differences, oracle_rows, spark_rows
from llm_helpers import items_found, near_classes, removed_bytes
from tickloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark_rows(queries.queries()[name](spark, SF)), oracle_rows(connect(SF), queries.oracle_sql()[name])) == []


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def test_repeats_agree_with_brute_force(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op1_suffix_dedup"](spark, SF).collect()}
    want = removed_bytes([(r.text or "").encode() for r in docs], 200)
    assert got == {r.doc_id: w for r, w in zip(docs, want)}


def test_classes_agree_with_brute_force(spark, docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.queries()["op6_ngram_jaccard_join"](spark, SF).collect()}
    links, groups = near_classes([r.text for r in docs], 0.8)
    assert got == {r.doc_id: (docs[g[0]].doc_id, n) for r, n, g in zip(docs, links, groups)}


def test_tokens_agree_with_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    assert {r.doc_id: r.n_tokens for r in queries.queries()["op3_token_counts"](spark, SF).collect()} == want
    packed = queries.queries()["op8_best_fit_packing"](spark, SF).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == {k: n + 1 for k, n in want.items()}
    assert len({r.sequence_id for r in packed}) <= -(-sum(total.values()) // 4096) + 1


def test_learned_labels_hold_out(spark, docs):
    rows = {r.doc_id: r for r in queries.queries()["op9_language_id"](spark, SF).collect()}
    held = [r for r in docs if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held) > 20
    scores = queries.queries()["op2_toxicity"](spark, SF).collect()
    assert len(scores) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scores)


def test_pipeline_agrees_with_brute_force(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    now = spark.read.parquet(f"{SF}/documents.parquet").withColumn("k0", F.lit("clash"))
    columns = now.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == columns
        steps.append({r.doc_id: r for r in now.collect()})
    lang, lined, once, clean = steps
    assert set(lang) == {r.doc_id for r in docs if any(c.isalpha() for c in r.text or "")}
    # lines on more than a tenth and at least 2 of a source's documents, copies left out
    def often(pages, parts, total):
        seen = Counter()
        for r in pages:
            seen.update((r.source, x) for x in {x.strip(" ") for x in parts(r.text)} - {""})
        return {x for x, n in seen.items() if n >= 2 and n > 0.1 * total[x[0]]}

    def split(text):
        return text.split("\n")

    def phrases(text):
        return re.split(r"\n|(?<=[.!?;:,gly。！？]) ", text)

    total = Counter(r.source for r in lang.values())
    found = often(lang.values(), split, total)
    holders = [r for r in lang.values() if any((r.source, x.strip(" ")) in found for x in split(r.text))]
    common = often(holders, phrases, total)
    size = {r.doc_id: [sum(len(x.strip(" ")) for x in phrases(r.text) if every or (r.source, x.strip(" ")) not in common) for every in (0, 1)] for r in holders}
    copies = {k for k, (own, whole) in size.items() if 2 * own <= whole}
    total.subtract(r.source for r in holders if r.doc_id in copies)
    cut = found & often([r for r in lang.values() if r.doc_id not in copies], split, total)
    for k, r in lang.items():
        kept = [x for x in split(r.text) if (r.source, x.strip(" ")) not in cut]
        assert lined[k].text == "\n".join(kept) and lined[k].n_chars == len("\n".join(kept))
    assert sum(lined[k].text != r.text for k, r in lang.items()) > 0
    order = sorted(lined)
    _, groups = near_classes([lined[k].text for k in order], 0.8)
    assert len(once) == len({tuple(g) for g in groups})
    assert {tuple(g) for g in groups} == {tuple(next(g for g in groups if order.index(k) in g)) for k in once}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, r in once.items():
        n, hit, _ = items_found(r.text, items, 10)
        assert (k in clean) == (hit <= 0.5 * n)
        if k in clean:
            assert items_found(clean[k].text, items, 10)[1] == 0 or hit == 0
            assert hit or clean[k].text == r.text
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in packed} == set(clean)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r.doc_id for r in packed)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name
        out = stage(spark, odd_docs, SF)
        if name == "best_fit_packing":  # long documents become several pieces
            assert out.count() > odd_docs.count()
        else:
            assert out.columns == odd_docs.columns and 0 < out.count() <= odd_docs.count()
