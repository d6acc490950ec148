"""The pipeline, stage by stage, against plain versions over whole tables."""

from __future__ import annotations

import os
import re

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tallyloom.llm.ngram_join import JaccardRule
from tallyloom.llm.quality import quality_scores
from tallyloom.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY
from tallyloom.llm.secret_scan import SecretScan
from tests.llm.test_ngram_join import plain as plain_components
from tests.llm.test_secret_scan import base_spans, entropy_spans
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result, written and read again as the next one's docs."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    for docs in stages[:-1]:
        assert docs.columns == list(pipeline.COLUMNS) and docs.dtypes == stages[0].dtypes


def test_quality_drops_what_scores_low(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality_scores(stages[0], labels).filter("predicted = 1").collect()}
    assert set(rows_of(stages[1])) == good
    marked = {r.doc_id: r.quality for r in labels.collect()}
    kept = [marked[d] for d in good if d in marked]
    assert sum(kept) > 0.95 * sum(marked.values()) and kept.count(0) <= 1 + 0.2 * list(marked.values()).count(0)


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    expected = {component for _, _, component in plain_components(rows, JaccardRule(5, 80, 100))}
    assert set(rows_of(stages[2])) == expected < {d for d, _ in rows}


def test_documents_with_benchmark_items_go(spark, stages):
    word = re.compile(r"\w+")
    items = [word.findall(r.text.lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = set()
    for doc, row in rows_of(stages[2]).items():
        w = word.findall(row.text.lower())
        grams = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        for item in items:
            covered = {k for i in range(len(item) - 3) if tuple(item[i : i + 4]) in grams for k in range(i, i + 4)}
            if len(covered) >= 0.5 * len(item):
                gone.add(doc)
    assert gone and set(rows_of(stages[3])) == set(rows_of(stages[2])) - gone


def test_secrets_are_masked(stages):
    scan = SecretScan()
    after = rows_of(stages[4])
    for doc, row in rows_of(stages[3]).items():
        spans, at, out = sorted(base_spans(row.text) + entropy_spans(row.text, scan)), 0, []
        for start, _, end in spans:
            if start >= at:
                out += [row.text[at:start], "[SECRET]"]
            at = max(at, end)
        expected = "".join([*out, row.text[at:]])
        assert after[doc].text == expected and after[doc].n_chars == len(expected)
    assert set(after) == set(rows_of(stages[3]))


def test_ids_are_the_tokenizers(stages):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    texts, coded = rows_of(stages[4]), rows_of(stages[5])
    assert set(texts) == set(coded)
    for doc, row in coded.items():
        assert row.token_ids == tokenizer.encode(texts[doc].text, add_special_tokens=False).ids
        assert row.n_tokens == len(row.token_ids)


def test_run_is_the_stages_in_turn(spark, stages):
    ran = pipeline.run(spark, FOLDER)
    digest = lambda df: sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert digest(ran) == digest(stages[-1])


def test_registered_queries():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(n) for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_reference_sql(spark, name):
    assert compare(QUERIES[name](spark, LARGER), connect(LARGER), ORACLE_SQL[name]) > 0
