"""Every stage of the pipeline against a literal version, on its own input."""

import math

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyflow.llm import quality_classifier
from tallyflow.llm.common_words import common_hashes
from tallyflow.llm.docstats import statistics
from tallyflow.llm.native_sql import mixing_sql
from tests.llm.helpers import cut_lines, near_components


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """[(input rows, output rows)] of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def test_all_but_the_last_return_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < after.count() <= before.count()


def test_quality_filter_keeps_what_the_trees_accept(spark, data, stages):
    """The fitted trees are walked node by node for every document."""
    before, after = stages[0]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality_classifier.train(before, labels)

    def accepted(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        x = quality_classifier.features(statistics(raw, np.array([0, len(raw)]), common_hashes()))[0]
        total = model.start
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total)) >= 0.3

    want = {r.doc_id for r in before.collect() if accepted(r.text)}
    assert {r.doc_id for r in after.collect()} == want
    clean = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(clean & want) / len(clean) > 0.97


def test_a_text_of_blanks_goes_through_all_stages(spark, data, tmp_path):
    """A long run of white space ends no stage."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    long = "A sentence of some words that stands here. " * 40 + " " * 1_200_000 + "The end of it."
    docs = docs.union(spark.createDataFrame([(10**7, long, "en", "web", len(long))], docs.schema))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "quality classifier":
            continue
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0


def test_lines(stages):
    before, after = stages[1]
    want = cut_lines([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_copies(stages):
    before, after = stages[2]
    groups = near_components([(r.doc_id, r.text) for r in before.collect()], percent=80)
    assert {r.doc_id for r in after.collect()} == {d for d, (n, c) in groups.items() if d == c}


def test_near_copies_from_80_percent_on(spark, data, stages):
    before, _ = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    top = max(d for d, _ in rows)
    # 100 words have 96 shingles; n words in a row replaced at the end leave 96 - n: 86/106 = 0.81 and 84/108 = 0.78.
    for k, n in ((1, 10), (3, 12)):
        text = [f"edited{k}x{i}" for i in range(100)]
        rows += [(top + k, " ".join(text)), (top + k + 1, " ".join(text[: 100 - n] + [f"other{k}x{i}" for i in range(n)]))]
    docs = spark.createDataFrame([(d, t, "en", "web", 1) for d, t in rows], before.schema)
    got = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, data).collect()}
    groups = near_components(rows, percent=80)
    assert got == {d for d, (n, c) in groups.items() if d == c}
    assert top + 2 not in got and {top + 1, top + 3, top + 4} <= got


def test_mixing(stages):
    """Against the same rule in SQL, run by another engine."""
    before, after = stages[3]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    want = {d for d, sampled in con.execute(f"SELECT doc_id, sampled FROM ({mixing_sql()})").fetchall() if sampled}
    assert {r.doc_id for r in after.collect()} == want


def test_packing(stages):
    before, after = stages[4]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: plain.encode(r.text, add_special_tokens=False).ids + [1] for r in before.collect()}
    got = {}
    for r in sorted(after.collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got == want


def test_run_gives_the_last_stage(spark, data, stages):
    rows = corpus_pipeline.run(spark, data).select("doc_id", "start", "length")
    assert sorted(map(tuple, rows.collect())) == sorted(
        map(tuple, stages[-1][1].select("doc_id", "start", "length").collect())
    )
