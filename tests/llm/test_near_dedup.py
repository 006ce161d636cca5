import random

import pytest

from tallyflow.llm.components import components
from tallyflow.llm.near_dedup import Similarity, least_matches, near_groups
from tallyflow.llm.scratch import Scratch
from tests.llm.helpers import near_components


def _got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = near_components([(r.doc_id, r.text) for r in docs.collect()])
    rows = near_groups(docs)
    assert _got(rows) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_a_crowded_group_of_edited_copies(spark, seed):
    """Many copies of one text around the threshold, chains among them, and unrelated texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(130)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(copy))
    chain = list(base)
    for i in range(0, 60, 2):
        chain[i] = f"y{i}"
        texts.append(" ".join(chain))
    texts += [" ".join(f"z{rng.randrange(9000)}" for _ in range(60)) for _ in range(50)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _got(near_groups(docs)) == near_components(rows)


def test_edge_rows(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(5, text), (5, text), (9, text.upper().replace(" ", "\t\n")), (None, text), (7, None), (8, ""), (6, " \n")]
    rows += [(20, "one two"), (11, "One  two"), (12, "two one"), (None, "alone")]
    docs = spark.createDataFrame([(t, d, 1, "s") for d, t in rows], "text string, doc_id bigint, n int, signature string")
    got = sorted(tuple(r) for r in near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept").collect() if r.doc_id)
    assert got == [
        (5, 36, 5, True),
        (5, 36, 5, True),
        (6, 0, 6, True),
        (7, 0, 7, True),
        (8, 0, 8, True),
        (9, 36, 5, False),
        (11, 1, 11, True),
        (12, 1, 12, True),
        (20, 1, 11, False),
    ]
    without = {(r.component_id, r.kept) for r in near_groups(docs).filter("doc_id is null").collect()}
    assert without == {(5, False), (None, True)}
    assert near_groups(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(70, 71), (71, 70), (3, 3)]
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(links, Scratch(spark)).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)} | {70: 70, 71: 70}
    assert got == want
    assert components(links.limit(0), Scratch(spark)).count() == 0


def test_pruning_bounds():
    bounds = least_matches(Similarity())
    assert [n for n, _ in bounds] == [25, 50, 75, 100, 125]
    assert all(0 < m < 0.85 * n for n, m in bounds) and bounds[-1][1] > 0.6 * 125


def test_class_ids_do_not_follow_the_splits_of_files(spark, monkeypatch):
    """Files are cut otherwise in every job, as when executors come and go."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(0, 200, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    keep, kept = Scratch.keep, []

    def cut_otherwise(self, df, name):
        kept.append(name)
        spark.conf.set("spark.sql.files.minPartitionNum", str(1 + 3 * len(kept)))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", cut_otherwise)
    try:
        got = _got(near_groups(docs))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == near_components(rows) and {c for _, c in got.values()} == {0}
