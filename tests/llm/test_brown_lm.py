import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyflow.llm import brown_lm
from tests.llm.helpers import words

def held_column():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [*words(text, lower=True), ""]


def scored(docs, settings):
    model = brown_lm.train(docs, ~held_column(), settings)
    return model, brown_lm.score_texts(docs, held_column().alias("held_out"), model).collect()


def literal(rows, model):
    """Base and class scores of every text, from counts taken anew and the model's classes."""
    seen = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    n, v, k = sum(seen.values()), len(seen), model.settings.classes
    table = dict(zip(model.words.to_pylist(), model.word_class.tolist(), strict=True))
    assert set(table) == {w for w, c in seen.items() if w and c << model.settings.share_bits >= n and len(w.encode()) <= brown_lm.LONGEST}

    def class_of(w):
        return k + brown_lm.SHAPES if w == "" else table[w] if w in table else k + int(brown_lm.shapes(pa.array([w], pa.large_string()))[0])

    of_class, kinds = Counter(), Counter()
    for w, c in seen.items():
        of_class[class_of(w)] += c
        kinds[class_of(w)] += 1
    follow = Counter()
    for d, text in rows:
        if not held(d):
            cs = [k + brown_lm.SHAPES, *map(class_of, tokens(text))]
            follow.update(zip(cs, cs[1:], strict=False))
    size, s = k + brown_lm.SHAPES + 1, model.settings
    after, arrive = Counter(), Counter()
    for (a, b), c in follow.items():
        after[a] += c
        arrive[b] += c

    def score(text):
        total, a = 0.0, k + brown_lm.SHAPES
        for w in tokens(text):
            b = class_of(w)
            q = (arrive[b] + s.class_prior) / (n + s.class_prior * size)
            total += math.log10((follow[a, b] + s.transition_prior * q) / (after[a] + s.transition_prior))
            if w:
                total += math.log10(seen[w] / of_class[b] if w in table else (seen[w] + 1) / (of_class[b] + kinds[b] + 1))
            a = b
        return total

    return [
        (d, held(d), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), score(t))
        for d, t in rows
    ]


def compare(rows, got, model):
    expected = sorted(literal(rows, model), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    for a, b in zip(sorted(expected, key=lambda r: (r[0] is None, *r[:1], r[5])), sorted(got, key=lambda r: (r[0] is None, *r[:1], r[5])), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_scores_are_those_of_the_model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model, got = scored(docs.repartition(7), brown_lm.Settings(classes=12, share_bits=11, rounds=6))
    compare(rows, got, model)
    assert all(b > a for a, b in zip(model.likelihoods, model.likelihoods[1:], strict=False)) and len(model.likelihoods) > 2
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)


def test_probabilities_sum_to_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = brown_lm.train(docs, ~held_column(), brown_lm.Settings(classes=8, share_bits=10, rounds=2))
    assert np.allclose((10 ** model.log_transitions()).sum(axis=1), 1)
    assert np.allclose(np.bincount(model.word_class, weights=10 ** model.log_words(), minlength=8)[np.unique(model.word_class)], 1)
    rare = model.counts.filter(F.col("word") != "").toPandas()
    rare = rare[~rare["word"].isin(model.words.to_pylist())]
    assert (np.bincount(rare["shape"], weights=rare["n"], minlength=10) == model.shape_tokens).all()
    assert (np.bincount(rare["shape"], minlength=10) == model.shape_words).all()


def test_defined_for_any_rows(spark):
    rows = [(i, f"a b{i % 3} C c7 é,") for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \n\t"), (43, "x" * 5000 + " " + "y " * 400), (3, "a b0"), (3, "a b0"), (None, "a never"), (None, None)]
    table = spark.createDataFrame([(t, d, 1, "n") for d, t in rows], "text string, doc_id bigint, n int, word string")
    model, got = scored(table, brown_lm.Settings(classes=3, rounds=3))
    compare(rows, got, model)


def test_no_training_texts(spark):
    nothing = spark.createDataFrame([], "doc_id bigint, text string")
    assert scored(nothing, brown_lm.Settings())[1] == []
    only = [d for d in range(60) if held(d)]
    rows = [(d, "some words") for d in only]
    model, got = scored(spark.createDataFrame(rows, "doc_id bigint, text string"), brown_lm.Settings(classes=2))
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    compare(rows, got, model)


def test_best_moves_by_trying_them():
    rng = np.random.default_rng(4)
    pairs = Counter((int(a), int(b)) for a, b in rng.integers(0, 9, (400, 2)) if a != b)
    classes = rng.integers(0, 3, 9)

    def matrix(of):
        out = np.zeros((3, 3))
        for (a, b), c in pairs.items():
            out[of[a], of[b]] += c
        return out

    left, right = np.zeros((9, 3)), np.zeros((9, 3))
    for (a, b), c in pairs.items():
        right[a, classes[b]] += c
        left[b, classes[a]] += c
    best, gain = brown_lm.best_moves(matrix(classes), classes, left, right, 3)
    for w in range(9):
        tried = []
        for c in range(3):
            of = classes.copy()
            of[w] = c
            tried.append(brown_lm.likelihood(matrix(of)) - brown_lm.likelihood(matrix(classes)))
        assert math.isclose(max(tried), gain[w], abs_tol=1e-6) and math.isclose(tried[best[w]], max(tried), abs_tol=1e-6)
