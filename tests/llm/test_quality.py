import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import quality_classifier as qc
from tallyflow.llm.common_words import COMMON_WORDS
from tallyflow.llm.quality_rules import jensen_shannon, score_quality
from tests.llm.helpers import words


def base_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return (len(w), sum(map(len, w)), symbols, dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_counts_of_whole_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = score_quality(docs).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base_counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if labels.get(r.doc_id) == 0]
    assert all(r.kept for r in clean)
    assert sum(r.kept for r in junk) <= 0.5 * len(junk)


KINDS = [
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t ", "\n\r", "", ".,;:!?-", "'\"`", "()[]{}", ""
]


def kind_of(c):
    if ord(c) >= 128:
        return 10 + len(c.encode()) - 2
    found = [i for i, chars in enumerate(KINDS) if c in chars]
    return found[0] if found else 5 if ord(c) < 32 or ord(c) == 127 else 9


def distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def literal_verdicts(rows):
    """{doc_id: (class distance, word distance, kept)} by counting characters and words one by one."""
    listed = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
    classes, commons, counts = {}, {}, {}
    for d, text, _ in rows:
        counts[d] = base_counts(text)
        classes[d] = [0] * 13
        for c in text or "":
            classes[d][kind_of(c)] += 1
        w = words(text, lower=True)
        commons[d] = [w.count(x) for x in listed] + [sum(x not in listed for x in w)]
    good = [(d, lang) for d, _, lang in rows if not counts[d][5]]
    total = lambda table, ds: [sum(x) for x in zip(*(table[d] for d in ds), strict=True)]
    everyone = total(classes, [d for d, _ in good])
    out = {}
    for d, _, lang in rows:
        mine = [x for x, y in good if y == lang and lang is not None]
        own = mine and (lang in COMMON_WORDS or sum(counts[x][0] for x in mine) >= 1000)
        by_class = distance(classes[d], total(classes, mine) if own else everyone)
        by_word = distance(commons[d], total(commons, mine)) if lang in COMMON_WORDS and mine else 0.0
        n, failed = counts[d][0], counts[d][5]
        out[d] = by_class, by_word, not failed and not (n >= 60 and by_class > 0.3) and not (n >= 150 and by_word > 0.3)
    return out


def test_verdicts_are_those_of_a_literal_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    rng = random.Random(9)
    rows += [(10**6 + i, "".join(rng.choice("äöü#%123 \n") for _ in range(600)), rng.choice(["en", None, "xx"])) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want = literal_verdicts(rows)
    got = {r.doc_id: r for r in score_quality(table).collect()}
    for d, (by_class, by_word, kept) in want.items():
        assert got[d].kept == kept
        assert got[d].class_distance == pytest.approx(by_class, abs=1e-6) and got[d].word_distance == pytest.approx(by_word, abs=1e-6)
    assert {k for *_, k in want.values()} == {True, False}


def test_distance_and_its_guards():
    p = np.array([[1.0, 0, 0], [1, 1, 0], [0, 0, 0], [2, 2, 4]])
    q = np.array([[0.0, 1, 1], [2, 2, 0], [1, 1, 1], [1, 1, 2]])
    assert jensen_shannon(p, q) == pytest.approx([1, 0, 0, 0], abs=1e-7)


def test_rule_edge_rows(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(COMMON_WORDS["en"].split() + ["tree", "house", "sky"]) for _ in range(400)) for _ in range(20)]
    rows = [(t, k, "en", "a") for k, t in enumerate(good)]
    rows += [(None, 50, None, "a"), ("", None, "xx", "a"), ("## " * 300, 51, "en", "a"), ("é\u0085ü " * 100_000, 52, "fr", "a")]
    rows += rows[:2]
    docs = spark.createDataFrame(rows, "text string, doc_id bigint, lang string, classes string")
    got = score_quality(docs).collect()
    assert len(got) == len(rows)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 20)
    assert not any(r.kept for r in got if r.doc_id is None or r.doc_id >= 50)
    assert score_quality(docs.limit(0)).count() == 0


def test_every_language_has_its_own_reference(spark):
    """Clean texts in other scripts and in other spellings of a code stand beside many English ones."""
    rng = random.Random(8)

    def texts(n, vocabulary, size):
        return [" ".join(rng.choice(vocabulary) for _ in range(size)) for _ in range(n)]

    def made(letters):
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(300)]

    english = COMMON_WORDS["en"].split() + ["tree", "house", "sky"]
    rows = [(t, "en") for t in texts(60, english, 300)]
    rows += [(t, "ru") for t in texts(8, made("абвгдежзийклмнопрст"), 300)]
    rows += [(t, "el") for t in texts(8, made("αβγδεζηθικλμνξοπρστ"), 300)]
    rows += [(t, "zh") for t in texts(8, made("的一是不了人我在有他这中大来上"), 300)]
    rows += [(t, "EN-us") for t in texts(8, english, 300)]
    clean = len(rows)
    rows += [("#$ %& <> ** || ## " * 4 + " ".join(f"{i}{rng.randrange(10**6)}" for i in range(200)), "ru")]
    rows += [(texts(1, made("абвгдежзий"), 300)[0], None), (texts(1, made("абвгдежзий"), 300)[0], "bg")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in score_quality(docs).collect()}
    assert len(got) == len(rows) and all(got[k].kept for k in range(clean))
    assert not any(got[k].kept for k in range(clean, len(rows)))
    assert all((r.word_distance > 0) == (rows[k][1] == "en") for k, r in got.items())


def test_classifier_on_held_out_labels(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/labels.parquet")
    model = qc.train(docs, labels)
    rows = qc.score(docs, model).withColumn("held_out", qc.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert test and {zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in test} == {True}
    assert np.mean([r.predicted == r.quality for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_trees_are_walked_as_they_were_fitted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(float)
    trees = qc.fit(x, y)

    def walk(row):
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    score = trees.score(x)
    assert score[:50] == pytest.approx([walk(r) for r in x[:50]])
    assert ((score > 0.5) == y).mean() > 0.97


def test_classifier_edge_rows(spark):
    docs = spark.createDataFrame(
        [(None, 1, "s"), ("", None, "s"), ("a b c " * 50_000, 2, "s"), ("a b c", 3, "s"), ("a b c", 3, "s")],
        "text string, doc_id bigint, score string",
    )
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (2, None), (1, 0)], "doc_id bigint, quality int")
    for labels in (none, one):
        rows = qc.score(docs, qc.train(docs, labels)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert qc.score(docs.limit(0), qc.train(docs.limit(0), none)).count() == 0
