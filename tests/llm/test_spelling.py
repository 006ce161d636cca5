import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyflow.llm.fm_index import BidirectionalIndex, suffix_order
from tallyflow.llm.scratch import Scratch
from tallyflow.llm.spelling import group_variants, near_in_group, spelling_variants
from tests.llm.helpers import LOWER


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def literal(counts):
    """{word: (form, root, n, n_near, form_n)} by comparing all pairs."""
    out, form = {}, {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if abs(len(v) - len(w)) < 2 and near(w, v))
        if others and -others[0][0] >= 10 * n:
            form[w] = others[0][1]
        out[w] = len(others)
    rows = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        rows[w] = (f, root, n, out[w], counts[f] if f else None)
    return rows


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_index_finds_every_substring_from_both_sides():
    rng = np.random.default_rng(1)
    words = sorted({tuple(rng.integers(1, 4, rng.integers(1, 9))) for _ in range(150)})
    lengths = np.array([len(w) for w in words])
    index = BidirectionalIndex(np.array([c for w in words for c in w]), lengths, 4)
    text = [c for w in words for c in (0, *w)]
    assert sorted(suffix_order(np.array(text)).tolist()) == list(range(len(text)))
    circle = text + text[:20]
    for _ in range(200):
        a = rng.integers(0, len(text))
        pattern = circle[a : a + rng.integers(1, 12)]
        middle = int(rng.integers(0, len(pattern)))
        steps = [(c, False) for c in pattern[middle:]] + [(c, True) for c in reversed(pattern[:middle])]
        p = index.start(1)
        for c, leftward in steps:
            p = index.extend(p, np.array([c]), leftward)
        assert p.size[0] == sum(circle[i : i + len(pattern)] == pattern for i in range(len(text)))
    for number, w in enumerate(words):
        p = index.start(1)
        for c in (0, *w, 0):
            p = index.extend(p, np.array([c]), False)
        assert p.size[0] == 1 and p.left[0] == number


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdé"])
def test_searches_find_every_word_once(letters):
    rng = random.Random(5)
    words = list({"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(400)})
    every = np.ones(len(words), dtype=bool)
    found = Counter()
    for side in (0, 1):
        for w, n, _, _ in near_in_group(words, [1] * len(words), every, every, side):
            found[w] += n
    assert found == Counter({w: k for w in words if (k := sum(near(w, v) for v in words))})


def test_hot_halves_are_cut_without_loss(spark):
    rng = random.Random(7)
    counts = {}
    for _ in range(500):
        w = "pre" + "".join(rng.choice("ab") for _ in range(rng.randint(4, 7))) + rng.choice(["", "suf"])
        counts[w] = rng.choice([2, 3, 30, 400, 5000])
    counts |= {"x" * 3000: 2, "x" * 3001: 50, "zzzzzzzzz": 4}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    expected = literal(counts)
    assert any(r[1] not in (w, r[0]) for w, r in expected.items())
    for group_words, block_words in [(1 << 14, 1 << 13), (64, 16)]:
        assert rows_of(group_variants(table, Scratch(spark), group_words, block_words)) == expected


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(spelling_variants(docs)) == literal(words_of(rows))


def test_defined_for_any_rows(spark):
    rows = [(1, None), (2, ""), (3, "Éclairs éclairs ÉCLAIRS short straße Straße"), (3, "éclairs " * 40), (None, "éclairsx éclairsx 7letters"), (4, "×÷abcdefg " * 3), (5, "A" * 20000 + " " + "a" * 20000)]
    table = spark.createDataFrame([(t, i, "w", 1) for i, t in rows], "text string, doc_id bigint, word string, n int")
    assert rows_of(spelling_variants(table)) == literal(words_of(rows))
    assert spelling_variants(table.limit(0)).count() == 0
