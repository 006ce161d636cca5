"""Hashes of strings: equal for equal strings, and different for regular ones too."""

import numpy as np

from tallyflow.llm import textscan as ts
from tallyflow.llm.line_dedup import dedup_lines
from tallyflow.llm.near_dedup import near_groups
from tallyflow.llm.quality_rules import score_quality
from tallyflow.llm.suffix_dedup import remove_repeats


def thue_morse(n, symbols):
    """Two strings that agree in every polynomial hash modulo 2^64 from 1,024 symbols on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [symbols[b] for b in bits], [symbols[1 - b] for b in bits]


def test_arithmetic_modulo_the_prime():
    rng = np.random.default_rng(1)
    ends = np.array([[0, ts.PRIME - 1, ts.PRIME - 1], [5, ts.PRIME - 1, 1]], dtype=np.uint64)
    a, b = (np.concatenate((rng.integers(0, ts.PRIME, 50_000, dtype=np.uint64), e)) for e in ends)
    assert ts.times(a, b).tolist() == [int(x) * int(y) % ts.PRIME for x, y in zip(a, b, strict=True)]
    small = a & np.uint64((1 << 31) - 1)
    assert ts.reduced(ts.small_times(small, b)).tolist() == [int(x) * int(y) % ts.PRIME for x, y in zip(small, b, strict=True)]
    total, expected = 7, [7]
    for x in a.tolist():
        total = (total + x) % ts.PRIME
        expected.append(total)
    assert ts.sums(a, 7).tolist() == expected
    assert ts.minus(a, b).tolist() == [(int(x) - int(y)) % ts.PRIME for x, y in zip(a, b, strict=True)]
    assert ts.powers(ts.BASES[0], 1000).tolist() == [pow(ts.BASES[0], i, ts.PRIME) for i in range(1001)]
    assert ts.reduced(np.array([2**64 - 1, ts.PRIME, 0], dtype=np.uint64)).tolist() == [(2**64 - 1) % ts.PRIME, 0, 0]


def test_equal_strings_anywhere(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(ts, "SCAN_BYTES", 64)
    ts._scan_powers.cache_clear()
    try:
        data = rng.integers(97, 99, 1000).astype(np.uint8)
        starts = np.sort(rng.integers(0, 900, 200))
        ends = starts + 9
        hashes = ts.substring_hashes(data, starts, ends, ts.byte_values(False))
        seen = {}
        for s, h in zip(starts.tolist(), hashes.tolist(), strict=True):
            assert seen.setdefault(data[s : s + 9].tobytes(), h) == h
        assert len(set(seen.values())) == len(seen)
    finally:
        ts._scan_powers.cache_clear()


def test_sequences_with_one_left_out():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 60, dtype=np.uint64)
    for which in (0, 1):
        for first, last in ((0, 60), (3, 10), (20, 21)):
            for without in range(first, last):
                left = np.delete(values[first:last], without - first)
                one = ts.range_hashes(values, np.array([first]), np.array([last]), np.array([without]), which)
                assert one == ts.range_hashes(left, np.array([0]), np.array([len(left)]), which=which)


def test_regular_strings_differ():
    for n in (1024, 4096):
        a, b = ("".join(x).encode() for x in thue_morse(n, "ab"))
        data = np.frombuffer(a + b" " + b, np.uint8)
        words, _ = ts.word_hashes(data, np.array([0, len(data)]), lower=True)
        assert words[0] != words[1]
        u, v = thue_morse(n, rng_words())
        both = np.array(u + v, dtype=np.uint64)
        first, last = np.array([0, n]), np.array([n, 2 * n])
        x = ts.range_hashes(both, first, last)
        assert x[0] != x[1]


def rng_words():
    return [int(x) for x in np.random.default_rng(4).integers(0, 2**63, 2, dtype=np.uint64)]


def test_operators_keep_regular_strings_apart(spark):
    a, b = ("".join(x) for x in thue_morse(1024, "ab"))
    u, v = (" ".join(x) for x in thue_morse(1024, ["up", "down"]))
    docs = spark.createDataFrame([(1, a, "en"), (2, b, "en"), (3, f"{a}\n{b}\n{u}\n{v}", "en"), (4, u, "en"), (5, v, "en")], "doc_id bigint, text string, lang string")
    groups = {r.doc_id: r.kept for r in near_groups(docs.filter("doc_id < 3")).collect()}
    assert groups == {1: True, 2: True}
    assert score_quality(docs).filter("doc_id = 3").head().n_dup_lines == 0
    cut = {r.doc_id: r.n_removed for r in dedup_lines(docs.filter("doc_id in (1, 2, 4, 5)")).collect()}
    assert cut == {1: 0, 2: 0, 4: 0, 5: 0}
    # Documents 4 and 5 repeat lines of document 3, which repeats those of 1 and 2.
    assert {r.doc_id: r.n_removed for r in dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 2, 4: 1, 5: 1}
    spans = {r.doc_id: [(s["from"], s["to"]) for s in r.spans] for r in remove_repeats(docs.filter("doc_id < 3")).collect()}
    seen = {a[i : i + 100] for i in range(925)}
    covered = {j for i in range(925) if b[i : i + 100] in seen or b.find(b[i : i + 100]) < i for j in range(i, i + 100)}
    assert sum(y - x for x, y in spans[2]) == len(covered)
