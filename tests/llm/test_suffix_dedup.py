import hashlib
import random

import numpy as np
import pytest

from tallyflow.llm.suffix_dedup import Suffixes, remove_repeats, sliding_min, with_digest


def literal(rows, window):
    """Removal by remembering every string of ``window`` bytes, in order."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for at in range(len(raw) - window + 1):
            string = raw[at : at + window]
            if string in seen:
                gone[at : at + window] = True
            seen.add(string)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[doc_id] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    rows = with_digest(df.select("doc_id", "text", "spans")).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_equals_remembering_all_strings(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(remove_repeats(docs)) == literal([(r.doc_id, r.text) for r in docs.collect()], 100)


@pytest.mark.parametrize("hot", [None, 3])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_periods_and_edits(spark, seed, hot):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abc déf.\n") for _ in range(n))

    passages = [noise(rng.randrange(15, 90)) for _ in range(6)]
    texts = [None, "", "a", "ab" * 120, "a" * 150, "a" * 90 + "b", "ab" * 60]
    for _ in range(60):
        parts = [noise(rng.randrange(0, 60)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                at = rng.randrange(len(p))
                p = p[:at] + "#" + p[at + 1 :]
            parts.insert(rng.randrange(len(parts) + 1), p)
        texts.append("".join(parts))
    texts += texts[8:14]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(remove_repeats(docs, window=20, gram=8, hot=hot)) == literal(rows, 20)


def test_a_text_longer_than_a_scan(spark, monkeypatch):
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, block * 4), (2, block[1000:200_000])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    n = len(block)
    result = got(remove_repeats(docs))
    assert result[1][1:3] == (3 * n, 1) and result[2][1:3] == (199_000, 1)


def test_edge_rows(spark):
    text = "".join(chr(97 + i % 23) + str(i) for i in range(60))
    rows = [(text, None, 1), (text, 3, 2), (text, 3, 2), (None, 5, 3), ("", None, 3), ("x" + text, 9, 1)]
    docs = spark.createDataFrame(rows, "text string, doc_id bigint, spans int")
    out = {}
    for r in with_digest(remove_repeats(docs)).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    n = len(text)
    assert out == {3: [(n, 0, 0)] * 2, 5: [(0, 0, 0)], 9: [(n + 1, n, 1)], None: out[None]}
    assert sorted(out[None]) == [(0, 0, 0), (n, n, 1)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_suffix_sort_and_extensions():
    rng = random.Random(6)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), np.uint8)
    suffixes = Suffixes(data, 40)
    starts = np.array([rng.randrange(2900) for _ in range(700)])
    ends = np.minimum(starts + 90, 3000)
    group = np.sort(np.array([rng.randrange(9) for _ in range(700)]))
    order = suffixes.sort(starts, ends, group)
    raw = data.tobytes()
    want = sorted(range(700), key=lambda k: (group[k], raw[starts[k] : ends[k]][:40], k))
    assert order.tolist() == want
    a, b = order[:-1], order[1:]
    common = suffixes.common(starts[a], ends[a], starts[b], ends[b])
    for x, y, n in zip(a, b, common, strict=True):
        s, t = raw[starts[x] : ends[x]][:40], raw[starts[y] : ends[y]][:40]
        want_n = next((i for i, (p, q) in enumerate(zip(s, t, strict=False)) if p != q), min(len(s), len(t)))
        assert n == want_n


def test_sliding_min():
    values = np.array([random.Random(1).randrange(100) for _ in range(50)])
    for width in (1, 3, 7, 50, 51):
        want = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert sliding_min(values, width).tolist() == want
