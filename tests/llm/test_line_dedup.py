import random

import numpy as np
import pyarrow as pa
import pytest

from tallyflow.llm import line_dedup
from tallyflow.llm.line_dedup import dedup_lines, within_one_edit
from tallyflow.llm.textscan import utf8
from tests.llm.helpers import cut_lines, one_edit


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_literal_version(spark, seed):
    """Crowds of lines around the bound: replacements at one place, insertions, and chains of edits."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(6, 12))] for _ in range(8)]
    texts = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line))
                kind = rng.randrange(3)
                line[at : at + (kind != 1)] = [] if kind == 0 else [f"x{rng.randrange(5)}"]
            lines.append(rng.choice(["", " "]) + rng.choice([" ", "  "]).join(line).upper())
        texts.append("\n".join(lines + ["", "short line"]))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = dedup_lines(docs)
    assert {r.doc_id: r.text for r in got.collect()} == cut_lines(rows)
    for r in got.collect():
        assert r.n_lines == texts[r.doc_id].count("\n") + 1


def test_edge_rows(spark):
    line = "one two three four five six seven eight nine"
    rows = [
        (2, None),
        (3, ""),
        (5, f"{line}\n\n{line} ten\n  \nkeep\nkeep"),
        (5, f"{line}\n\n{line} ten\n  \nkeep\nkeep"),
        (None, f"{line.upper()}\nother"),
        (9, "a " * 40_000 + "\nother"),
    ]
    docs = spark.createDataFrame([(t, d, "x", "y") for d, t in rows], "text string, doc_id bigint, n_lines string, line string")
    got = sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed, r.line) for r in dedup_lines(docs).collect()), key=str)
    assert got == sorted(
        [
            ("2", None, 0, 0, "y"),
            ("3", "", 1, 0, "y"),
            ("5", f"{line}\n\n  \nkeep", 6, 2, "y"),
            ("5", f"{line}\n\n  \nkeep", 6, 2, "y"),
            ("9", "a " * 40_000 + "\nother", 2, 0, "y"),
            ("None", "", 2, 2, "y"),
        ],
        key=str,
    )
    assert dedup_lines(docs.limit(0)).count() == 0


def test_within_one_edit():
    rng = random.Random(3)
    for _ in range(2000):
        a = [rng.choice("ab") for _ in range(rng.randrange(6))]
        b = [rng.choice("ab") for _ in range(rng.randrange(6))]
        assert within_one_edit(a, b) == one_edit(a, b)


@pytest.mark.parametrize("runs", [1, 3])
def test_one_edit_at_every_place(spark, runs):
    """Pairs alone with their words, so that each needs its own halves and variants; lengths on both sides of all bands."""
    texts = []
    for n in range(7, 24):
        for at in range(n + 1):
            for kind in ("replaced", "inserted"):
                line = [f"{kind[0]}{n}-{at}-{i // runs}" for i in range(n)]
                other = [*line[:at], "Other", *line[at + (kind == "replaced") :]]
                pair = [" ".join(line), " ".join(other)]
                texts.append("\n".join(pair[:: 1 if at % 2 else -1]))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == cut_lines(rows)


def test_work_of_a_line_with_one_shared_half(spark):
    """Variants without a word of the shared half are not made; most lines have two halves."""
    line = [f"w{i}" for i in range(60)]
    alone = [" ".join(f"x{n}-{i}" for i in range(n)) for n in range(8, 108)]
    rows = [(1, " ".join(line)), (2, " ".join([*line[:-1], "other"])), (3, "\n".join(alone))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lines = line_dedup.distinct_lines(line_dedup.occurrences(docs))
    assert sum(len(r.halves) for r in lines.collect()) < 3 * 102
    texts = line_dedup.candidate_texts(docs, line_dedup.candidates(lines))
    assert sorted(r.doc_id for r in texts.collect()) == [1, 2]
    made = [(r.doc_id, r["at"]) for r in line_dedup.variants(texts).collect()]
    assert len(made) <= 2 * 45 and {(1, -1), (1, 59), (2, 59)} <= set(made)


def test_lines_cut_from_bytes():
    rng = random.Random(4)
    for _ in range(200):
        texts = ["\n".join(rng.choice(["", "a", "bc ", "\u00e9\u4e2d"]) for _ in range(rng.randrange(1, 6))) for _ in range(5)]
        gone = [{i for i in range(t.count("\n") + 1) if rng.random() < 0.5} for t in texts]
        data, offsets = utf8(pa.array(texts))
        pairs = np.array([(r, i) for r, lines in enumerate(gone) for i in sorted(lines)], dtype=np.int64).reshape(-1, 2)
        cut, at = line_dedup.cut_lines(data, offsets, pairs[:, 0], pairs[:, 1])
        got = [cut[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in zip(texts, gone, strict=True)]
