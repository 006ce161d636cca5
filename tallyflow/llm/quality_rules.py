"""Quality rules: base counts, and divergence of a document's histograms from its language's.

A document's histograms of character classes and of common words are compared with
those of its language by Jensen-Shannon distance (the square root of the divergence in
bits, from 0 to 1).  The references are summed over all documents that pass the base
rules.  Every value of ``lang`` has its own class reference; common words are compared in
the languages that have a list of them.  Short documents have noisy histograms, so a
comparison needs a minimum length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common_words import COMMON_WORDS, common_hashes
from tallyflow.llm.docstats import CLASS_NAMES, statistics
from tallyflow.llm.scratch import Scratch
from tallyflow.llm.textscan import slices

#: Reference of documents in no language, or in one with too little text.
ANY = "*"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = (
    "doc_id bigint, lang string, "
    + ", ".join(f"{c} bigint" for c in BASE)
    + ", base_failed boolean, classes array<bigint>, commons array<bigint>"
)
VERDICTS = (
    "doc_id bigint, "
    + ", ".join(f"{c} bigint" for c in BASE)
    + ", base_failed boolean, class_distance double, word_distance double, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Largest distances, and the words from which each is looked at."""

    class_distance: float = 0.30
    class_words: int = 60
    word_distance: float = 0.30
    word_words: int = 150
    #: Base rules: fewest words, and highest percentage of words in repeated windows.
    base_words: int = 10
    base_repeat_percent: int = 20
    #: Fewest words that make a class reference of a language without a word list.
    reference_words: int = 1000


def _list(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel().astype(np.int64)), rows.shape[1]).cast(
        pa.list_(pa.int64())
    )


def document_counts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Counts and histograms of every row; a null text has none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = common_hashes()
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(2)):
                s = statistics(data, offsets, common)
                failed = (s.n_words < rules.base_words) | (
                    100 * s.n_repeat_words > rules.base_repeat_percent * s.n_words
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row:end], batch.column(1)[row:end]]
                    + [pa.array(getattr(s, c).astype(np.int64)) for c in BASE]
                    + [pa.array(failed), _list(s.classes), _list(s.commons)],
                    names=["doc_id", "lang", *BASE, "base_failed", "classes", "commons"],
                )

    return docs.select(
        F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string")
    ).mapInArrow(run, STATS)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def class_references(counts: DataFrame, rules: Rules) -> DataFrame:
    """``ref_lang, reference``: summed class histogram of every language with enough text."""
    sums = [F.sum(F.col("classes")[i]) for i in range(len(CLASS_NAMES))]
    summed = (
        counts.filter(~F.col("base_failed") & F.col("lang").isNotNull())
        .groupBy(F.col("lang").alias("ref_lang"))
        .agg(F.array(*sums).alias("reference"), F.sum("n_words").alias("words"))
    )
    enough = (F.col("words") >= rules.reference_words) | F.col("ref_lang").isin(sorted(COMMON_WORDS))
    return summed.filter(enough).select("ref_lang", "reference")


def references(counts: DataFrame) -> dict[str, np.ndarray]:
    """Summed histograms of the listed languages and of all texts (``ANY``), so at most five rows reach the driver."""
    width = len(CLASS_NAMES) + len(common_hashes()) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            both = np.hstack([_matrix(batch.column(1), len(CLASS_NAMES)), _matrix(batch.column(2), width - len(CLASS_NAMES))])
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + both[langs == lang].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))],
                names=["lang", "sums"],
            )

    rows = (
        counts.filter(~F.col("base_failed"))
        .select(F.when(F.col("lang").isin(sorted(COMMON_WORDS)), F.col("lang")).otherwise(ANY).alias("lang"), "classes", "commons")
        .mapInArrow(partial, "lang string, sums array<bigint>")
        .select("lang", F.posexplode("sums").alias("at", "n"))
        .groupBy("lang", "at")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(width))[r.at] = r.n
    out[ANY] = sum(out.values(), np.zeros(width))
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of ``p`` from the same row of ``q``; 0 where one of them is empty."""

    def shares(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.sum(axis=1, keepdims=True), 1)

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.where(x > 0, x, 1))).sum(axis=1)

    empty = (p.sum(axis=1) == 0) | (q.sum(axis=1) == 0)
    p, q = shares(p), shares(q)
    gap = entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2
    return np.where(empty, 0.0, np.sqrt(np.clip(gap, 0, 1)))


def judge(
    counts: DataFrame,
    classes: DataFrame,
    refs: dict[str, np.ndarray],
    rules: Rules = Rules(),  # noqa: B008
) -> DataFrame:
    """Distances and verdict of every row of ``document_counts``."""
    split = len(CLASS_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(common_hashes()) + 1
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            reference = batch.column("reference")
            wanted = np.tile(refs[ANY][:split], (len(langs), 1))
            wanted[reference.is_valid().to_numpy(zero_copy_only=False)] = _matrix(reference, split)
            by_class = jensen_shannon(_matrix(batch.column("classes"), split), wanted)
            none = np.zeros(width)
            spoken = [refs.get(x, refs[ANY])[split:] if x in COMMON_WORDS else none for x in langs]
            by_word = jensen_shannon(_matrix(batch.column("commons"), width), np.array(spoken).reshape(-1, width))
            n = batch.column("n_words").to_numpy(zero_copy_only=False)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            odd = (n >= rules.class_words) & (by_class > rules.class_distance)
            odd |= (n >= rules.word_words) & (by_word > rules.word_distance)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ["doc_id", *BASE, "base_failed"]]
                + [pa.array(by_class), pa.array(by_word), pa.array(~failed & ~odd)],
                names=["doc_id", *BASE, "base_failed", "class_distance", "word_distance", "kept"],
            )

    joined = counts.join(classes, F.col("lang") == F.col("ref_lang"), "left").drop("ref_lang")
    return joined.mapInArrow(run, VERDICTS)


def score_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Base counts, distances and ``kept`` of every row of ``docs`` (``doc_id, lang, text``).

    A null or empty text has no words and fails the base rules.  The classes of a null
    language, or of one without a word list and with fewer than ``reference_words`` words,
    are compared with those of all documents; without a word list the word distance is 0.
    Languages are values of ``lang`` as they stand.  Repeated rows and null doc_ids
    are judged as they stand; other columns are ignored; without any document that passes
    the base rules there is nothing to compare with and the distances are 0.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(document_counts(docs, rules), "counts")
    classes = scratch.keep(class_references(counts, rules), "classes")
    return judge(counts, classes, references(counts), rules)
