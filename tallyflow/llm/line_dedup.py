"""Line dedup by a deletion-neighbourhood join.

A line is the sequence of its words, A-Z in lower case; spacing does not count.  The
edit distance of two lines is the least number of words inserted, deleted or replaced.
A line goes if the same line, or one within an edit distance of 1, stands earlier.

Two lines are within the bound if and only if deleting at most one word from each gives
the same words: the same word place in both (a replacement), or one place in one of
them only (an insertion).  So each line emits its variants as hashed keys; lines that
share one are joined to the earliest of them, and the distance is verified on the words.

Most lines have no such partner.  Within one edit either the first or the last half of
two lines is the same, so only lines that share a half with another one emit variants, and
only those without a word outside of that half.  Lengths lie in bands, and the halves of all
lines of a band have half the words of its shortest line; so a line has two halves, and the
shortest lines of a band also have the two that longer lines of the band before would have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tallyflow.llm.scratch import Scratch
from tallyflow.llm.textscan import SPACE, U64, mix64, range_hashes, slices, word_hashes, word_spans

#: A line with fewer words must be the same to count as repeated.
LEAST_WORDS = 8

#: The order of lines: null doc_ids last, then the text's hash (it tells rows with one doc_id apart), then the line.
PLACE = ["no_id", "doc_id", "text_hash", "line"]
OCCURRENCES = (
    "no_id boolean, doc_id bigint, text_hash bigint, line int, words int, k1 bigint, k2 bigint, halves array<bigint>"
)


def _key_columns() -> list[Column]:
    """_no_id, _doc_id (0 for null), _text_hash: what tells one row's lines from another's."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("bigint")
    return [
        doc_id.isNull().alias("_no_id"),
        F.coalesce(doc_id, F.lit(0)).cast("bigint").alias("_doc_id"),
        F.xxhash64(text).alias("_text_hash"),
    ]


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*_key_columns(), text).toDF("no_id", "doc_id", "text_hash", "text")


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all lines of all rows, and the row of each; an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1))
    starts = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((starts, rows))
    return starts[order], rows[order]


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[SPACE] = 32
_PLAIN[65:91] += 32


def bands(most: int, least: int) -> np.ndarray:
    """The least numbers of words of the bands of lengths up to ``most``; each is a quarter longer than the one before."""
    low = [max(least, 1)]
    while low[-1] <= most:
        low.append(max(low[-1] + 1, low[-1] * 5 // 4))
    return np.array(low, dtype=np.int64)


def band_halves(n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of ``n`` words: the band, the words of a half there and in the band before, and whether they have those too.

    Bands count from 0, and shorter lines are in band -1.
    """
    low = bands(int(n.max(initial=0)), least)
    band = np.searchsorted(low, n, side="right") - 1
    before = np.maximum(band - 1, 0)
    return band, low[band] // 2, low[before] // 2, (band > 0) & (n == low[band])


def plain_lines(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words in lower case with one blank after each, and where they start and end there.

    Words of two rows may have no blank between them.  Entry i of the ends is of word i - 1.
    """
    kept = ~SPACE[data]
    inner = stop[stop < len(data)]
    kept[inner] = True
    apart = np.zeros(len(at), dtype=np.int64)
    apart[: len(inner)] = SPACE[data[inner]]
    length = stop - at
    begins = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(length + apart, out=begins[1:])
    ends = np.concatenate(([0], begins[:-1] + length))
    return _PLAIN[data[kept]].tobytes(), begins, ends


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Cryptographic digests of ``raw[starts[i]:ends[i]]``, a row of 64-bit numbers each."""
    hashed, spans = hashlib.blake2b, zip(starts.tolist(), ends.tolist(), strict=True)
    out = b"".join([hashed(raw[a:b], digest_size=size).digest() for a, b in spans])
    return np.frombuffer(out, "<u8").reshape(-1, size // 8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def half_keys(
    raw: bytes, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Four keys per line of the words ``first`` to ``last``, and which of them hold.

    The first and last half of the line's band, then those of the band before, as the longer of two lines.
    """
    n = last - first
    band, half, before, both = band_halves(n, least)
    keys, valid = np.zeros((len(n), 4), dtype=np.uint64), np.zeros((len(n), 4), dtype=bool)
    for kind, (size, of, holds) in enumerate(((half, band, band >= 0), (before, band - 1, both))):
        a, z, w, of = first[holds], last[holds], size[holds], of[holds]
        for side, (start, end) in enumerate(((a, a + w), (z - w, z))):
            tag = mix64((of * 2 + side).astype(np.uint64) + U64(1))
            keys[holds, 2 * kind + side] = mix64(digests(raw, begins[start], ends[end], 8)[:, 0] ^ tag)
            valid[holds, 2 * kind + side] = True
    return keys, valid


def occurrences(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Every line with a word: its place, digest (k1, k2) of its words, number of words and half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(3)):
                starts, rows = line_starts(data, offsets)
                at, stop = word_spans(data, offsets)
                raw, begins, ends = plain_lines(data, at, stop)
                first = np.searchsorted(at, starts)
                last = np.append(first[1:], len(at))
                number = np.arange(len(starts)) - np.searchsorted(rows, rows)
                full = last > first
                first, last, rows, number = first[full], last[full], rows[full], number[full]
                keys, valid = half_keys(raw, begins, ends, first, last, least)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(valid.sum(axis=1)))), pa.int32()), _signed(keys[valid])
                )
                take = pa.array(rows)
                k = digests(raw, begins[first], ends[last], 16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c)[row:end].take(take) for c in range(3)]
                    + [
                        pa.array(number, pa.int32()),
                        pa.array(last - first, pa.int32()),
                        _signed(k[:, 0]),
                        _signed(k[:, 1]),
                        lists,
                    ],
                    names=[*PLACE, "words", "k1", "k2", "halves"],
                )

    return _named(docs).mapInArrow(run, OCCURRENCES)


def _place(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}") for c in PLACE])


def distinct_lines(found: DataFrame) -> DataFrame:
    """One row per different line: its first place and how often it occurs."""
    return found.groupBy("k1", "k2").agg(
        F.min(_place()).alias("first"), F.count("*").alias("n"), F.min("halves").alias("halves")
    )


def candidates(lines: DataFrame) -> DataFrame:
    """First places of lines that share a half with another line, per document as 4 * line + kind of the half."""
    halves = lines.select("first", F.posexplode("halves").alias("kind", "half"))
    # Distinct keys on the hashed side: no task holds more of them than its share.
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half").hint("shuffle_hash")
    places = halves.join(shared, "half", "left_semi").select(
        "first.no_id", "first.doc_id", "first.text_hash", (F.col("first.line").cast("bigint") * 4 + F.col("kind")).alias("mark")
    )
    return places.groupBy("no_id", "doc_id", "text_hash").agg(F.collect_list("mark").alias("marks"))


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Place, digest and words of every candidate line, and the kinds of halves it shares, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (text, marks) in enumerate(zip(batch.column(3).cast(pa.binary()), batch.column(4), strict=True)):
                lines, kinds = text.as_py().split(b"\n"), {}
                for mark in sorted(set(marks.as_py())):
                    kinds[mark >> 2] = kinds.get(mark >> 2, 0) | 1 << (mark & 3)
                # Bytes have the blanks and the lower case of lines.
                words = [b" ".join(lines[i].lower().split()) for i in kinds]
                k = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in words]), "<u8").reshape(-1, 2)
                one = pa.array([row] * len(kinds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(one) for c in range(3)]
                    + [
                        pa.array(list(kinds), pa.int32()),
                        pa.array(words, pa.binary()).cast(pa.string()),
                        pa.array(list(kinds.values()), pa.int32()),
                        _signed(k[:, 0]),
                        _signed(k[:, 1]),
                    ],
                    names=[*PLACE, "content", "kinds", "k1", "k2"],
                )

    joined = _named(docs).join(wanted.hint("shuffle_hash"), ["no_id", "doc_id", "text_hash"])
    # Repeated rows give the same lines again.
    return (
        joined.select("no_id", "doc_id", "text_hash", "text", "marks")
        .mapInArrow(
            run, "no_id boolean, doc_id bigint, text_hash bigint, line int, content string, kinds int, k1 bigint, k2 bigint"
        )
        .dropDuplicates(PLACE)
    )


def variants(texts: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Hashed variants of each candidate: itself (``at`` = -1) and itself without word ``at``.

    Another line within one edit that shares the first half differs after it only, and before the last half if it
    shares that one; both lines share the half, so both leave out the words there.  A line stands whole for longer ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = batch.column(5).to_numpy()
            for row, end, data, offsets in slices(batch.column(4), 1 << 18):
                words, rows = word_hashes(data, offsets, lower=True)
                n = np.diff(rows)
                _, half, before, _ = band_halves(n, least)
                of = np.repeat(np.arange(len(n)), n + 1)
                at = np.arange(len(of)) - (rows[:-1] + np.arange(len(n)))[of] - 1
                kinds, half, before = shares[row:end][of], half[of], before[of]
                wanted = np.where(at < half, kinds & 2, kinds & 1) | np.where(at < before, kinds & 8, kinds & 4)
                wanted = np.where(at < 0, kinds & 3, wanted) > 0
                of, at = of[wanted], at[wanted]
                first, last = rows[:-1][of], rows[1:][of]
                keys = [range_hashes(words, first, last, first + at, which) for which in (0, 1)]
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c)[row:end].take(take) for c in range(4)]
                    + [_signed(keys[0]), _signed(keys[1]), pa.array(at, pa.int32())],
                    names=[*PLACE, "v1", "v2", "at"],
                )

    return texts.select(*PLACE, "content", "kinds").mapInArrow(
        run,
        "no_id boolean, doc_id bigint, text_hash bigint, line int, v1 bigint, v2 bigint, at int",
    )


def shared_variants(emitted: DataFrame) -> DataFrame:
    """The variants whose hash occurs more than once; few do."""
    shared = emitted.groupBy("v1").agg(F.count("*").alias("n")).filter("n > 1").select("v1")
    return emitted.join(shared.hint("shuffle_hash"), "v1", "left_semi")


def within_one_edit(a: list, b: list) -> bool:
    """Whether one insertion, deletion or replacement at most turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    least, most = sorted((len(a), len(b)))
    head = 0
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head + tail >= most - 1


def partners(emitted: DataFrame) -> DataFrame:
    """(me, lead): every line with an earlier line that shares a variant, and the earliest such.

    Lines with the same variant at the same place differ in that word only: all but the
    earliest have the earliest as partner.  A line that is itself a variant of others has
    the earliest of them as partner, and they have it.  So each line meets one leader per
    variant, and a group of any size costs as many rows as it has members.
    """
    places = emitted.groupBy("v1", "v2", "at").agg(F.min(_place()).alias("lead"), F.count("*").alias("n"))
    whole, cut = F.col("at") == -1, F.col("at") >= 0
    # A variant has at most one more place than words, so the map is as small as a line.
    groups = places.groupBy("v1", "v2").agg(
        F.min(F.when(whole, F.col("lead"))).alias("whole"),
        F.min(F.when(cut, F.col("lead"))).alias("cut"),
        F.sum("n").alias("n"),
        F.map_from_entries(F.collect_list(F.when(cut & (F.col("n") > 1), F.struct("at", "lead")))).alias("leads"),
    )
    members = emitted.select("v1", "v2", "at", _place().alias("me"))
    both = members.join(groups.filter("n > 1"), ["v1", "v2"])
    lead = F.least(
        F.when(F.col("at") == -1, F.col("cut")).otherwise(F.col("whole")),
        F.when(F.col("at") >= 0, F.element_at("leads", F.col("at"))),
    )
    found = both.select("me", lead.alias("lead")).filter(F.col("lead") < F.col("me"))
    return found.groupBy("me").agg(F.min("lead").alias("lead"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Digests of the lines whose leader's words are within one edit of theirs."""

    @F.pandas_udf(BooleanType())
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype=bool)

    mine = texts.select(_place().alias("me"), F.col("content").alias("mine"), "k1", "k2")
    other = texts.select(_place().alias("lead"), F.col("content").alias("other"))
    return pairs.join(mine, "me").join(other, "lead").filter(close("mine", "other")).select("k1", "k2")


def cut_lines(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows without the lines ``numbers`` of ``rows``."""
    starts, of = line_starts(data, offsets)
    firsts = np.searchsorted(of, np.arange(len(offsets)))
    stays = np.ones(len(starts), dtype=bool)
    stays[firsts[rows] + numbers] = False
    kept = np.repeat(stays, np.diff(np.append(starts, len(data))))
    # A line ends with its line feed, but for the last one: where that goes, the last to stay loses its own.
    lasts = firsts[1:] - 1
    where = np.flatnonzero(stays)
    ahead = np.searchsorted(where, firsts)
    short = ~stays[lasts] & (np.diff(ahead) > 0)
    kept[starts[where[ahead[1:][short] - 1] + 1] - 1] = False
    place = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kept, out=place[1:])
    return data[kept], place[offsets]


@F.arrow_udf(StringType())
def _without_lines(text: pa.Array, gone: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.large_string())]
    for row, end, data, offsets in slices(text):
        lists = gone[row:end]
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
        rows = np.repeat(np.arange(end - row), sizes)
        data, offsets = cut_lines(data, offsets, rows, lists.flatten().to_numpy())
        parts.append(pa.LargeStringArray.from_buffers(end - row, pa.py_buffer(offsets), pa.py_buffer(data)))
    return pa.concat_arrays(parts).cast(text.type)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``, and ``n_lines``, ``n_removed``.

    Lines are split at line feeds.  A line stays if it has no word, or if no line before
    it is the same or, both having ``least_words`` words, within one edit; lines are
    judged on the input, not on what is left.  Lines come in the order of doc_id (null
    last) and line number; rows with one doc_id but different texts in the order of a
    hash of the text, and rows equal in both stay or lose their lines together.  A
    document keeps its row even if nothing is left of its text; a null text stays null
    and has no lines.  Other columns are kept; existing ones with the two added names
    are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(occurrences(docs, least_words), "occurrences")
    lines = scratch.keep(distinct_lines(found), "lines")
    texts = scratch.keep(candidate_texts(docs, candidates(lines)), "texts")
    emitted = scratch.keep(variants(texts, least_words), "variants")
    shared = scratch.keep(shared_variants(emitted), "shared")
    scratch.drop(emitted)
    near = scratch.keep(verified(partners(shared), texts), "near")
    scratch.drop(shared, texts)
    first = lines.schema["first"].dataType
    repeated = lines.filter("n > 1").select("k1", "k2", "first").unionAll(near.select("k1", "k2", F.lit(None).cast(first)))
    gone = scratch.keep(
        found.select("k1", "k2", *PLACE)
        .join(repeated.hint("shuffle_hash"), ["k1", "k2"])
        .filter(F.col("first").isNull() | (F.col("first") != _place()))
        .groupBy("no_id", "doc_id", "text_hash")
        .agg(F.collect_set("line").alias("gone")),
        "gone",
    )
    scratch.drop(found, lines, near)
    keyed = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], *_key_columns())
    cut = gone.toDF("_no_id", "_doc_id", "_text_hash", "_gone").hint("shuffle_hash")
    joined = keyed.join(cut, ["_no_id", "_doc_id", "_text_hash"], "left")
    text = F.col("text").cast("string")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    # Texts that stay whole are not sent to Python.
    shorter = _without_lines(F.when(F.col("_gone").isNotNull(), text), "_gone")
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("bigint"))
        .withColumn("n_removed", F.greatest(F.size("_gone"), F.lit(0)).cast("bigint"))
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(shorter))
        .drop("_no_id", "_doc_id", "_text_hash", "_gone")
    )
