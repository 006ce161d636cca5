"""Suffix-array dedup of byte strings by a hash-compared suffix sort.

A string of ``WINDOW`` bytes that also starts earlier is removed.  Equal strings must
meet, but not all positions of a corpus can be shuffled, so every window is assigned to
its anchor: the leftmost of its ``GRAM``-byte grams with the smallest hash.  Equal windows
have equal anchors at the same offset.  Consecutive windows with one anchor form a run,
and a run is one row:

* a gram that occurs once in the corpus has no repeated windows;
* a run whose bytes all occur earlier, around the same gram, is repeated as a whole: runs are
  the same if 128-bit cryptographic digests of their bytes are;
* the first runs of a gram that has several different ones go through the suffix sort.
  Suffixes are compared by the longest common extension, found by binary search over
  prefix polynomial hashes in about seven steps, and are merge-sorted; windows found
  equal are verified byte by byte, so a hash collision removes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyflow.llm.scratch import Scratch
from tallyflow.llm.textscan import SCAN_BYTES, U64, byte_values, mix64, utf8

#: Length of a repeated string, and of the grams that anchor it.
WINDOW = 100
GRAM = 32
#: Contexts sorted together, if their grams allow; a gram with more than ``HOT_RUNS`` is split by single windows.
BLOCK_RUNS = 8_000
HOT_RUNS = 20_000

KEY = ["id", "text_hash"]


_BASE = U64(0x9E3779B97F4A7C15)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and its inverse powers modulo 2^64, i <= SCAN_BYTES."""

    def series(x: np.uint64) -> np.ndarray:
        out = np.full(SCAN_BYTES + 1, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(_BASE), series(U64(pow(int(_BASE), -1, 1 << 64)))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at every place."""
    power, inverse = _powers()
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_values(False)[data] * power[: len(data)], out=prefix[1:])
    n = len(data) - gram + 1
    return mix64((prefix[gram:] - prefix[:n]) * inverse[:n] + U64(gram))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(
    data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first window, last window, anchor, gram hash, digest of the run.

    ``data`` is no longer than ``SCAN_BYTES``.  Positions count from the start of ``data``.
    The digest (two longs) is a cryptographic one of the run's bytes, tied to the place of the
    anchor among them.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none, none.astype(np.uint64), np.zeros((0, 2), np.uint64)
    at = np.arange(len(data) - gram + 1)
    grams = _gram_hashes(data, gram)
    place = U64(SCAN_BYTES - 1)
    least = sliding_min((grams & ~place) | at.astype(np.uint64), window - gram + 1)
    anchor = (least & place).astype(np.int64)
    windows = np.arange(len(anchor))
    row = np.searchsorted(offsets, windows, side="right") - 1
    inside = windows + window <= offsets[row + 1]
    windows, anchor, row = windows[inside], anchor[inside], row[inside]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    first, anchor, row = windows[start], anchor[start], row[start]
    last = windows[np.append(start[1:], len(windows)) - 1] if len(start) else none
    raw, blake = data.tobytes(), hashlib.blake2b
    whole = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)])
    whole = np.frombuffer(whole, "<u8").reshape(-1, 2) ^ mix64((anchor - first).astype(np.uint64) + U64(1))[:, None]
    return row, first, last, anchor, grams[anchor], whole


def _key_columns() -> list[Column]:
    """id (the largest for null) and a hash of the text: they order and name documents."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(doc_id, F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")]


def _parts(column: pa.Array, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before, data, offsets): rows together, or overlapping parts of a long row."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SCAN_BYTES, side="right")) - 1
        if end > row:
            yield row, 0, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end
            continue
        text = data[offsets[row] : offsets[row + 1]]
        step = SCAN_BYTES - window + 1
        for at in range(0, max(len(text) - window + 1, 1), step):
            part = text[at : at + SCAN_BYTES]
            yield row, at, part, np.array([0, len(part)])
        row += 1


def all_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``gram, whole, check, id, text_hash, place`` of every run of windows.

    ``place`` holds the first window's start, the anchor's distance from it and the last
    window's (7 bits each), so that places of a document sort by start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row0, before, data, offsets in _parts(batch.column(2), window):
                row, first, last, anchor, grams, whole = runs(data, offsets, window, gram)
                place = ((first - offsets[row] + before) << 14) | ((anchor - first) << 7) | (last - first)
                take = pa.array(row + row0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64))]
                    + [pa.array(whole[:, k].copy().view(np.int64)) for k in (0, 1)]
                    + [batch.column(c).take(take) for c in (0, 1)]
                    + [pa.array(place)],
                    names=["gram", "whole", "check", *KEY, "place"],
                )

    return docs.select(*_key_columns()).mapInArrow(
        run, "gram bigint, whole bigint, check bigint, id bigint, text_hash bigint, place bigint"
    )


def _place() -> Column:
    return F.struct(*KEY, "place")


def _range_columns(window: int) -> list[Column]:
    start = F.shiftright("place", 14)
    return [*[F.col(c) for c in KEY], start.alias("from"), (start + F.col("place").bitwiseAND(127) + window).alias("to")]


def contexts(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """Bytes around the anchors of runs: from the first window to ``window`` bytes after the anchor's start.

    Columns ``gram, hot, id, text_hash, place, bytes``.
    """
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "hot", "place")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            lists = batch.column(3)
            of = pa.array(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)))
            flat = lists.flatten()
            grams, hot, places = (flat.field(i) for i in range(3))
            place = places.to_numpy(zero_copy_only=False)
            rows = of.to_numpy()
            start = offsets[rows] + (place >> 14)
            end = np.minimum(start + ((place >> 7) & 127) + window, offsets[rows + 1])
            # The last window may end after the anchor's own reach.
            end = np.maximum(end, start + (place & 127) + window)
            raw = data.tobytes()
            for at in range(0, len(rows), 20_000):
                cut = slice(at, at + 20_000)
                blobs = [raw[a:b] for a, b in zip(start[cut].tolist(), end[cut].tolist(), strict=True)]
                take = of[cut]
                yield pa.RecordBatch.from_arrays(
                    [grams[cut], hot[cut], batch.column(0).take(take), batch.column(1).take(take), places[cut]]
                    + [pa.array(blobs, pa.binary())],
                    names=["gram", "hot", *KEY, "place", "bytes"],
                )

    # Repeated rows of a document give its runs again.
    joined = docs.select(*_key_columns()).dropDuplicates(KEY).join(lists, KEY)
    return joined.select(*KEY, "text", "runs").mapInArrow(
        run, "gram bigint, hot boolean, id bigint, text_hash bigint, place bigint, bytes binary"
    )


class Suffixes:
    """Suffixes of one byte array, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, limit: int) -> None:
        self.data = data
        self.limit = limit
        power = np.full(len(data) + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        back = np.full(len(data) + 1, U64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        back[0] = 1
        self._back = np.multiply.accumulate(back)
        self._prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte_values(False)[data] * power[:-1], out=self._prefix[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._prefix[ends] - self._prefix[starts]) * self._back[starts]

    def common(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes a and b, ``limit`` at most, by binary search."""
        low = np.zeros(len(a), dtype=np.int64)
        high = np.minimum(np.minimum(a_end - a, b_end - b), self.limit)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hash(a, a + middle) == self.hash(b, b + middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; where they are equal to the limit, ``equal``."""
        n = self.common(a, a_end, b, b_end)
        a_over, b_over = (a + n >= a_end) | (n == self.limit), (b + n >= b_end) | (n == self.limit)
        last = len(self.data) - 1
        less = self.data[np.minimum(a + n, last)] < self.data[np.minimum(b + n, last)]
        return np.where(a_over & b_over, equal, np.where(a_over | b_over, a_over, less))

    def sort(self, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (ascending, contiguous): a bottom-up merge sort.

        All merges of one width are done at once: each suffix finds its rank in the
        neighbouring run by binary search with logarithmic comparisons.
        """
        order = np.arange(len(starts))
        first = np.searchsorted(group, group)
        size = np.searchsorted(group, group, side="right") - first
        width = 1
        while True:
            busy = np.flatnonzero(size > width)
            if not len(busy):
                return order
            local = busy - first[busy]
            run = local // width
            sibling = (run ^ 1) * width
            low = np.minimum(sibling, size[busy])
            high = np.minimum(sibling + width, size[busy])
            base, is_left = low.copy(), run % 2 == 0
            mine = order[busy]
            while (low < high).any():
                open_ = np.flatnonzero(low < high)
                middle = (low[open_] + high[open_]) >> 1
                other = order[first[busy[open_]] + middle]
                own = mine[open_]
                # The left run goes first where suffixes are equal.
                ahead = self.before(starts[other], ends[other], starts[own], ends[own], ~is_left[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            begin = np.minimum(run, run ^ 1) * width
            target = first[busy] + begin + (local - run * width) + (low - base)
            order = order.copy()
            order[target] = mine
            width *= 2


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Collision verification: whether the windows at a and b have the same bytes."""
    inside = np.arange(window)
    parts = [
        (data[a[i : i + 50_000, None] + inside] == data[b[i : i + 50_000, None] + inside]).all(axis=1)
        for i in range(0, len(a), 50_000)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def repeated_windows(
    group: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, anchor: np.ndarray, last: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of all windows that an earlier context of its group has too.

    Contexts come in groups, the earliest first.  ``anchor`` and ``last`` are the distances
    of the anchor and the last window from the first one.  Sorted by what follows the
    anchor, contexts that share k bytes after it are neighbours, so for every distance
    between window and anchor the sort gives classes, which the hash of the bytes before
    the anchor divides further.
    """
    suffixes = Suffixes(data, window)
    anchors = starts + anchor
    order = suffixes.sort(anchors, ends, group)
    a, b = order[:-1], order[1:]
    common = suffixes.common(anchors[a], ends[a], anchors[b], ends[b])
    common[group[a] != group[b]] = -1
    found_context, found_window = [], []
    for ahead in range(int(anchor.max(initial=-1)) + 1):
        segment = np.concatenate(([0], np.cumsum(common < window - ahead)))
        has = (anchor[order] >= ahead) & (anchor[order] - last[order] <= ahead)
        k, segment = order[has], segment[has]
        left = suffixes.hash(anchors[k] - ahead, anchors[k])
        by = np.lexsort((k, left, segment))
        k, segment, left = k[by], segment[by], left[by]
        lead = np.ones(len(k), dtype=bool)
        lead[1:] = (segment[1:] != segment[:-1]) | (left[1:] != left[:-1])
        leader = k[np.maximum.accumulate(np.where(lead, np.arange(len(k)), 0))]
        k = k[~lead][_equal_bytes(data, anchors[k[~lead]] - ahead, anchors[leader[~lead]] - ahead, window)]
        found_context.append(k)
        found_window.append(anchor[k] - ahead)
    if not found_context:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_context), np.concatenate(found_window)


def _merged(context: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) of runs of consecutive windows."""
    by = np.lexsort((at, context))
    context, at = context[by], at[by]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (context[1:] != context[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return context[begin], at[begin], at[end] if len(begin) else begin


def sorted_repeats(around: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ranges of repeated windows among the contexts of each gram, by suffix sort."""

    def process(table: pa.Table) -> pa.RecordBatch:
        blobs = table.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(blobs), np.uint8)
        lengths = np.array([len(x) for x in blobs], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        place = table.column("place").to_numpy()
        grams = table.column("gram").to_numpy()
        group = np.concatenate(([0], np.cumsum(grams[1:] != grams[:-1])))
        context, at = repeated_windows(
            group, data, offsets[:-1], offsets[1:], (place >> 7) & 127, place & 127, window
        )
        context, first, last = _merged(context, at)
        start = place[context] >> 14
        take = pa.array(context)
        return pa.RecordBatch.from_arrays(
            [table.column(c).combine_chunks().take(take) for c in KEY]
            + [pa.array(start + first), pa.array(start + last + window)],
            names=[*KEY, "from", "to"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grams = batch.column(0).to_numpy()
            change = np.flatnonzero(grams[1:] != grams[:-1]) + 1
            if held and held[-1].num_rows and held[-1].column(0)[-1].as_py() != grams[0]:
                change = np.concatenate(([0], change))
            # Whole grams only: what follows the last change waits for the next batch.
            if len(change) and sum(b.num_rows for b in held) + int(change[-1]) >= BLOCK_RUNS:
                held.append(batch.slice(0, int(change[-1])))
                yield process(pa.Table.from_batches(held))
                held = [batch.slice(int(change[-1]))]
            else:
                held.append(batch)
        if sum(b.num_rows for b in held):
            yield process(pa.Table.from_batches(held))

    placed = around.filter(~F.col("hot")).select("gram", *KEY, "place", "bytes")
    near = placed.repartition(F.col("gram")).sortWithinPartitions("gram", *KEY, "place")
    return near.mapInArrow(run, "id bigint, text_hash bigint, from bigint, to bigint")


def split_repeats(around: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same for grams with too many contexts for one task: single windows, grouped by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                place = part.column(2).to_numpy()
                count = (place & 127) + 1
                of = np.repeat(np.arange(len(place)), count)
                step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                texts = part.column(3).to_pylist()
                blobs = [texts[k][s : s + window] for k, s in zip(of.tolist(), step.tolist(), strict=True)]
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blobs, pa.binary()), part.column(0).take(take), part.column(1).take(take)]
                    + [pa.array((place >> 14)[of] + step)],
                    names=["bytes", *KEY, "start"],
                )

    rows = around.filter("hot").select(*KEY, "place", "bytes").mapInArrow(
        run, "bytes binary, id bigint, text_hash bigint, start bigint"
    )
    rows = rows.select("bytes", *KEY, "start", F.struct(*KEY, "start").alias("me"))
    firsts = rows.groupBy("bytes").agg(F.min("me").alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = rows.join(firsts, "bytes").filter(F.col("me") != F.col("first"))
    return found.select(*KEY, F.col("start").alias("from"), (F.col("start") + window).alias("to"))


_CUT = StructType(
    [
        StructField("n_bytes", LongType()),
        StructField("n_removed", LongType()),
        StructField("n_spans", LongType()),
        StructField("kept_sha256", StringType()),
    ]
)


def spans_of(ranges: list | None) -> list[tuple[int, int]]:
    """Maximal removed spans: ranges that touch or overlap are one."""
    out: list[list[int]] = []
    for begin, end in sorted((r["from"], r["to"]) for r in (ranges if ranges is not None else [])):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def keep_bytes(text: str | None, spans: list[tuple[int, int]]) -> bytes:
    """The UTF-8 bytes of a text outside the spans."""
    raw = (text or "").encode()
    edges = [0, *[x for span in spans for x in span], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """``id, text_hash, ranges``: byte ranges that are covered by repeated strings, by document."""
    scratch = Scratch(docs.sparkSession)
    found = all_runs(docs, window, gram)
    grams = found.groupBy("gram").agg(
        F.count("*").alias("n"), F.min(F.struct("whole", "check")).alias("low"), F.max(F.struct("whole", "check")).alias("high")
    )
    grams = scratch.keep(grams.filter("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")), "grams")
    shared = scratch.keep(found.join(grams, "gram"), "shared")
    run = ["gram", "whole", "check"]
    firsts = shared.groupBy(*run).agg(
        F.min(_place()).alias("first"), F.count("*").alias("n"), F.max("mixed").alias("mixed")
    )
    firsts = scratch.keep(firsts, "firsts")
    again = shared.join(firsts.filter("n > 1").select(*run, "first"), run)
    again = scratch.keep(again.filter(F.col("first") != _place()).select(*_range_columns(window)), "again")
    several = firsts.filter("mixed").select("gram", "first.*")
    most = several.groupBy("gram").agg((F.count("*") > (hot or HOT_RUNS)).alias("hot"))
    around = scratch.keep(contexts(docs, several.join(most, "gram"), window), "contexts")
    scratch.drop(grams, shared, firsts)
    ranges = again.unionByName(sorted_repeats(around, window)).unionByName(split_repeats(around, window))
    lists = ranges.groupBy(*KEY).agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    lists = scratch.keep(lists, "ranges")
    scratch.drop(again, around)
    return lists


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """All columns of ``docs`` with ``spans``: the byte spans of its text that are repeated.

    Each byte of the UTF-8 text is repeated that is covered by a ``window``-byte string
    that also starts earlier: in a document with a smaller doc_id (null counts as the
    largest, equal ones are ordered by a hash of the text), or earlier in the same one.
    Strings are judged on the input, overlaps count, and none crosses documents.  A null
    text is empty.  Rows equal in doc_id and text are one document listed twice and get
    the same spans.  An existing column ``spans`` is replaced.  ``keep_bytes`` cuts them.
    """
    ranges = repeated_ranges(docs, window, gram, hot).toDF("_id", "_text_hash", "_ranges")

    @F.pandas_udf("array<struct<from:bigint,to:bigint>>")
    def merged(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"from": a, "to": b} for a, b in spans_of(x)] for x in lists], dtype=object)

    id_, text_hash, _ = _key_columns()
    keyed = docs.select(*[c for c in docs.columns if c != "spans"], id_.alias("_id"), text_hash.alias("_text_hash"))
    joined = keyed.join(ranges, ["_id", "_text_hash"], "left")
    return joined.withColumn("spans", merged("_ranges")).drop("_id", "_text_hash", "_ranges")


def with_digest(cut: DataFrame) -> DataFrame:
    """``n_bytes, n_removed, n_spans, kept_sha256`` in place of ``text`` and ``spans``."""

    @F.pandas_udf(_CUT)
    def digest(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ranges in zip(text, spans, strict=True):
            pairs = [(r["from"], r["to"]) for r in ranges]
            kept = keep_bytes(t, pairs)
            removed = sum(b - a for a, b in pairs)
            rows.append((len(kept) + removed, removed, len(pairs), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut.withColumn("_cut", digest("text", "spans")).select("*", "_cut.*").drop("_cut", "text", "spans")
