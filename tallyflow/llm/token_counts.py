"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``LONG_CHARS`` characters is encoded at once.  A longer one is
encoded in overlapping chunks, and the ids of neighbouring chunks are spliced at a
token that both contain at the same place.  The splice is exact for BPE: ids encode a
text if and only if every two neighbours in it encode their own concatenation (the
first merge across a boundary would depend on nothing but the two tokens beside it),
and each two neighbours of a splice at a common token are neighbours in one of the
two chunks.  Where an overlap holds no common token it is widened, in the end to the
whole text.  Widening doubles the left chunk, so the work stays linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters from which a text is encoded in chunks, and of a chunk.
LONG_CHARS = 1 << 15
CHUNK_CHARS = 1 << 14
#: Characters that two chunks share at first.
OVERLAP_CHARS = 256
#: Characters of short texts encoded by one call.
SLICE_CHARS = 1 << 21
#: A document with more tokens than this is over the limit.
LIMIT = 4096

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class PieceEncoder:
    """A sentencepiece model with the number of characters that each id stands for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        lengths = [len(self.model.id_to_piece(i)) for i in range(n)]
        for i in np.flatnonzero(self.is_byte).tolist():
            # <0xNN>: the first byte of a character counts as the character.
            lengths[i] = 0 if 0x80 <= int(self.model.id_to_piece(i)[3:5], 16) < 0xC0 else 1
        self.lengths = np.array(lengths, dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text), dtype=np.int64)

    def placed(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``text[start:end]`` and where each ends in ``text``; None if the model rewrites the text.

        The blank that a model may put before a text counts one character before ``start``.
        """
        ids = self.encode(text[start:end])
        ends = np.cumsum(self.lengths[ids]) + start
        extra = int(ends[-1]) - end if len(ids) else 1
        return (ids, ends - extra) if extra in (0, 1) else None


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@dataclass
class _Chunk:
    """``text[start:end]`` encoded: ids, and where each ends in the text; ``since`` ids come from the chunk before."""

    start: int
    end: int
    ids: np.ndarray
    ends: np.ndarray
    since: int = 0


def _common(encoder: PieceEncoder, left: _Chunk, right: _Chunk) -> tuple[int, int] | None:
    """Positions after a token that both encodings hold at the same place, in the middle of all such."""
    # Only tokens that follow another one are compared: the first one of a chunk may hold
    # a blank that the text has not, and a token starts where the one before it ends.
    skip = max(int(np.searchsorted(left.ends, right.start)), left.since, 1)
    stop = int(np.searchsorted(right.ends, left.end, side="right"))
    _, i, j = np.intersect1d(left.ends[skip:], right.ends[1:stop], return_indices=True)
    i, j = i + skip, j + 1
    same = (left.ids[i] == right.ids[j]) & (left.ends[i - 1] == right.ends[j - 1]) & (j > 1) & ~encoder.is_byte[left.ids[i]]
    at = np.flatnonzero(same)
    if not len(at):
        return None
    return int(i[at[len(at) // 2]]) + 1, int(j[at[len(at) // 2]]) + 1


def encode_long(encoder: PieceEncoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """Ids of the whole text, encoded chunk by chunk.

    Where two neighbours hold no common token, the overlap is widened forwards: the left chunk is encoded
    anew to twice its length, and the right one starts before its new end.  A region without common
    tokens thus costs about twice its own length, however long it is.
    """

    def placed(start: int, end: int) -> _Chunk | None:
        found = encoder.placed(text, start, end)
        return None if found is None else _Chunk(start, end, *found)

    first = placed(0, min(len(text), chunk))
    if first is None:
        return encoder.encode(text)
    #: Chunks, and for each but the last how many of its ids count.
    chunks, counts = [first], []
    while chunks[-1].end < len(text):
        last = chunks[-1]
        start = last.end - min(overlap, last.end - last.start)
        right = placed(start, min(len(text), start + chunk))
        if right is None:
            return encoder.encode(text)
        cut = _common(encoder, last, right)
        if cut is not None:
            counts.append(cut[0])
            right.since = cut[1]
            chunks.append(right)
            continue
        begin, goal = last.start, min(len(text), last.end + max(last.end - last.start, chunk))
        chunks.pop()
        while True:
            wide = placed(begin, goal)
            if wide is None:
                return encoder.encode(text)
            if chunks:
                counts.pop()
                cut = _common(encoder, chunks[-1], wide)
                if cut is None:
                    begin = chunks.pop().start
                    continue
                counts.append(cut[0])
                wide.since = cut[1]
            chunks.append(wide)
            break
    counts.append(len(chunks[-1].ids))
    return np.concatenate([c.ids[c.since : n] for c, n in zip(chunks, counts, strict=True)])


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Counts are those of ``sentencepiece`` for the whole text, without begin or end ids.
    A null text counts as empty (0 bytes, 0 tokens); repeated rows and null doc_ids stay
    as they are; other columns are ignored.  Memory is bounded by the longest text and
    ``SLICE_CHARS``, never by the encoder's work on a whole long text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        for batch in batches:
            column = batch.column(1).fill_null("")
            counts = np.zeros(len(column), dtype=np.int64)
            rows: list[int] = []
            texts: list[str] = []
            held = 0

            def flush() -> None:
                counts[rows] = [len(ids) for ids in encoder.model.encode(texts, num_threads=1)] if texts else []  # noqa: B023
                rows.clear(), texts.clear()  # noqa: B023

            for row, value in enumerate(column):
                text = value.as_py()
                if len(text) > LONG_CHARS:
                    counts[row] = len(encode_long(encoder, text))
                    continue
                rows.append(row)
                texts.append(text)
                held += len(text)
                if held > SLICE_CHARS:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(column).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, COUNTS)
