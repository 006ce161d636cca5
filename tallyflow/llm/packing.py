"""Packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are the binary digits of its token
count (longest first, at most ``most``), and every piece is a sequence of its own.
Equal lengths form a bucket from which batches are drawn, so no sequence crosses
documents and nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.encoders import byte_bpe_encoder
from tallyflow.llm.scratch import Scratch

#: Id that ends every document.
END_ID = 1
#: Longest sequence; a power of two.
MOST = 2048
#: Characters whose ids are held at a time.
SLICE_CHARS = 1 << 22

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


def binary_lengths(n: int, most: int = MOST) -> list[int]:
    """Descending powers of two that add up to ``n``, none above ``most``."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def _batch(doc_ids: list, tokens: list[np.ndarray], most: int) -> pa.RecordBatch:
    lengths = [binary_lengths(len(t), most) for t in tokens]
    per_doc = np.array([len(x) for x in lengths], dtype=np.int64)
    flat = np.array([x for xs in lengths for x in xs], dtype=np.int64)
    ends = np.cumsum(flat)
    totals = np.array([len(t) for t in tokens], dtype=np.int64)
    doc_first = np.cumsum(totals) - totals
    ids = np.concatenate(tokens).astype("<u4", copy=False)
    offsets = np.concatenate(([0], ends * 4)).astype(np.int64)
    blobs = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(doc_ids)), per_doc))),
            pa.array(ends - flat - np.repeat(doc_first, per_doc)),
            pa.array(flat),
            blobs.cast(pa.binary()),
            pa.array(np.repeat(totals, per_doc)),
        ],
        names=["doc_id", "start", "length", "ids", "doc_tokens"],
    )


def decompose(docs: DataFrame, tokenizer: str, end_id: int = END_ID, most: int = MOST) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens``.

    ``ids`` holds the ids as little-endian unsigned 32-bit integers.  A null or empty
    text is the end id alone.  Every row is a document, repeated rows and null doc_ids
    too.  Other columns are ignored.  A piece is at most ``most`` ids, ids of about
    ``SLICE_CHARS`` characters are in memory at a time, and a very long text is encoded
    in parts that cannot influence each other.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe_encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            ids, tokens, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id.as_py())
                tokens.append(np.concatenate((encode(text), end)))
                held += len(text)
                if held > SLICE_CHARS:
                    yield _batch(ids, tokens, most)
                    ids, tokens, held = [], [], 0
            if ids:
                yield _batch(ids, tokens, most)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Adds ``sequence_id`` (unique) and ``offset`` (0: a piece is the whole sequence).

    The pieces are written first: numbers follow the rows of fixed files, so a task
    that runs again gives the same numbers, and nothing has to be shuffled.
    """
    fixed = Scratch(pieces.sparkSession).keep(pieces, "pieces")
    return fixed.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Writes sequences with one folder per length."""
    sequences.write.partitionBy("length").parquet(path)


def with_digest(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by its CRC-32."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
