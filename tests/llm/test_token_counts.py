import random

import public_tokenizers
import pytest

from tallyflow.llm.token_counts import count_tokens, encode_long, piece_encoder

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _texts():
    rng = random.Random(5)
    alphabet = "ab  e the ing\n\n\t0123éèß漢字😀▁.,-" + "́"
    yield "a" * 5000
    yield " " * 3000
    yield "ab" * 2500
    yield "漢" * 2000
    yield "😀" * 700 + "x" * 900
    for n in (1, 2, 50, 700, 4000):
        yield "".join(rng.choice(alphabet) for _ in range(n))
        yield " ".join(rng.choice(["the", "ing", "<s>", "of", "naïve", "▁x", "  "]) for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (200, 16), (1000, 64)])
def test_chunks_give_the_ids_of_the_whole_text(chunk, overlap):
    encoder = piece_encoder(MODEL)
    for text in _texts():
        assert encode_long(encoder, text, chunk, overlap).tolist() == encoder.model.encode(text)


def test_long_runs_cost_little_more_than_the_whole_text():
    encoder = piece_encoder(MODEL)

    class Counted:
        chars, is_byte = 0, encoder.is_byte

        def placed(self, text, start, end):
            Counted.chars += end - start
            return encoder.placed(text, start, end)

        encode = encoder.encode

    for text in (" " * 5_000_000, "a" + " " * 600_000 + "b", "word " * 30_000 + " " * 400_000 + "x" * 300_000 + "more " * 30_000):
        Counted.chars = 0
        assert encode_long(Counted(), text).tolist() == encoder.model.encode(text)
        assert Counted.chars < 5 * len(text)


def test_counts_equal_the_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = piece_encoder(MODEL).model
    want = {
        r.doc_id: (len(r.text.encode()), len(ids := model.encode(r.text)), len(ids) > 4096) for r in docs.collect()
    }
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, MODEL).collect()}
    assert got == want


def test_edge_rows(spark):
    long = "word and more\n" * 5000
    rows = [(1, None), (1, None), (None, ""), (2, long), (2, long), (3, " ")]
    docs = spark.createDataFrame([(t, d, d, 7) for d, t in rows], "text string, doc_id bigint, n_tokens bigint, n_bytes int")
    model = piece_encoder(MODEL).model
    want = sorted((str(d), len((t or "").encode()), len(model.encode(t or ""))) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in count_tokens(docs, MODEL).collect()) == want
    assert count_tokens(docs.limit(0), MODEL).count() == 0
