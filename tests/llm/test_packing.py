import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyflow.llm.encoders import byte_bpe_encoder
from tallyflow.llm.packing import binary_lengths, decompose, number_sequences, with_digest, write_buckets

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_same_ids_as_tokenizers_around_every_code_point():
    plain, fast = Tokenizer.from_file(PATH), byte_bpe_encoder(PATH)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    texts = [f"ab{chr(c)}cd {chr(c)} 1{chr(c)}{chr(c)}.{chr(c)}'s" for c in rng.sample(points, 30_000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|> b", " <|endoftext|><|endoftext|>x", "<|endoftext|", "a" * 3000]
    assert [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)] == [fast(t).tolist() for t in texts]


def test_long_texts_are_cut_where_it_makes_no_difference(monkeypatch):
    monkeypatch.setattr("tallyflow.llm.encoders.PART_CHARS", 40)
    plain, fast = Tokenizer.from_file(PATH), byte_bpe_encoder(PATH)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "\n", "\t", "'s", "é", "1", ".", "  ", " ", "the"]) for _ in range(400))
        assert fast(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_binary_lengths():
    for n in [1, 2, 3, 2047, 2048, 2049, 10_000]:
        lengths = binary_lengths(n)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 2048 for x in lengths)


def test_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plain = Tokenizer.from_file(PATH)
    want = {r.doc_id: plain.encode(r.text, add_special_tokens=False).ids + [1] for r in docs.collect()}
    got, digests = {}, {}
    rows = number_sequences(decompose(docs, PATH)).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.offset == 0 and r.start == len(got.get(r.doc_id, []))
        got.setdefault(r.doc_id, []).extend(ids)
        digests[r.doc_id, r.start] = zlib.crc32(bytes(r.ids))
    assert got == want
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert {(r.doc_id, r.start): r.ids_crc32 for r in with_digest(decompose(docs, PATH)).collect()} == digests


def test_edge_rows_and_buckets(spark, tmp_path):
    docs = spark.createDataFrame(
        [(None, 1, 5), ("", 1, 5), ("same", None, 5), ("same", None, 5), ("word " * 30_000, 2, 5)],
        "text string, doc_id bigint, sequence_id int",
    )
    sequences = number_sequences(decompose(docs, PATH))
    rows = sequences.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert sorted(r.doc_tokens for r in rows if r.doc_id == 1) == [1, 1]
    write_buckets(sequences, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.count() == len(rows) and {r.length for r in back.collect()} == {r.length for r in rows}
    assert number_sequences(decompose(docs.limit(0), PATH)).count() == 0


def test_runs_of_white_space_of_any_length(monkeypatch):
    plain, fast = Tokenizer.from_file(PATH), byte_bpe_encoder(PATH)
    monkeypatch.setattr("tallyflow.llm.encoders.LONG_BLANKS", 50)
    special = "<|endoftext|>"
    for blank in (" ", "\t", "\n", "\r\n", "　", " \n", "\x85", " ", "\x1c"):
        for text in ("{}", "x{}", "{}y", "x{}y", "x{}'s", "x{}" + special + "{}z", special + "{}", "a {}b{}1{}.", "{}\x1c{}"):
            text = text.replace("{}", blank * 120)
            assert fast(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_two_million_blanks():
    plain, fast = Tokenizer.from_file(PATH), byte_bpe_encoder(PATH)
    for blank in (" ", "\t", "\n", " \n"):
        text = f"x{blank * 1_000_000}y{blank * 1_000_000}"
        assert fast(text).tolist() == plain.encode(text, add_special_tokens=False).ids
