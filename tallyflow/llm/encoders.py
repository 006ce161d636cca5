"""Public tokenizers as plain functions, cached per worker process."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache

import numpy as np

#: Fixed value: the published split pattern of byte-level BPE vocabularies of this family.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A text longer than this is encoded in parts.
PART_CHARS = 1 << 18
#: A run of white space longer than this is not shown to the pattern, whose look-ahead tries
#: every shorter run too and gives up on very long ones.
LONG_BLANKS = 1 << 14

#: Fixed value: white space as the pattern knows it (the Unicode property).
_WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

#: A lone blank between two other characters: the split pattern always starts a new piece
#: there, whatever stands before, so the ids of both sides do not depend on each other.
_SAFE_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")


def long_runs(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the runs of more than ``LONG_BLANKS`` white-space characters."""
    if len(text) <= LONG_BLANKS:
        return []
    return [m.span() for m in _WHITE.finditer(text) if m.end() - m.start() > LONG_BLANKS]


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as themselves and the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if ids rank the merges and nothing else changes the ids."""
    model = spec["model"]
    pre = spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
        and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    )
    if not plain:
        return None
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    byte = _byte_of_symbol()
    added = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}


@cache
def byte_bpe_encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids as ``tokenizers`` gives them with ``add_special_tokens=False``.

    Where ids rank the merges, ``tiktoken`` yields the same ids in about a quarter of the
    time (the tests compare both over every code point); else ``tokenizers`` itself runs.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _as_ranks(spec)
    if ranks is None:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        return lambda text: np.asarray(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def of_span(text: str) -> list[np.ndarray]:
        parts, start = [], 0
        while len(text) - start > PART_CHARS:
            cut = _SAFE_CUT.search(text, start + PART_CHARS)
            if cut is None:
                break
            parts.append(fast.encode_to_numpy(text[start : cut.start()], allowed_special="all"))
            start = cut.start()
        return [*parts, fast.encode_to_numpy(text[start:], allowed_special="all")]

    def encode(text: str) -> np.ndarray:
        parts, start = [], 0
        for begin, end in long_runs(text):
            # The pattern makes one piece of the run; before other characters its last one is left
            # to what follows.  The end of the text and special tokens leave it all.
            if end < len(text) and not text.startswith(tuple(special), end):
                end -= 1
            parts += of_span(text[start:begin])
            parts.append(np.asarray(fast._encode_single_piece(text[begin:end]), dtype=np.uint32))
            start = end
        parts += of_span(text[start:])
        return np.concatenate(parts).astype(np.uint32, copy=False)

    return encode
