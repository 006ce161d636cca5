"""Statistics of documents: words, symbols, repeated lines and windows, character classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tallyflow.llm.textscan import SCAN_BYTES, SPACE, U64, byte_values, mix64, substring_hashes, window_hashes, word_spans

#: Words per window whose repetition is counted.
WINDOW = 5
SYMBOLS = b"#*$%&|<>"


def _class_table() -> tuple[list[str], np.ndarray]:
    names = ["lower", "upper", "digit", "blank", "line break", "control", "sentence", "quote", "bracket", "symbol"]
    names += ["two bytes", "three bytes", "four bytes"]
    table = np.full(256, names.index("symbol"))
    table[:32] = table[127] = names.index("control")
    table[97:123] = names.index("lower")
    table[65:91] = names.index("upper")
    table[48:58] = names.index("digit")
    table[[9, 32]] = names.index("blank")
    table[[10, 13]] = names.index("line break")
    table[list(b".,;:!?-")] = names.index("sentence")
    table[list(b"'\"`")] = names.index("quote")
    table[list(b"()[]{}")] = names.index("bracket")
    table[0x80:0xC0] = -1  # not the first byte of a character
    table[0xC0:0xE0] = names.index("two bytes")
    table[0xE0:0xF0] = names.index("three bytes")
    table[0xF0:] = names.index("four bytes")
    return names, table


CLASS_NAMES, _CLASS = _class_table()
_TO_CLASS = (np.arange(len(CLASS_NAMES)) == _CLASS[:, None]).astype(np.int64)


@dataclass
class Statistics:
    """One entry (or row) per document."""

    n_bytes: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_distinct_words: np.ndarray
    n_capital_words: np.ndarray
    classes: np.ndarray
    commons: np.ndarray


def _byte_histogram(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if n == 1:
        parts = [np.bincount(data[i : i + SCAN_BYTES], minlength=256) for i in range(0, len(data), SCAN_BYTES)]
        return np.sum(parts, axis=0, dtype=np.int64).reshape(1, 256) if parts else np.zeros((1, 256), np.int64)
    key = np.repeat(np.arange(n) * 256, np.diff(offsets)) + data
    return np.bincount(key, minlength=n * 256).reshape(n, 256)


def _of_document(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one document."""
    return mix64(keys + mix64(doc.astype(np.uint64) + U64(1)))


def _lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one, of each document."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    stops = np.unique(np.concatenate((offsets[1:], breaks)))
    # A stop at the start itself is the line's own only if it is a line break.
    ends = np.where(data[starts] == 10, starts, stops[np.searchsorted(stops, starts, side="right")])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, doc = starts[full], ends[full], doc[full]
    keys = _of_document(substring_hashes(data, starts, ends, byte_values(False)), doc)
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(doc, minlength=n)
    return lines, lines - np.bincount(doc[first], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> Statistics:
    """Statistics of each document; ``common`` are sorted hashes of lower-case words to count."""
    n = len(offsets) - 1
    histogram = _byte_histogram(data, offsets)
    classes = histogram @ _TO_CLASS
    starts, ends = word_spans(data, offsets)
    rows = np.searchsorted(starts, offsets)
    n_words = np.diff(rows)
    word_doc = np.repeat(np.arange(n), n_words)
    words = substring_hashes(data, starts, ends, byte_values(False))

    windows = window_hashes(words, WINDOW)
    window_doc = word_doc[: len(windows)]
    valid = np.flatnonzero(window_doc == word_doc[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    _, which, count = np.unique(
        _of_document(windows[valid], window_doc[valid]), return_inverse=True, return_counts=True
    )
    again = valid[count[which] > 1]
    change = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + WINDOW, minlength=len(words) + 1)
    repeated = np.cumsum(change[: len(words)]) > 0

    _, first = np.unique(_of_document(words, word_doc), return_index=True)
    lines, dup_lines = _lines(data, offsets, starts)
    lower = substring_hashes(data, starts, ends, byte_values(True))
    slot = np.searchsorted(common, lower)
    slot[(slot == len(common)) | (common[np.minimum(slot, len(common) - 1)] != lower)] = len(common)
    width = len(common) + 1
    commons = np.bincount(word_doc * width + slot, minlength=n * width).reshape(n, width)
    initial = data[starts] if len(starts) else np.zeros(0, np.uint8)
    return Statistics(
        n_bytes=np.diff(offsets),
        n_words=n_words,
        word_chars=histogram[:, ~SPACE & (_CLASS >= 0)].sum(axis=1),
        n_symbols=histogram[:, list(SYMBOLS)].sum(axis=1),
        n_lines=lines,
        n_dup_lines=dup_lines,
        n_repeat_words=np.bincount(word_doc[repeated], minlength=n),
        n_distinct_words=np.bincount(word_doc[first], minlength=n),
        n_capital_words=np.bincount(word_doc[(initial >= 65) & (initial <= 90)], minlength=n),
        classes=classes,
        commons=commons,
    )
