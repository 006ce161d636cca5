"""Common words of some languages, for the word histograms of documents."""

from __future__ import annotations

from functools import cache

import numpy as np

from tallyflow.llm.textscan import byte_values, substring_hashes

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "en": "the of and to in is that for it as was with be by on not he this are or his from at an",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce",
}


def vocabulary() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


@cache
def common_hashes() -> np.ndarray:
    """Sorted hashes of all common words."""
    words = [w.encode() for w in vocabulary()]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    return np.sort(substring_hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends, byte_values(True)))
