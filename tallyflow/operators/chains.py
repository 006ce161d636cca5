"""Chains of links followed by doubling: the number of jobs grows with the logarithm of the links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.session import cut_lineage

#: Rounds whose joins stay in one plan before what they found is written.
_ROUNDS_TOGETHER = 3


def reached(links: DataFrame, roots: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``keys…, a`` of all places that ``links`` (keys…, a, b) lead to from ``roots`` (keys…, a), these included.

    Every place has at most one link, and no chain is longer than ``most``.  After k rounds
    the first 2^k places are known, and links lead 2^k places on.
    """
    keys = list(keys)
    chain, rounds = roots.select(*keys, "a"), max(most, 1).bit_length()
    for k in range(rounds):
        chain = chain.unionByName(chain.join(links, [*keys, "a"]).select(*keys, F.col("b").alias("a")))
        if k + 1 < rounds:
            ahead = links.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
            links = links.join(ahead, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b"))
            if k % _ROUNDS_TOGETHER == _ROUNDS_TOGETHER - 1:
                chain, links = cut_lineage(chain), cut_lineage(links)
    return chain
