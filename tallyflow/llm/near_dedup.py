"""MinHash near-dedup with sequential Bayesian verification.

Texts with the same shingle set form a class; all work on pairs is on classes.  Classes
meet in the buckets of banded MinHash signatures.  A candidate's signatures are compared
batch by batch, and it is pruned as soon as the posterior probability that its similarity
reaches the threshold falls below the chosen miss probability; survivors are verified on
their full sets.

No bucket emits all its pairs.  First every member meets the bucket's anchor.  Then only
members of different components meet, and only those that can still be similar: two
similar sets of sizes m and n share at least t/(1+t) * (m + n) shingles, but no more than
the lesser of what each shares with the anchor and the lesser of what else of each occurs
in any other candidate.  Pairs within a component need no test, as they cannot change it;
no link between components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.components import components
from tallyflow.llm.scratch import Scratch
from tallyflow.llm.textscan import U64, mix64, range_hashes, shingle_sets, slices


@dataclass(frozen=True)
class Similarity:
    """Least similarity in percent, shingle width, bands, and the Bayesian test."""

    percent: int = 85
    width: int = 5
    bands: int = 25
    rows: int = 5
    #: Signature entries compared at a time, and the probability of losing a similar pair in all.
    batch: int = 25
    miss: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _signature(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """One 64-bit minimum per hash function and non-empty set."""
    seeds = mix64(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    factor, shift = seeds[:hashes] | U64(1), seeds[hashes:]
    out = np.full((len(sets), hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    for row, values in enumerate(sets):
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096, None] * factor
            part += shift
            np.minimum(out[row], part.min(axis=0), out=out[row])
    return out


def _blobs(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def sketches(docs: DataFrame, s: Similarity) -> DataFrame:
    """``doc_id``, a hash of the text, number of shingles, 128-bit digest of the set, and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, s.width)
                digests = np.frombuffer(
                    b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), "<i8"
                ).reshape(-1, 2)
                signatures = _signature(sets, s.hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row:end],
                        batch.column(2)[row:end],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        _blobs([y.tobytes() if len(x) else None for x, y in zip(sets, signatures, strict=True)]),
                    ],
                    names=["doc_id", "text_hash", "n", "s1", "s2", "signature"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint"), text, F.xxhash64(text)).mapInArrow(
        run, "doc_id bigint, text_hash bigint, n bigint, s1 bigint, s2 bigint, signature binary"
    )


def band_keys(classes: DataFrame, s: Similarity) -> DataFrame:
    """``key, cid``: one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.num_rows
                values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64)
                first = np.arange(n * s.bands) * s.rows
                keys = range_hashes(values, first, first + s.rows)
                keys = mix64(keys ^ mix64(np.tile(np.arange(1, s.bands + 1, dtype=np.uint64), n)))
                cid = part.column(0).take(pa.array(np.repeat(np.arange(n), s.bands)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), cid], names=["key", "cid"])

    return classes.select("cid", "signature").mapInArrow(run, "key bigint, cid bigint")


def _several(rows: DataFrame) -> DataFrame:
    """Rows whose key occurs more than once."""
    keys = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return rows.join(keys, "key", "left_semi")


def full_sets(docs: DataFrame, nodes: DataFrame, s: Similarity) -> DataFrame:
    """``cid, shingles``: the sorted set of every class in ``nodes`` as packed 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets = [x.tobytes() for x in shingle_sets(data, offsets, s.width)]
                digests = np.frombuffer(
                    b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in sets), "<i8"
                ).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[:, 0]), pa.array(digests[:, 1]), _blobs(sets)], names=["s1", "s2", "shingles"]
                )

    # A class without any doc_id is found through its rows without one.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = nodes.select(F.col("doc_id").alias("wanted")).distinct()
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = found.select("text").mapInArrow(run, "s1 bigint, s2 bigint, shingles binary").dropDuplicates(["s1", "s2"])
    return sets.join(nodes.select("s1", "s2", "cid"), ["s1", "s2"]).select("cid", "shingles")


def _lonely(sets: DataFrame) -> DataFrame:
    """``cid, lonely``: the number of a class's shingles that no other class in ``sets`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, blob in zip(batch.column(0), batch.column(1), strict=True):
                values = np.frombuffer(blob.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), cid.as_py())), pa.array(values)], names=["cid", "shingle"]
                )

    rows = sets.mapInArrow(run, "cid bigint, shingle bigint")
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).filter("n = 1")
    return once.groupBy("cid").agg(F.count("*").alias("lonely"))


def _possible(s: Similarity) -> Column:
    """Whether two members of a bucket can be similar (see above); ``met`` is null where the anchor's share is unknown."""
    other = [F.col(f"other_{c}") for c in ("n", "shared", "met")]
    n, shared, met = F.col("n"), F.col("shared"), F.col("met")
    most = F.coalesce(
        F.when(
            met.isNotNull() & other[2].isNotNull(),
            F.least(met, other[2]) + F.least(shared - met, other[1] - other[2]),
        ),
        F.least(shared, other[1]),
    )
    return (F.lit(100 + s.percent) * most >= F.lit(s.percent) * (n + other[0])) & (
        F.lit(100) * F.least(n, other[0]) >= F.lit(s.percent) * F.greatest(n, other[0])
    )


def least_matches(s: Similarity) -> list[tuple[int, int]]:
    """(entries compared, fewest matches to go on) after each batch.

    With a uniform prior the similarity after m matches in n has the posterior
    Beta(m + 1, n - m + 1); its tail beyond t is a binomial sum.  The miss probability is
    shared by the batches.
    """
    t, out = s.percent / 100, []
    steps = list(range(s.batch, s.hashes + 1, s.batch))
    for n in steps:
        tail, m = 0.0, 0
        for m in range(n + 1):
            # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= s.miss / len(steps):
                break
        out.append((n, m))
    return out


def survivors(pairs: DataFrame, nodes: DataFrame, s: Similarity) -> DataFrame:
    """The pairs (a, b) that sequential comparison of signatures does not prune."""
    bounds = least_matches(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                a, b = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(-1, s.hashes) for c in (2, 3)
                )
                left = np.arange(part.num_rows)
                matches = np.zeros(part.num_rows, dtype=np.int64)
                start = 0
                for n, least in bounds:
                    matches[left] += (a[left, start:n] == b[left, start:n]).sum(axis=1)
                    left = left[matches[left] >= least]
                    start = n
                take = pa.array(left)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take)], names=["a", "b"]
                )

    one = nodes.select(F.col("cid").alias("a"), F.col("signature").alias("sa"))
    two = nodes.select(F.col("cid").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def compared(pairs: DataFrame, sets: DataFrame, s: Similarity) -> DataFrame:
    """``a, b``, the number of shingles both have, and whether the full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                rows.append((shared, 100 * shared >= s.percent * (len(x) + len(y) - shared)))
            met, similar = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(met, pa.int64()), pa.array(similar, pa.bool_())],
                names=["a", "b", "met", "similar"],
            )

    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xa"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("xb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb")
    return joined.mapInArrow(run, "a bigint, b bigint, met bigint, similar boolean")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_anchors(members: DataFrame) -> DataFrame:
    """``members`` with their bucket's anchor: the one with the largest share of shingles that others have."""
    best = F.struct((F.col("shared") / F.col("n")).alias("part"), (-F.col("cid")).alias("last"))
    anchors = members.groupBy("key").agg((-F.max(best)["last"]).alias("anchor"))
    return members.join(anchors, "key")


def _cross_pairs(members: DataFrame, roots: DataFrame, tested: DataFrame, s: Similarity) -> DataFrame:
    """Untested pairs of a bucket in different components, one of them outside its largest component."""
    named = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid")
    )
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("size", F.col("root").alias("large"))).alias("top"), F.count("*").alias("parts"))
        .filter("parts > 1")
        .select("key", F.col("top.large").alias("large"))
    )
    # The anchor has met all others.
    mixed = named.join(largest, "key").filter("cid != anchor").withColumns(
        {"a": F.least("cid", "anchor"), "b": F.greatest("cid", "anchor")}
    )
    mixed = mixed.join(tested.select("a", "b", "met"), ["a", "b"], "left").drop("a", "b")
    rest = mixed.filter("root != large").select(
        "key", *[F.col(c).alias(f"other_{c}") for c in ("cid", "n", "shared", "met", "root")]
    )
    pairs = mixed.join(rest, "key").filter((F.col("root") != F.col("other_root")) & _possible(s))
    pairs = pairs.select(F.least("cid", "other_cid").alias("a"), F.greatest("cid", "other_cid").alias("b")).distinct()
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def link_classes(docs: DataFrame, classes: DataFrame, s: Similarity, scratch: Scratch) -> DataFrame:
    """``node, root`` of the classes that are similar to another one."""
    buckets = scratch.keep(_several(band_keys(classes, s)), "buckets")
    nodes = scratch.keep(classes.join(buckets.select("cid").distinct(), "cid", "left_semi"), "nodes")
    sets = scratch.keep(full_sets(docs, nodes, s), "sets")
    lonely = scratch.keep(_lonely(sets), "lonely")
    sized = (
        nodes.select("cid", "n")
        .join(lonely, "cid", "left")
        .select("cid", "n", (F.col("n") - F.coalesce("lonely", F.lit(0))).alias("shared"))
        .filter(F.lit(100) * F.col("shared") >= F.lit(s.percent) * F.col("n"))
    )
    members = _several(buckets.join(sized, "cid").select("key", "cid", "n", "shared"))
    members = scratch.keep(_with_anchors(members), "members")
    pairs = members.filter("cid != anchor").select(
        F.least("cid", "anchor").alias("a"), F.greatest("cid", "anchor").alias("b")
    )
    tested = scratch.keep(compared(survivors(pairs.distinct(), nodes, s), sets, s), "tested")
    links = tested.filter("similar").select("a", "b")
    roots = scratch.keep(components(links, scratch), "roots")
    more = scratch.keep(_cross_pairs(members, roots, tested, s), "pairs")
    found = scratch.keep(compared(survivors(more, nodes, s), sets, s).filter("similar").select("a", "b"), "links")
    if not found.isEmpty():
        roots = scratch.keep(components(links.union(found), scratch), "roots")
    scratch.drop(buckets, nodes, sets, lonely, members, tested, more, found)
    return roots


def near_groups(docs: DataFrame, s: Similarity = Similarity()) -> DataFrame:  # noqa: B008
    """``doc_id, text_hash, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    Words are runs of other bytes than blanks and 0x09-0x0D, A-Z in lower case; a text of
    fewer words than ``width`` has one shingle, a text without words (or null) has none
    and is linked with nothing.  ``component_id`` is the smallest doc_id of all documents
    that links lead to.  Repeated rows share a component, and both are kept if theirs is
    the smallest doc_id.  A row without doc_id takes part, but never names a component;
    it is kept if no row of its component has a doc_id.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(sketches(docs, s), "sketches")
    grouped = (
        found.filter("n > 0")
        .groupBy("s1", "s2")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("signature").alias("signature"))
    )
    # Ids depend on how rows are dealt to tasks, so they are written with the classes.
    classes = scratch.keep(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = link_classes(docs, classes, s, scratch)
    named = classes.select("cid", "s1", "s2", "doc_id").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    linked = named.filter("root is not null")
    smallest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = named.filter("root is null").select("s1", "s2", F.col("doc_id").alias("component_id")).union(
        linked.join(smallest, "root").select("s1", "s2", "component_id")
    )
    joined = found.select("doc_id", "text_hash", "n", "s1", "s2").join(names, ["s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame, s: Similarity = Similarity()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that ``near_groups`` keeps, with all their columns."""
    kept = near_groups(docs, s).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    return keyed.join(kept, same, "left_semi").drop("_text_hash")
