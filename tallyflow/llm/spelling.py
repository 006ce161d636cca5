"""Spelling variants grouped by searches with one error in bidirectional FM-indexes.

Of two words one edit apart, one half of the first stands unchanged at the same end of the
second.  So words are dealt by the halves that a search may ask them for, every group builds an
index of its words, and each of its words is searched with either half exact and one error in
the other.  Halves shared by very many words are cut into blocks of words to find and of
words to ask for, so no group grows with the vocabulary; nothing pairs words up beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.fm_index import BidirectionalIndex, Sequences, one_error
from tallyflow.llm.scratch import Scratch

#: Shortest words looked at, fewest occurrences, and how much commoner a form must be.
LEAST_LENGTH, LEAST_COUNT, COMMONER = 7, 2, 10
#: Letters of a word.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Runs whose checksum this number divides lose one letter.
DROP_EVERY = 31
#: Words of a group on average, and of one half before it is cut into blocks.
GROUP_WORDS = 1 << 14
BLOCK_WORDS = 1 << 13
#: Letters that count as one word when groups are sized.
WORD_LETTERS = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, drop_every: int | None = DROP_EVERY) -> DataFrame:
    """``word, n`` of the runs of letters of all texts, lower-cased in ASCII.

    With ``drop_every``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses the letter at
    that number modulo the length; runs of a null doc_id stay whole.
    """
    # A shorter run never becomes a word, so the pattern need not find it.
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    word = F.col("run")
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        cut = (h % F.length("run")).cast("int")
        dropped = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
        word = F.when(h % drop_every == 0, dropped).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def _dealt(words: DataFrame, groups: int, block_words: int) -> DataFrame:
    """Every word under each half that a search may ask for, in groups of bounded size.

    A search for a word of length L asks for its first L / 2 or its last L - L / 2 letters; a word
    one letter longer or shorter asks for one letter more or less.
    """
    length = F.length("word")
    half = F.floor(length / 2).cast("int")

    def entry(side: int, size, own):
        part = F.substring("word", F.lit(1), size) if side == 0 else F.substring("word", length - size + 1, size)
        return F.struct(F.lit(side).alias("side"), F.xxhash64(part).alias("key"), (size == own).alias("asks"))

    left = [F.floor((length - 1) / 2).cast("int"), F.floor((length + 1) / 2).cast("int")]
    right = [half, half + 1]
    entries = F.array(*[entry(0, size, half) for size in left], *[entry(1, size, length - half) for size in right])
    dealt = words.select("word", "n", F.inline(entries))
    hot = dealt.groupBy("side", "key").agg(F.count("*").alias("size")).filter(F.col("size") > block_words)
    parts = F.ceil(F.col("size") / block_words).cast("int")
    hot = hot.select("side", "key", parts.alias("parts"))
    mine = F.pmod(F.xxhash64("word", F.lit(7)), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = "struct<i: int, j: int, indexed: boolean, asks: boolean>"
    kept = F.transform(others, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("indexed"), F.lit(False).alias("asks")).cast(cell))
    asked = F.transform(others, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asks")).cast(cell))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("indexed"), F.col("asks")).cast(cell))
    cells = F.when(F.col("parts").isNull(), alone).when(F.col("asks"), F.concat(kept, asked)).otherwise(kept)
    # A hot half is a group of its own; the others share groups.
    group = F.when(F.col("parts").isNull(), F.pmod("key", F.lit(groups))).otherwise(F.col("key"))
    return dealt.join(hot, ["side", "key"], "left").select(
        "side", F.col("parts").isNotNull().alias("hot"), group.alias("group"), "word", "n", F.inline(cells)
    )


_NEAR = "word string, n_near bigint, best_n bigint, best string"


def near_in_group(words: list[str], counts: list[int], indexed: np.ndarray, asks: np.ndarray, side: int) -> Iterator[tuple[str, int, int, str]]:
    """``word, n_near, best_n, best`` of every asking word with near words among the indexed ones.

    ``words`` are distinct.  Side 0 has the left half exact, side 1 the right half and a left half that differs.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    library = [i for i in order if indexed[i]]
    asking = [i for i in order if asks[i]]
    if not library or not asking:
        return
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    alphabet, coded = np.unique(points, return_inverse=True)
    coded = coded.astype(np.int64) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths

    def gather(first: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
        """Symbols from each first position on, forwards or backwards."""
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return coded[np.repeat(first, size) + step * within]

    index = BidirectionalIndex(gather(starts[library], lengths[library], 1), lengths[library], len(alphabet) + 1)
    half = lengths[asking] // 2
    at = starts[asking]

    def outwards(first: np.ndarray, size: np.ndarray, step: int) -> Sequences:
        return Sequences(np.insert(gather(first, size, step), np.cumsum(size), 0), np.cumsum(size + 1) - size - 1)

    left, right = outwards(at + half - 1, half, -1), outwards(at + half, lengths[asking] - half, 1)
    exact, other = (left, right) if side == 0 else (right, left)
    query, rank = one_error(index, exact, other, len(asking), side == 0)
    near: dict[int, tuple[int, int, str]] = {}
    for q, r in zip(query.tolist(), rank.tolist(), strict=True):
        word, found = words[asking[q]], library[r]
        h = len(word) // 2
        if side == 1 and words[found][:h] == word[:h]:
            continue  # side 0 finds it
        n, best_n, best = near.get(q, (0, 0, ""))
        if not n or (-counts[found], words[found]) < (-best_n, best):
            best_n, best = counts[found], words[found]
        near[q] = n + 1, best_n, best
    for q, (n, best_n, best) in near.items():
        yield words[asking[q]], n, best_n, best


def near_words(words: DataFrame, scratch: Scratch, group_words: int = GROUP_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, n_near, best_n, best``: number of words one edit away, and the commonest (ties: the smallest) of them.

    ``words`` are distinct (``word, n``).  Words without a near one have no row.
    """
    size = words.agg(F.sum(F.greatest(F.lit(1), F.length("word") / WORD_LETTERS))).head()[0] or 0
    groups = max(1, int(2 * size / group_words))

    def search(table: pa.Table) -> pa.Table:
        side = table.column("side")[0].as_py()
        place: dict[str, int] = {}
        words, counts, flags = [], [], []
        rows = (table.column(c).to_pylist() for c in ("word", "n", "indexed", "asks"))
        for word, n, indexed, asks in zip(*rows, strict=True):
            k = place.setdefault(word, len(words))
            if k == len(words):
                words.append(word), counts.append(n), flags.append([False, False])
            flags[k][0] |= indexed
            flags[k][1] |= asks
        known = np.array(flags, dtype=bool)
        out = list(near_in_group(words, counts, known[:, 0], known[:, 1], side))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])

    found = _dealt(words, groups, block_words).groupBy("side", "hot", "group", "i", "j").applyInArrow(search, _NEAR)
    found = scratch.keep(found, "near")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return summed.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` of every row of ``forms`` (word, form): where following forms ends.

    Each form is at least ``COMMONER`` times as common as its word, so chains have at most 18 links and
    doubling ends after five rounds; a form has no more words than it has edits, so no key is hot.
    """
    links = scratch.keep(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = scratch.keep(moved, "links")
        links = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return links


def group_variants(words: DataFrame, scratch: Scratch, group_words: int = GROUP_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (distinct ``word``, with ``n``)."""
    near = scratch.keep(near_words(words, scratch, group_words, block_words), "nearest")
    joined = words.join(near, "word", "left")
    common = F.col("best_n") >= COMMONER * F.col("n")
    joined = scratch.keep(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")
        ),
        "forms",
    )
    ends = roots(joined.filter("form IS NOT NULL"), scratch)
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, group_words: int = GROUP_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences in ``docs`` with their forms.

    ``form`` is the commonest word (ties: the smallest) that differs by one inserted, deleted or
    replaced letter, where it is ``COMMONER`` times as common, else null; ``root`` is where following
    forms ends.  A null or empty text has no words; repeated rows count again; runs of a null
    doc_id stay whole; other columns are ignored; an empty table has no words.  Words of any
    length take part; the time of a group grows with its longest word.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(count_words(docs.select("doc_id", F.col("text").cast("string").alias("text"))).filter(F.col("n") >= LEAST_COUNT), "words")
    return group_variants(words, scratch, group_words, block_words)
