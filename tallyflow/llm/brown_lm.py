"""Scores of texts by a class-based bigram model (Brown classes found by exchange).

``p(text)`` is the product over tokens of ``p(class | class before) p(token | class)``; a
text is its lower-case words and one end token, and what precedes the first word is an end
token too.  Every frequent word belongs to one of ``classes`` exchange classes, every other
word to the class of its shape, and the end token to its own.

* Frequent are words with at least ``2 ** -share_bits`` of all training tokens, so there are at most
  ``2 ** share_bits`` of them at any size of the corpus; with at most ``LONGEST`` bytes each, the
  table of them is the one thing that is broadcast.  As hot words never pass a shuffle, the
  joins of the others have no hot keys.
* The exchange looks at all bigrams of all training texts, kept as one bounded row of
  contexts per word.  Each round every word of a changing half moves to the class that raises
  the likelihood most, given the others; a round that lowers it is undone and the
  share of moving words halved.
* Transitions are smoothed towards class frequencies.  A shape class emits its words by
  counts plus one and one more for any unknown word, so probabilities over words sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.scratch import Scratch
from tallyflow.llm.textscan import SPACE, slices, word_spans

#: Longest word, in bytes, that counts as frequent.
LONGEST = 64
#: Shapes of words: with a digit, ending in a symbol, else four lengths in ASCII and in other scripts.
SHAPES = 10
#: Entries that a task collects before it hands partial counts on.
_HELD = 1 << 18

SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    """Number of exchange classes, share of a frequent word (bits), exchange rounds, smoothing."""

    classes: int = 64
    share_bits: int = 18
    rounds: int = 10
    #: Weight of class frequencies against transitions seen, and of a uniform class against frequencies.
    transition_prior: float = 10.0
    class_prior: float = 0.5


@dataclass
class BrownModel:
    """What scoring needs; ``counts`` (word, shape, n) is a table, all else is bounded."""

    settings: Settings
    counts: DataFrame
    tokens: int
    distinct: int
    documents: int
    words: pa.Array
    word_counts: np.ndarray
    #: Class of each frequent word; shape and end classes follow the exchange classes.
    word_class: np.ndarray
    shape_tokens: np.ndarray
    shape_words: np.ndarray
    transitions: np.ndarray
    likelihoods: list[float]

    def log_transitions(self) -> np.ndarray:
        """log10 p(class | class before), rows summing to one."""
        n, s = self.transitions, self.settings
        size = len(n)
        q = (n.sum(axis=0) + s.class_prior) / (n.sum() + s.class_prior * size)
        return np.log10((n + s.transition_prior * q) / (n.sum(axis=1, keepdims=True) + s.transition_prior))

    def log_words(self) -> np.ndarray:
        """log10 p(word | class) of the frequent words."""
        totals = np.bincount(self.word_class, weights=self.word_counts, minlength=self.settings.classes)
        return np.log10(self.word_counts / totals[self.word_class])


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _lower_table()


def tokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of the texts, in order, and the n + 1 offsets of the texts into them."""
    starts, ends = word_spans(data, offsets)
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    # Words are all there is between blanks, so what is left without blanks is the words in a row.
    joined = _LOWER[data[~SPACE[data]]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(joined))
    return words, np.searchsorted(starts, offsets)


def shapes(words: pa.Array) -> np.ndarray:
    """Shape class of every word (a LargeStringArray without nulls or empty words)."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    _, at, data = words.buffers()
    at = np.frombuffer(at, dtype=np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    digit = np.add.reduceat((data >= 48) & (data <= 57), at[:-1], dtype=np.int64) > 0
    other = np.add.reduceat(data >= 128, at[:-1], dtype=np.int64) > 0
    last = data[at[1:] - 1]
    symbol = (last < 128) & ~((last >= 97) & (last <= 122)) & ~((last >= 48) & (last <= 57))
    length = 2 + np.searchsorted([5, 9, 13], np.diff(at), side="right") + 4 * other
    return np.where(digit, 0, np.where(symbol, 1, length))


def _merged(held: list[pa.Table], by: list[str]) -> pa.Table:
    return pa.concat_tables(held).group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"])


class _Partial:
    """Sums counts by key within a task and hands them on when there are many."""

    def __init__(self, by: list[str]) -> None:
        self._by, self._held, self._size = by, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self._held.append(table)
        self._size += len(table)
        if self._size > 2 * _HELD:
            merged = _merged(self._held, self._by)
            self._held, self._size = [merged], len(merged)
            if self._size > _HELD:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._held:
            yield from _merged(self._held, self._by).combine_chunks().to_batches(max_chunksize=1 << 16)
        self._held, self._size = [], 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string"))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, shape, n`` of all words of the texts, with the end token as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial, ends = _Partial(["word", "shape"]), 0
        for batch in batches:
            ends += len(batch)
            for _, _, data, offsets in slices(batch.column(0)):
                coded = tokenise(data, offsets)[0].dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                kinds = shapes(coded.dictionary).astype(np.int32)
                yield from partial.add(pa.table({"word": coded.dictionary.cast(pa.string()), "shape": kinds, "n": n}))
        if ends:
            end = {"word": pa.array([""]), "shape": pa.array([-1], pa.int32()), "n": pa.array([ends], pa.int64())}
            yield from partial.add(pa.table(end))
        yield from partial.rest()

    rows = _texts(docs).mapInArrow(run, "word string, shape int, n bigint")
    return rows.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


@dataclass
class _Ids:
    """Numbers of tokens: frequent words, then shapes, then the end."""

    words: pa.Array

    def __post_init__(self) -> None:
        self.frequent = len(self.words)
        self.end = self.frequent + SHAPES
        self.size = self.end + 1

    def of(self, words: pa.Array) -> np.ndarray:
        """The number of every word; words that are not frequent have that of their shape."""
        found = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = found < 0
        found[rare] = self.frequent + shapes(words.filter(pa.array(rare)))
        return found


def _with_ends(ids: np.ndarray, rows: np.ndarray, end: int) -> np.ndarray:
    """The tokens of all texts in a row, each text followed by the end token."""
    return np.insert(ids, rows[1:], end)


def count_bigrams(docs: DataFrame, words: pa.Array) -> DataFrame:
    """``a, b, n`` of all neighbouring token numbers of the texts."""
    numbers = _Ids(words)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, partial = _Ids(shared.value), _Partial(["pair"])
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                found, rows = tokenise(data, offsets)
                coded = found.dictionary_encode()
                sequence = _with_ends(ids.of(coded.dictionary)[coded.indices.to_numpy()], rows, ids.end)
                before = np.concatenate(([ids.end], sequence[:-1]))
                pair, n = np.unique(before * ids.size + sequence, return_counts=True)
                yield from partial.add(pa.table({"pair": pair, "n": n}))
        yield from partial.rest()

    pairs = _texts(docs).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    size = F.lit(numbers.size)
    return pairs.select(F.expr(f"pair div {numbers.size}").alias("a"), (F.col("pair") % size).alias("b"), "n")


def contexts(bigrams: DataFrame) -> DataFrame:
    """One row per token: ``w, places, counts``; place ``2 i + 1`` is "``i`` follows", ``2 i`` "``i`` precedes".

    A row holds at most two entries per token number, so its size is bounded at any size of the corpus.
    """
    sides = bigrams.select(F.col("a").alias("w"), (2 * F.col("b") + 1).alias("place"), "n").union(bigrams.select("b", 2 * F.col("a"), "n"))
    return sides.groupBy("w").agg(F.collect_list(F.struct("place", "n")).alias("e")).select("w", "e.place", "e.n")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows, and of every entry its row, place and count."""
    row = np.repeat(np.arange(len(batch)), np.diff(batch.column(1).offsets.to_numpy()))
    return batch.column(0).to_numpy(), row, batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()


def _transitions(table: DataFrame, token_class: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbouring classes."""
    shared = table.sparkSession.sparkContext.broadcast(token_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            w, row, place, n = _flat(batch)
            after = (place & 1) == 1
            cell = shared.value[w[row[after]]] * size + shared.value[place[after] >> 1]
            np.add.at(total, cell, n[after])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = table.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[rows["cell"]] = rows["n"]
    shared.unpersist()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(transitions: np.ndarray) -> float:
    """What classes change of the log-likelihood of the training tokens."""
    return float(_xlogx(transitions).sum() - _xlogx(transitions.sum(axis=0)).sum() - _xlogx(transitions.sum(axis=1)).sum())


def best_moves(
    n: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, classes: int, candidates: int = 8
) -> tuple[np.ndarray, np.ndarray]:
    """The best class of each word and what moving there gains, the other words staying.

    ``left`` and ``right`` count the classes before and behind each word, ``own`` is its class.  Gains are
    exact; they are computed for the classes whose words have the likest neighbours.
    """
    rows = np.arange(len(own))[:, None]
    alike = right @ np.log(n[:classes].T + 1) + left @ np.log(n[:, :classes] + 1)
    alike -= right.sum(axis=1)[:, None] * np.log(n.sum(axis=1)[:classes] + 1) + left.sum(axis=1)[:, None] * np.log(n.sum(axis=0)[:classes] + 1)
    alike[rows[:, 0], own] = np.inf
    most = min(candidates + 1, classes)
    tried = np.argpartition(-alike, most - 1, axis=1)[:, :most]
    # The own class comes first.
    tried = np.take_along_axis(tried, np.argsort(tried != own[:, None], axis=1, kind="stable"), axis=1)

    def without(matrix: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
        """The rows tried for every word once its own counts are taken out."""
        out = matrix[tried]
        out[:, 0] -= along
        out[rows[:, 0], :, own] -= across[rows, tried]
        return np.maximum(out, 0)

    def joined(base: np.ndarray, more: np.ndarray) -> np.ndarray:
        return (_xlogx(base + more[:, None, :]) - _xlogx(base)).sum(axis=2)

    def marginal(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        base = counts[tried]
        base[:, 0] = np.maximum(base[:, 0] - total, 0)
        return _xlogx(base + total[:, None]) - _xlogx(base)

    by_row, by_column = without(n, right, left), without(n.T, left, right)
    gain = joined(by_row, right) + joined(by_column, left)
    gain -= marginal(n.sum(axis=1), right.sum(axis=1)) + marginal(n.sum(axis=0), left.sum(axis=1))
    # The cell of a class with itself gets both sides at once.
    cell, behind, ahead = np.take_along_axis(by_row, tried[:, :, None], axis=2)[:, :, 0], right[rows, tried], left[rows, tried]
    gain += _xlogx(cell + behind + ahead) - _xlogx(cell + behind) - _xlogx(cell + ahead) + _xlogx(cell)
    best = gain.argmax(axis=1)
    return tried[rows[:, 0], best], gain[rows[:, 0], best] - gain[:, 0]


def _propose(table: DataFrame, token_class: np.ndarray, n: np.ndarray, frequent: int, classes: int, chosen: np.ndarray) -> np.ndarray:
    """Classes after the best moves of the chosen words; as many numbers as frequent words come back."""
    size = len(n)
    shared = table.sparkSession.sparkContext.broadcast((token_class, n, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix, moving = shared.value
        for whole in batches:
            for start in range(0, len(whole), 1024):
                w, row, place, count = _flat(whole.slice(start, 1024))
                mine = w < frequent
                mine[mine] = moving[w[mine]]
                if not mine.any():
                    continue
                sides = np.bincount(
                    (row * 2 + (place & 1)) * size + known[place >> 1], weights=count, minlength=len(w) * 2 * size
                ).reshape(len(w), 2, size)[mine]
                best, gain = best_moves(matrix, known[w[mine]], sides[:, 0], sides[:, 1], classes)
                move = gain > 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(w[mine][move]), pa.array(best[move])], names=["w", "best"])

    moves = table.filter(F.col("w") < frequent).mapInArrow(run, "w bigint, best bigint").toPandas()
    shared.unpersist()
    after = token_class.copy()
    after[moves["w"]] = moves["best"]
    return after


def exchange(table: DataFrame, frequent: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of every token number, counts of neighbouring classes, likelihood after every round kept."""
    k = settings.classes
    size = k + SHAPES + 1
    token_class = np.concatenate([np.arange(frequent) % k, np.arange(k, size)])
    n = _transitions(table, token_class, size)
    found, share = [likelihood(n)], 2
    mixed = np.arange(frequent, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    for step in range(settings.rounds if frequent else 0):
        chosen = (mixed + np.uint64(step)) % np.uint64(share) == 0
        after = _propose(table, token_class, n, frequent, k, chosen)
        if (after == token_class).all():
            if share == 2 and step:
                break
            continue
        matrix = _transitions(table, after, size)
        value = likelihood(matrix)
        if value <= found[-1]:
            share *= 2
            continue
        token_class, n = after, matrix
        found.append(value)
    return token_class, n, found


def train(docs: DataFrame, training: Column, settings: Settings = Settings()) -> BrownModel:  # noqa: B008
    """Learns from the rows of ``docs`` for which ``training`` holds."""
    scratch = Scratch(docs.sparkSession)
    learn = docs.filter(training)
    counts = scratch.keep(count_words(learn), "words")
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("ends")).head()
    tokens = int(whole.n or 0)
    hot = (F.col("word") != "") & (F.octet_length("word") <= LONGEST) & (F.col("n").cast("decimal(38,0)") * (1 << settings.share_bits) >= tokens)
    top = counts.filter(hot).select("word", "n").orderBy(F.desc("n"), "word").toArrow()
    words = pa.concat_arrays([c.cast(pa.large_string()) for c in top.column("word").chunks] or [pa.array([], pa.large_string())])
    rare = counts.filter(~hot & (F.col("word") != "")).groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    shape_tokens, shape_words = np.zeros(SHAPES, dtype=np.int64), np.zeros(SHAPES, dtype=np.int64)
    for r in rare:
        shape_tokens[r["shape"]], shape_words[r["shape"]] = r["n"], r["v"]
    table = scratch.keep(contexts(count_bigrams(learn, words)), "contexts")
    # A row of contexts may be long, so batches are bounded by bytes.
    with scratch.bounded():
        token_class, transitions, likelihoods = exchange(table, len(words), settings)
    scratch.drop(table)
    return BrownModel(
        settings, counts, tokens, int(whole.v), int(whole.ends or 0), words, top.column("n").to_numpy(),
        token_class[: len(words)], shape_tokens, shape_words, transitions, likelihoods,
    )


_ROWS = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
    "rare array<struct<word: string, shape: int, k: bigint>>"
)


def _read_texts(docs: DataFrame, held_out: Column, model: BrownModel) -> DataFrame:
    """Every row with the sums over its frequent tokens and transitions, and its other words with their counts."""
    base_total = np.log10(model.tokens + model.distinct + 1)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.words, model.word_class, np.log10(model.word_counts + 1.0), model.log_words(), model.log_transitions())
    )
    k, documents = model.settings.classes, model.documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, word_class, log_base, log_word, log_next = shared.value
        ids = _Ids(words)
        token_class = np.concatenate([word_class, np.arange(k, k + SHAPES + 1)])
        base = np.concatenate([log_base - base_total, np.zeros(SHAPES), [np.log10(documents + 1.0) - base_total]])
        emit = np.concatenate([log_word, np.zeros(SHAPES + 1)])
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, stop, data, offsets in slices(batch.column(2)):
                n = stop - first
                found, rows = tokenise(data, offsets)
                coded = found.dictionary_encode()
                kinds = ids.of(coded.dictionary)
                indices = coded.indices.to_numpy().astype(np.int64)
                sequence = _with_ends(kinds[indices], rows, ids.end)
                lengths = np.diff(rows) + 1
                doc = np.repeat(np.arange(n), lengths)
                classes = token_class[sequence]
                before = np.concatenate(([k + SHAPES], classes[:-1]))
                common = (sequence < ids.frequent) | ((sequence == ids.end) & (documents > 0))
                score = np.bincount(doc, weights=log_next[before, classes] + emit[sequence], minlength=n)

                at = np.flatnonzero(kinds[indices] >= ids.frequent)
                pair, times = np.unique(np.repeat(np.arange(n), np.diff(rows))[at] * max(len(kinds), 1) + indices[at], return_counts=True)
                owner, which = np.divmod(pair, max(len(kinds), 1))
                ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                rare = pa.StructArray.from_arrays(
                    [coded.dictionary.take(pa.array(which)).cast(pa.string()), pa.array((kinds[which] - ids.frequent).astype(np.int32)), pa.array(times)],
                    names=["word", "shape", "k"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(serial + np.arange(n)),
                        batch.column(0)[first:stop],
                        batch.column(1)[first:stop],
                        pa.array(lengths),
                        pa.array(np.bincount(doc, weights=common, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(doc, weights=base[sequence], minlength=n)),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(ends), rare),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                serial += n

    return docs.select(F.col("doc_id").cast("bigint"), held_out, F.col("text").cast("string")).mapInArrow(run, _ROWS)


def score_texts(docs: DataFrame, held_out: Column, model: BrownModel) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row.

    Scores are log10 probabilities.  A null or empty text is one end token; repeated rows
    and null doc_ids stay as they are; other columns are ignored.  Without training texts every
    token is unknown, the base gives each probability 1, and classes are equally likely.
    """
    scratch = Scratch(docs.sparkSession)
    read = scratch.keep(_read_texts(docs, held_out, model), "texts")
    sizes = F.array(*[F.lit(float(t + v + 1)) for t, v in zip(model.shape_tokens.tolist(), model.shape_words.tolist(), strict=True)])
    c = F.coalesce(F.col("n"), F.lit(0)) + 1.0
    words = read.select("row", F.inline("rare"))
    known = model.counts.select("word", "n")
    each = words.join(known, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("r_known"),
        F.sum(F.col("k") * F.log10(c / (model.tokens + model.distinct + 1))).alias("r_base"),
        F.sum(F.col("k") * F.log10(c / F.element_at(sizes, F.col("shape") + 1))).alias("r_score"),
    )
    out = read.drop("rare").join(each, "row", "left")
    score = F.col("score") + F.coalesce("r_score", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
