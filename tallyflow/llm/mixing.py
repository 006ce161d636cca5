"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic).  The cells' token weights are
raked: for each margin in turn they are scaled until its sums equal the targets.  A
cell's probability is its weight over its tokens, times one factor that sets the size of
the sample and capped at 1.  Documents are drawn by a hash of their id, so the draw can
be repeated.  Only DataFrame functions are used, and only sums per cell are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.scratch import Scratch

MARGINS = ("source", "lang", "topic")
#: A missing source, language or topic.
NONE = "(none)"
#: Rounds over all margins.
ROUNDS = 12
#: With at most so many cells (about 100 bytes each) they are sent to every executor; more are joined by shuffle.
BROADCAST_CELLS = 50_000
#: Exponents that turn shares of tokens into default targets: 1 keeps them, 0 makes all equal.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all tokens that the sample is to hold.
FRACTION = 0.7
SEED = 17


def topic_of(text: str = "text") -> Column:
    """A coarse topic by layout: table, marks, numbers, lines, prose, or none without text."""
    t = F.col(text)
    n = F.length(t)

    def share(chars: str) -> Column:
        return (n - F.length(F.translate(t, chars, ""))) / n

    lines = n - F.length(F.translate(t, "\n", "")) + 1
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, NONE)
        .when(share("|") > 0.02, "table")
        .when(share("#*$%&<>!") > 0.02, "marks")
        .when(share("0123456789") > 0.05, "numbers")
        .when(n / lines < 60, "lines")
        .otherwise("prose")
    )


def words_of(text: str = "text") -> Column:
    """Number of words, the default token weight."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    """A number in [0, 1) from the id, or from the text where there is no id."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.coalesce(F.col(text), F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed} "), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """``margin, share``: shares of tokens, raised to ``power`` and brought back to a sum of 1."""
    raised = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raised")).filter("raised > 0")
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("raised").alias("all")))).select(
        margin, (F.col("raised") / F.col("all")).alias("share")
    )


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``weight``: as tokens, scaled to the target shares of every margin in turn.

    A value without target has weight 0.  Targets that no cell can meet leave the
    margins as near as ``rounds`` rounds bring them.  A margin's sums are taken over the
    cells of one value, as many as the other margins have combinations.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        now = now.join(target.withColumnRenamed("share", f"_to_{margin}"), margin, "left")
    now = scratch.keep(now, "raked")
    for _ in range(rounds):
        before = now
        for margin in targets:
            total = F.sum("weight").over(Window.partitionBy(margin))
            scaled = F.when(total > 0, F.col("weight") * F.col(f"_to_{margin}") / total)
            now = now.withColumn("weight", F.coalesce(scaled, F.lit(0.0)))
        now = scratch.keep(now, "raked")
        scratch.drop(before)
    return now.drop(*[f"_to_{margin}" for margin in targets])


def calibrate(raked: DataFrame, fraction: float) -> DataFrame:
    """``raked`` with ``probability``: min(1, scale * weight / tokens), expected to draw ``fraction`` of the tokens.

    Capped cells hand what they lack to the others, until no further cell is capped.
    """
    rate = F.col("weight") / F.col("tokens")
    total = raked.agg(F.sum("tokens")).head()[0] or 0
    scale, capped = 0.0, -1
    while True:
        full = rate * F.lit(scale) >= 1
        row = raked.filter("weight > 0").agg(
            F.sum(F.when(full, F.col("tokens"))).alias("tokens"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).head()
        if row["n"] == capped or not row["weight"]:
            break
        capped = row["n"]
        scale = max(0.0, fraction * total - (row["tokens"] or 0)) / row["weight"]
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(scale) * rate)).otherwise(0.0)
    return raked.withColumn("probability", probability)


def measured(
    docs: DataFrame, topic: Column | None = None, tokens: Column | None = None, seed: int = SEED
) -> DataFrame:
    """``docs`` with ``topic, tokens, draw``: all that mixing needs to know of the texts.

    Kept without the texts, it saves mixing a second pass over them.
    """
    values = {
        "topic": topic if topic is not None else topic_of(),
        "tokens": tokens if tokens is not None else words_of(),
        "draw": uniform(seed=seed),
    }
    named = docs.select(*[F.col(c) for c in docs.columns if c not in values], *[v.alias(c) for c, v in values.items()])
    return named


def mix(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    fraction: float = FRACTION,
    topic: Column | None = None,
    tokens: Column | None = None,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``topic, tokens, probability, sampled``: ``draw_sample`` of ``measured``."""
    return draw_sample(measured(docs, topic, tokens, seed), targets, fraction, rounds).drop("draw")


def draw_sample(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    fraction: float = FRACTION,
    rounds: int = ROUNDS,
) -> DataFrame:
    """All rows and columns of ``measured`` documents with ``probability, sampled``.

    ``targets`` gives ``(margin, share)`` for source, lang and topic; by default each is
    the tempered share of tokens.  A null source, language or topic is the value
    ``(none)``.  Documents without tokens have probability 0.  Rows with the same doc_id
    are drawn together (without doc_id: those with the same text).  Existing columns
    with the added names are replaced.
    """
    margins = {m: f"_{m}" for m in MARGINS}
    base = docs.select([c for c in docs.columns if c not in ("probability", "sampled")])
    base = base.withColumns({c: F.coalesce(F.col(m).cast("string"), F.lit(NONE)) for m, c in margins.items()})
    scratch = Scratch(docs.sparkSession)
    named = [F.col(c).alias(m) for m, c in margins.items()]
    cells = scratch.keep(base.groupBy(*named).agg(F.sum("tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {m: scratch.keep(tempered(cells, m, TEMPER[m]), "target") for m in MARGINS}
    rated = scratch.keep(calibrate(rake(cells, targets, scratch, rounds), fraction), "rated")
    known = rated.select(*[F.col(m).alias(c) for m, c in margins.items()], "probability")
    if known.count() <= BROADCAST_CELLS:
        known = F.broadcast(known)
    joined = base.join(known, list(margins.values()), "left").withColumn(
        "probability", F.coalesce("probability", F.lit(0.0))
    )
    return joined.withColumn("sampled", F.col("draw") < F.col("probability")).drop(*margins.values())
