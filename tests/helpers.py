"""Small fixtures and literal simulations that the Spark results are compared with."""

from __future__ import annotations

import random

from tallyflow.functions.mixing import MASK31

COLUMNS = "sid int, hid int, key bigint, upd bigint, ts bigint, seq bigint"


def random_updates(n=400, seed=1, keys=12, hot=True, signed=True):
    """Random records with many ties in ts; one ts and one key hold about a third of them."""
    rng = random.Random(seed)
    rows = []
    ts = 1000
    for seq in range(n):
        crowded = hot and n // 3 <= seq < 2 * n // 3
        ts += 0 if crowded else rng.choice([0, 0, 1, 3, 7])
        key = 5 if hot and rng.random() < 0.35 else rng.randrange(keys)
        upd = rng.choice([1, 1, 1, -1, 2]) if signed else 1
        rows.append((rng.randrange(3), rng.randrange(4), key, upd, ts, seq))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def collect(df, *columns, order=None):
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(rows, key=order) if order else sorted(rows)


def fold(a, b, x):
    r = a * x + b
    return ((r >> 31) ^ r) & MASK31


def cell(seeds, width, key):
    """Bucket and sign of a key in one sketch row, straight from the definition."""
    _, f0, f1, f2, f3, f4, f5 = seeds
    x = key % MASK31
    h = fold(fold(fold(x, f2, f3), x, f4), x, f5)
    return fold(f0, f1, x) % width, 1 if (h >> 15) & 1 else -1


def literal_sketch(proj, updates):
    """Dense D x L counters of (key, upd) pairs."""
    out = [[0] * proj.width for _ in range(proj.depth)]
    for key, upd in updates:
        for d, seeds in enumerate(proj.seeds()):
            b, s = cell(seeds, proj.width, key)
            out[d][b] += s * upd
    return out
