"""Integer hashing as Column arithmetic.

All products stay below 2**63, so the expressions are safe under ANSI mode and
give the same value in any SQL engine with 64-bit integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK31 = 2147483647  # 2**31 - 1

# Odd multipliers of a 31-bit xorshift-multiply mixer.
MIX_A = 2146121005
MIX_B = 73244475
MIX_HI = 1640531527


def seed31(*parts) -> int:
    """A reproducible seed in [1, 2**31 - 2] for the given labels."""
    text = ":".join(str(p) for p in parts)
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % (MASK31 - 1) + 1


def fold_key(key: Column) -> Column:
    """Bring any 64-bit key below 2**31 - 1."""
    return F.pmod(key, F.lit(MASK31).cast("bigint"))


def hash31(a: Column, b: Column, x: Column, family: str = "xor") -> Column:
    """31-bit linear hash of x: the high bits of a*x+b folded onto the low ones, by xor or sum."""
    r = a * x + b
    high = F.shiftright(r, 31)
    folded = high.bitwiseXOR(r) if family == "xor" else high + r
    return folded.bitwiseAND(F.lit(MASK31).cast("bigint"))


def _xorshift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, n))


def _times(x: Column, m: int) -> Column:
    return (x * F.lit(m).cast("bigint")).bitwiseAND(F.lit(MASK31).cast("bigint"))


def uniform31(row_id: Column, *labels) -> Column:
    """Uniform integer in [0, 2**31) that depends on the row id and labels only.

    Unlike ``rand`` it does not depend on partitioning, so a source built from it
    can be replayed and recomputed after a lost executor.
    """
    mask = F.lit(MASK31).cast("bigint")
    hi = F.shiftright(row_id, 31).bitwiseAND(mask) * F.lit(MIX_HI).cast("bigint")
    x = (row_id.bitwiseAND(mask) + hi + F.lit(seed31(*labels)).cast("bigint")).bitwiseAND(mask)
    x = _times(_xorshift(x, 15), MIX_A)
    x = _times(_xorshift(x, 14), MIX_B)
    return _xorshift(x, 15)


def uniform31_array(row_id: np.ndarray, *labels) -> np.ndarray:
    """NumPy twin of :func:`uniform31`, for 64-bit row ids."""
    x = row_id >> 31
    x &= MASK31
    x *= MIX_HI
    x += row_id & MASK31
    x += seed31(*labels)
    x &= MASK31
    for shift, factor in ((15, MIX_A), (14, MIX_B)):
        x ^= x >> shift
        x *= factor
        x &= MASK31
    x ^= x >> 15
    return x


def uniform_int(row_id: Column, high: int, *labels) -> Column:
    """Uniform integer in 1..high, high < 2**31."""
    return F.shiftright(uniform31(row_id, *labels) * F.lit(high).cast("bigint"), 31) + F.lit(1).cast("bigint")


def uniform_unit(row_id: Column, *labels) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (uniform31(row_id, *labels).cast("double") + F.lit(0.5)) / F.lit(float(1 << 31))
