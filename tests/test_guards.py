import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.functions import guard_math as gm
from tallyflow.operators import guards as gd
from tallyflow.operators.sketch import Projection

RNG = np.random.default_rng(5)


def lanes_frame(spark, ze, zx_rows):
    rows = [(g, d, float(ze[d]), float(zx[d])) for g, zx in enumerate(zx_rows) for d in range(len(ze))]
    return spark.createDataFrame(rows, "g int, d int, ze double, zx double")


def zetas(df):
    return [r["zeta"] for r in df.orderBy("g").collect()]


def test_quorum_signs_and_definition(spark):
    ze = np.array([13, 17, 26, 11, -33, 31, 52.0])
    zx = RNG.normal(0, 20, (60, 7))
    lanes = lanes_frame(spark, ze, zx)
    fast, exact = zetas(gd.quorum(lanes, 7, ["g"], k=4, exact=False)), zetas(gd.quorum(lanes, 7, ["g"], k=4))
    for f, e, x in zip(fast, exact, zx):
        legal = [i for i in range(7) if ze[i] > 0]
        assert len(legal) == 6
        want = min(
            sum(ze[i] * x[i] for i in s) / math.sqrt(sum(ze[i] ** 2 for i in s)) for s in combinations(legal, 3)
        )
        assert e == pytest.approx(want, abs=1e-9)
        assert (f > 0) == (e > 0)
        assert gm.quorum(ze, x, 4) == pytest.approx(e, abs=1e-9)
        assert gm.quorum(ze, x, 4, exact=False) == pytest.approx(f, abs=1e-9)


def test_quorum_extremes(spark):
    ze = RNG.uniform(0.1, 10, 7)
    zx = RNG.normal(0, 5, (20, 7))
    lanes = lanes_frame(spark, ze, zx)
    assert zetas(gd.quorum(lanes, 7, ["g"], k=7)) == pytest.approx(list(zx.min(axis=1)))
    assert zetas(gd.quorum(lanes, 7, ["g"], k=1)) == pytest.approx(list((zx * ze).sum(axis=1) / np.linalg.norm(ze)))
    assert zetas(gd.quorum(lanes, 7, ["g"], k=1, exact=False)) == pytest.approx(list((zx * ze).sum(axis=1)))


def test_exact_quorum_of_more_than_nineteen_rows(spark):
    ze, zx = RNG.uniform(0.1, 10, 21), RNG.normal(0, 5, (1, 21))
    lanes = lanes_frame(spark, ze, zx)
    # Sets of two rows, so that the literal form stays small: C(21, 2).
    want = min(
        (ze[i] * zx[0, i] + ze[j] * zx[0, j]) / math.hypot(ze[i], ze[j]) for i in range(21) for j in range(i)
    )
    assert zetas(gd.quorum(lanes, 21, ["g"], k=20)) == pytest.approx([want])


def test_inadmissible_reference_raises(spark):
    lanes = lanes_frame(spark, np.array([1.0, -1.0, -2.0]), RNG.normal(0, 1, (1, 3)))
    with pytest.raises(Exception, match="quorum"):
        gd.quorum(lanes, 3, ["g"]).collect()
    with pytest.raises(ValueError):
        gm.quorum(np.array([1.0, -1.0, -2.0]), np.zeros(3), 2)


def test_branch_foot():
    # On the pair of rays the foot is a projection; below them it is the corner.
    for p, q, want in ((3, 5, 4.0), (-3, 5, -4.0), (2, -7, 0.0), (6, -2, 2.0), (0, 4, 2.0)):
        assert gm.branch_foot(p, q, 0.0) == pytest.approx(want)
    # On the axis the foot leaves the vertex where the height passes twice its own.
    assert gm.branch_foot(0, 5.0, 4.0) == pytest.approx(1.5) and gm.branch_foot(0, 3.0, 4.0) == pytest.approx(0, abs=1e-6)
    for _ in range(200):
        p, q, t = RNG.normal(0, 5), RNG.normal(0, 5), RNG.uniform(0.1, 9)
        x = float(gm.branch_foot(p, q, t))
        grid = np.linspace(x - 1, x + 1, 2001)
        far = (grid - p) ** 2 + (np.sqrt(grid**2 + t) - q) ** 2
        assert (x - p) ** 2 + (math.sqrt(x * x + t) - q) ** 2 <= far.min() + 1e-9


def test_bilinear_fixtures(spark):
    r = math.sqrt
    cases = [
        (1, 0, 0, 1, 0, 1 / r(2)),
        (1, 0, 0, 1, 1, 0),
        (1, 0, 0, 0, 1, -1 / r(2)),
        (1, 0, 1, r(2), 1, 0),
        (1, 0, 1, r(5), 2, 0),
        (1, 0, -1, 0, r(5), -r(1.5)),
    ]
    df = spark.createDataFrame([tuple(float(v) for v in c) for c in cases], "xi double, psi double, t double, x double, y double, w double")
    got = df.select("w", gd.guard_bilinear(*[F.col(c) for c in ("xi", "psi", "t", "x", "y")]).alias("z")).collect()
    for row in got:
        assert row["z"] == pytest.approx(row["w"], abs=1e-9)


PROJ = Projection(5, 10)


def cells(spark, x, **ids):
    rows = [(*ids.values(), d, b, int(x[d, b])) for d in range(x.shape[0]) for b in range(x.shape[1])]
    return spark.createDataFrame(rows, [*ids, "d", "b", "c"]).withColumns({c: F.col(c).cast("int") for c in ("d", "b", *ids)})


def test_selfjoin_guard_is_sound_and_equal_to_numpy(spark):
    e = RNG.integers(-10, 11, (5, 10)).astype(float)
    q = float(np.median((e * e).sum(axis=1)))
    low, high = 0.9 * q, 1.1 * q
    sites = [e + RNG.integers(-1, 2, e.shape) * (RNG.random(e.shape) < 0.02 * i) for i in range(12)]
    many = cells(spark, sites[0], hid=0)
    for i, x in enumerate(sites[1:], 1):
        many = many.unionByName(cells(spark, x, hid=i))
    lanes = gd.site_lanes(many, cells(spark, e), PROJ, ["hid"])
    for exact in (True, False):
        got = {r["hid"]: r["zeta"] for r in gd.guard_selfjoin(lanes, low, high, PROJ, ["hid"], exact).collect()}
        for i, x in enumerate(sites):
            assert got[i] == pytest.approx(gm.selfjoin(x, e, low, high, exact), abs=1e-6)
            if got[i] >= 0:
                assert low - 1e-9 <= np.median((x * x).sum(axis=1)) <= high + 1e-9
    assert got[0] > 0


def test_join_guard_is_sound():
    for trial in range(60):
        e = RNG.integers(-10, 11, (2, 3, 4)).astype(float)
        q = float(np.median((e[0] * e[1]).sum(axis=1)))
        low, high = sorted((0.9 * q, 1.1 * q))
        if high - low < 1e-6:
            continue
        assert gm.join(e, e, low, high) >= 0
        assert gm.join(2 * e, e, low, high) <= 1e-9
        for _ in range(10):
            x = e + RNG.normal(0, 0.3, e.shape)
            if gm.join(x, e, low, high) >= 0:
                assert low - 1e-6 <= np.median((x[0] * x[1]).sum(axis=1)) <= high + 1e-6


def test_join_guard_frames_equal_numpy(spark):
    e = RNG.integers(-10, 11, (2, 3, 4)).astype(float)
    q = float(np.median((e[0] * e[1]).sum(axis=1)))
    low, high = sorted((0.8 * q, 1.2 * q))
    x = e + RNG.integers(-1, 2, e.shape)
    proj = Projection(3, 4)

    def pair(v, **ids):
        rows = [(*ids.values(), d, b, int(v[0, d, b]), int(v[1, d, b])) for d in range(3) for b in range(4)]
        return spark.createDataFrame(rows, [*ids, "d", "b", "c1", "c2"])

    lanes = gd.polarised_lanes(pair(x, hid=1), pair(e), proj, ["hid"])
    got = gd.guard_join(lanes, low, high, proj, ["hid"]).first()["zeta"]
    assert got == pytest.approx(gm.join(x, e, low, high), abs=1e-6)
