import math

import numpy as np
import pytest

from tallyflow.llm import spectrum
from tallyflow.llm.whitening import whiten


def symmetric(rng, values):
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    out = turn @ np.diag(values) @ turn.T
    return (out + out.T) / 2


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 9, 40), np.repeat([1.0, 2.0, 5.0], 6), [3.0] * 7, [4.0, 0, 0, 0], 1 + 1e-7 * np.arange(20), [1e6, 1, 1e-4], [2.0], -np.arange(9.0)],
)
def test_counts_brackets_and_pairs(values):
    values = np.sort(np.array(values, dtype=float))[::-1]
    matrix = symmetric(np.random.default_rng(3), values)
    norm = float(np.abs(matrix).sum(axis=1).max())
    for shift in [*(values + 1e-8 * norm), *(values - 1e-8 * norm), -norm, norm * 2]:
        if np.abs(values - shift).min() > 1e-12 * norm:
            assert spectrum.count_above(matrix, shift) == (values > shift).sum()
    brackets = [spectrum.bracket(matrix, k) for k in range(1, len(values) + 1)]
    for group in spectrum.clusters(brackets, norm):
        found, vectors = spectrum.refine(matrix, group[0] + 1, [brackets[i] for i in group])
        assert np.abs(found - values[group]).max() < 1e-12 * norm
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * norm
        assert np.abs(vectors.T @ vectors - np.eye(len(group))).max() < 1e-12


def test_wrong_numbers_are_refused():
    matrix = np.diag([5.0, 3.0, 1.0])
    with pytest.raises(ArithmeticError):
        spectrum.certify(matrix, 1, np.array([3.0]), 5.0)
    with pytest.raises(ArithmeticError):
        spectrum.certify(matrix, 2, np.array([3.1]), 5.0)


def literal(rows):
    kept = [(i, e) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in e] for _, e in kept])
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], n, ((n * x - sums) ** 2).sum(axis=1), y @ vectors[:, ::-1] / np.sqrt(values[::-1]), values[::-1]


def test_against_dense_solver(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(40) * np.linspace(1, 3, 40)).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 39 + [None]), (302, [math.nan] * 40), (303, [math.inf] * 40), (7, rows[7][1]), (None, rows[8][1])]
    table = spark.createDataFrame([(e, i, "x", 0) for i, e in rows], "embedding array<double>, vec_id bigint, x string, component int")
    got = whiten(table.repartition(5)).toPandas()
    ids, n, deviations, expected, values = literal(rows)
    assert len(got) == len(ids) * 32 and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], values[:32] / values.sum(), rtol=1e-9)
    at = {i: k for k, i in enumerate(ids) if i is not None}
    for vec_id, part in got.dropna(subset=["vec_id"]).groupby("vec_id"):
        assert set(part["deviation"]) == {deviations[at[vec_id]]}
    wide = got.dropna(subset=["vec_id"]).drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    wanted = expected[[at[i] for i in wide.index], :32]
    signs = np.sign((wide.to_numpy() * wanted).sum(axis=0))
    assert np.allclose(wide.to_numpy() * signs, wanted, atol=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, None), (2, [math.nan]), (3, [])], [(1, [2.0, 2.0]), (2, [2.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    out = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_low_rank_lengths_and_huge_entries(spark):
    rows = [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [7.0, 7.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    out = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in out) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    huge = whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [r.deviation for r in huge] == [None, None] and sorted(round(r.whitened, 9) for r in huge) == [-1.0, 1.0]
