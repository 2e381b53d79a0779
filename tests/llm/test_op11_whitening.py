import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import whitening
from palaver.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def wholes(vector):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in vector]


def made(count, dimensions, seed):
    chance = np.random.default_rng(seed)
    mixing = chance.normal(size=(dimensions, dimensions)) * np.geomspace(1, 0.01, dimensions)
    return (chance.normal(size=(count, dimensions)) @ mixing * 0.2).astype(np.float32).tolist()


def result(spark, tmp_path, rows, name="t"):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return QUERIES["op11_whitening"](spark, f"{tmp_path}/{name}").collect()


def test_the_query_against_exact_sums_and_a_plain_solver(spark, tmp_path):
    sound = made(300, 12, 1)
    rows = [(n, vector, 1) for n, vector in enumerate(sound)]
    rows += [rows[5], (None, sound[7], 0)]
    odd = [(900, None, 1), (901, [None] + sound[0][1:], 1), (902, [float("nan")] + sound[0][1:], 1),
           (903, [float("inf")] * 12, 1), (904, [], 1), (905, [0.5] * 11, 1), (906, [3e38] * 12, 1)]
    found = result(spark, tmp_path, rows + odd)
    assert len(found) == 8 * len(rows)
    x = [wholes(vector) for _, vector, _ in rows]
    n, total = len(x), [sum(column) for column in zip(*x)]
    exact = [[sum(Fraction((n * v[i] - total[i]) * (n * v[j] - total[j]), n ** 3) for v in x) for j in range(12)] for i in range(12)]
    covariance = np.array([[float(entry) for entry in line] for line in exact])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    centred = np.array([[(n * v[i] - total[i]) / n for i in range(12)] for v in x])
    expected = centred @ vectors[:, :8] / np.sqrt(values[:8])
    deviations = {(row[0], sum((n * entry - s) ** 2 for entry, s in zip(v, total))) for row, v in zip(rows, x)}
    assert {(row.vec_id, row.deviation) for row in found} == deviations
    assert {row.n for row in found} == {n} and len({row.identity_error for row in found}) == 1
    assert found[0].identity_error < 1e-10
    for component in range(8):
        own = [row for row in found if row.component == component + 1]
        assert {round(row.explained / (values[component] / covariance.trace()), 10) for row in own} == {1}
        by_id = {row.vec_id: row.whitened for row in own}
        mine = np.array([by_id[row[0]] for row in rows])
        assert min(abs(mine - expected[:, component]).max(), abs(mine + expected[:, component]).max()) < 1e-9


@pytest.mark.parametrize("shape", [(4, 4), (7, 5), (5, 9), (64, 64), (1, 1), (3, 1)])
def test_factor_and_rotations(shape):
    rows = np.random.default_rng(sum(shape)).normal(size=shape) * np.geomspace(1, 1e-6, shape[1])
    covariance = rows.T @ rows
    factor = whitening.pivoted_cholesky(covariance)
    np.testing.assert_allclose(factor @ factor.T, covariance, atol=1e-13 * covariance.max())
    columns = whitening.jacobi(factor)
    np.testing.assert_allclose(columns @ columns.T, covariance, atol=1e-13 * covariance.max())
    products = columns.T @ columns
    norms = np.sqrt(np.diag(products))
    assert abs(products / np.outer(norms, norms) - np.eye(len(norms))).max() < 1e-13


def test_rounds_hold_each_pair_once():
    for count in range(1, 9):
        pairs = [tuple(sorted(map(int, pair))) for first, second in whitening.rounds(count) for pair in zip(first, second)]
        assert sorted(pairs) == [(a, b) for a in range(count) for b in range(a + 1, count)]
        assert all(len({*map(int, first), *map(int, second)}) == 2 * len(first) for first, second in whitening.rounds(count))


def test_few_directions_equal_and_single_vectors(spark, tmp_path):
    base = np.array(made(2, 6, 2))
    rows = [(n, (base[0] * (n % 3) + 0 * base[1]).tolist(), 1) for n in range(30)]
    line = [(n, [n / 1024, 5 * n / 1024, 0.0], 1) for n in range(10)]
    found = result(spark, tmp_path, line, "line")
    assert {row.component for row in found} == {1} and found[0].identity_error < 1e-12 and found[0].explained == pytest.approx(1)
    assert {row.component for row in result(spark, tmp_path, rows, "plane")} <= {1, 2, 3, 4, 5, 6}
    assert result(spark, tmp_path, [(1, [0.1, 0.2], 1)] * 3, "equal") == []
    assert result(spark, tmp_path, [(1, [0.1, 0.2], 1)], "single") == []
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    empty = QUERIES["op11_whitening"](spark, f"{tmp_path}/none")
    assert empty.collect() == []
    assert empty.dtypes == QUERIES["op11_whitening"](spark, f"{tmp_path}/line").dtypes


def test_large_numbers_stay_exact(spark):
    rows = [(1, [1e12, -1e12], "a"), (2, [2.5e12, 3.0], "b"), (3, [-7e11, 1e11], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    found = {row.vec_id: row for row in whitening.whiten(table).collect()}
    x = {key: [math.floor(1024 * c) + 100_000 for c in vector] for key, vector, _ in rows}
    total = [sum(v[k] for v in x.values()) for k in (0, 1)]
    for key, v in x.items():
        assert int(found[key].deviation) == sum((3 * v[k] - total[k]) ** 2 for k in (0, 1))
        assert found[key].identity_error < 1e-10 and len(found[key].whitened) == 2


def test_sums_do_not_depend_on_partitions(spark):
    table = spark.createDataFrame([(n, vector, 1) for n, vector in enumerate(made(200, 5, 3))], SCHEMA)
    fits = [whitening.fit(table.repartition(k).select("vec_id", whitening.whole_entries(F.col("embedding")).alias("x")))[0] for k in (1, 7)]
    assert fits[0].total == fits[1].total and (fits[0].components == fits[1].components).all()
