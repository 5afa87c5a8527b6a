"""Whitening against numpy on all rows at once, exact sums by Python's integers."""

import math

import numpy as np
import pytest

from gridloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, deviation int, state long"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def exact(vectors):
    """x by row, n and sums, in Python's integers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    return x, len(x), [sum(col) for col in zip(*x)]


def random_vectors(n, width, seed=1):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, width)) @ r.normal(size=(width, width))).astype(np.float32).tolist()


def test_equals_numpy_on_every_row(spark):
    vectors = random_vectors(400, 12)
    spoilt = [None, [], [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] + [0.0] * 11]
    df = table(spark, vectors + spoilt)
    fitted = whitening.fit_whitening(df)
    x, n, sums = exact(vectors)
    assert (fitted.n, list(fitted.sums)) == (n, sums)
    m = np.array(x, dtype=float)
    cov = np.cov(m.T, bias=True)
    values, vecs = np.linalg.eigh(cov)
    assert np.allclose(fitted.values, values[::-1][:8], rtol=1e-12)
    assert np.allclose(np.abs(fitted.components.T @ vecs[:, ::-1][:, :8]), np.eye(8), atol=1e-9)
    assert np.allclose(fitted.explained, values[::-1][:8] / values.sum(), rtol=1e-12)
    out = {r["vec_id"]: r for r in whitening.whiten(df, fitted).collect()}
    assert sorted(out) == list(range(400))
    want = (m - m.mean(axis=0)) @ fitted.components / np.sqrt(fitted.values)
    assert np.allclose([out[i]["whitened"] for i in range(400)], want, atol=1e-9)
    assert all(int(out[i]["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x[i], sums)) for i in range(400))
    error = whitening.identity_error(whitening.whiten(df, fitted), fitted)
    assert 0 <= error < 1e-10
    assert {r["state"] for r in out.values()} == {2}  # other columns stay, the two names are replaced


def test_repeated_rows_count_and_get_equal_values(spark):
    vectors = random_vectors(60, 4) + [[1.0, 2.0, 3.0, 4.0]] * 40
    df = table(spark, vectors)
    fitted = whitening.fit_whitening(df)
    assert fitted.n == 100 and len(fitted.values) == 4
    rows = [str((r["whitened"], r["deviation"])) for r in whitening.whiten(df, fitted).filter("vec_id >= 60").collect()]
    assert len(rows) == 40 and len(set(rows)) == 1


def test_the_result_doesn_t_depend_on_the_partitions(spark):
    vectors = random_vectors(300, 6)
    a, b = (whitening.fit_whitening(table(spark, vectors, p)) for p in (1, 7))
    assert a.sums == b.sums and np.allclose(a.values, b.values, rtol=1e-12)


def test_fewer_different_vectors_than_components(spark):
    df = table(spark, [[1.0, 2.0, 3.0]] * 5)
    fitted = whitening.fit_whitening(df)
    assert not fitted.usable.any() and whitening.identity_error(whitening.whiten(df, fitted), fitted) is None
    assert {tuple(r["whitened"]) for r in whitening.whiten(df, fitted).collect()} == {(None, None, None)}
    line = table(spark, [[float(i), 2.0 * i, 0.0] for i in range(10)])
    fitted = whitening.fit_whitening(line)
    assert fitted.usable.tolist() == [True, False, False] and whitening.identity_error(whitening.whiten(line, fitted), fitted) < 1e-12


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**33 * i, float(i), -(2.0**33)] for i in range(50)]
    df = table(spark, vectors)
    fitted = whitening.fit_whitening(df)
    x, n, sums = exact(vectors)
    assert list(fitted.sums) == sums
    out = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, fitted).collect()}
    assert out == {i: sum((n * a - s) ** 2 for a, s in zip(x[i], sums)) for i in range(50)}


def test_no_whole_vector_and_no_row(spark):
    for df in (table(spark, [None, []]), table(spark, [[1.0]]).filter("vec_id < 0")):
        fitted = whitening.fit_whitening(df)
        assert fitted is None
        out = whitening.whiten(df, fitted)
        assert out.count() == 0 and {"whitened", "deviation"} <= set(out.columns) and whitening.identity_error(out, fitted) is None


def test_vectors_of_two_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="one length"):
        whitening.fit_whitening(table(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]], 1))
    with pytest.raises(Exception, match="one length"):
        whitening.fit_whitening(table(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]], 2))


def test_the_query_gives_eight_components_a_row(spark, tmp_path):
    vectors = random_vectors(40, 16)
    table(spark, vectors + [None]).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op11_whitening(spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = out.collect()
    assert len(rows) == 320 and {r["component"] for r in rows} == set(range(1, 9)) and len({r["identity_error"] for r in rows}) == 1
    share = {r["component"]: r["explained"] for r in rows}
    assert all(share[i] >= share[i + 1] for i in range(1, 8))
