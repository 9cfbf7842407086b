"""Vectors with nulls or of other lengths: one rule for all operators."""

import numpy as np
import pytest

from quarry.operators import kmeans, knn, matrix, svm

ROWS = [(1, [1.0, 2.0, 0.0, 1.0], 0), (2, [0.0, 1.0, 1.0, 1.0], 1), (3, None, 0), (4, [None, 1.0, 1.0, 1.0], 1), (5, [2.0, 0.0, 1.0, 3.0], 1), (6, [1.0, 1.0, 1.0, 0.0], 0)]
DDL = "row_id bigint, features array<double>, label int"


@pytest.fixture(scope="module")
def tables(spark):
    whole = [r for r in ROWS if r[1] and None not in r[1]]
    return spark.createDataFrame(ROWS, DDL), spark.createDataFrame([*ROWS, (7, [1.0], 0)], DDL), whole


def test_rows_with_nulls_take_no_part(tables):
    rows, _, whole = tables
    x = np.array([r[1] for r in whole])
    assert np.allclose(np.array([r["row"] for r in matrix.gram(rows).orderBy("i").collect()]), x.T @ x)
    u, s, _ = matrix.svd(rows)
    assert np.allclose(np.sort(s), np.sort(np.linalg.svd(x)[1])) and u.count() == len(whole)
    assert sorted(r["row_id"] for r in kmeans.assign(rows, x[:2].tolist()).collect()) == [r[0] for r in whole]
    assert sum(r["n"] for r in kmeans.partial_sums(rows, x[:2].tolist()).where("pos = 0").collect()) == len(whole)
    assert kmeans.KMeans(2, x[:2].tolist()).fit(rows).centers
    found = knn.NearestNeighbors(2).fit(rows).kneighbors(rows).collect()
    assert {r["query_id"] for r in found} == {r["neighbor_id"] for r in found} == {r[0] for r in whole}
    assert svm.kernel_table(rows, rows, 1.0).count() == len(whole) ** 2
    assert svm.CascadeSVM().fit(rows).predict(rows).count() == len(whole)


def test_vectors_of_other_lengths_are_an_error(tables):
    _, ragged, whole = tables
    x = [r[1] for r in whole]
    for act in (
        lambda: matrix.gram(ragged).collect(),
        lambda: matrix.svd(ragged),
        lambda: kmeans.assign(ragged, x[:2]).collect(),
        lambda: kmeans.KMeans(2, x[:2]).fit(ragged),
        lambda: knn.NearestNeighbors(2).fit(ragged).kneighbors(ragged).collect(),
        lambda: svm.CascadeSVM().fit(ragged),
    ):
        with pytest.raises(Exception, match="different lengths"):
            act()


def test_no_rows_at_all_are_an_error(tables):
    none = tables[0].limit(0)
    for act in (lambda: matrix.svd(none), lambda: matrix.panel_svd(none), lambda: kmeans.KMeans(2).fit(none)):
        with pytest.raises(ValueError, match="no (rows|points)"):
            act()
    assert matrix.gram(none).count() == 0


def test_rows_that_share_an_id_are_all_learned(spark):
    """Two rows of one id and unlike vectors: neither is lost."""
    rows = [(1, [0.0, 0.0], 0), (1, [4.0, 4.0], 1), (2, [0.1, 0.1], 0), (3, [8.0, 8.0], 0)]
    model = svm.CascadeSVM(gamma=1.0, c=10.0).fit(spark.createDataFrame(rows, DDL))
    assert {tuple(r["v"]) for r in model.model.collect()} >= {(4.0, 4.0), (0.0, 0.0)}
    asked = spark.createDataFrame([(9, [4.0, 4.1], 0), (10, [0.0, 0.1], 0)], DDL)
    assert {r["row_id"]: r["prediction"] for r in model.predict(asked).collect()} == {9: 1, 10: 0}


def test_a_block_of_neighbours_takes_few_copies():
    """Memory beside the vectors themselves, and the same neighbours, ties to the lower id, with and without equal vectors."""
    import tracemalloc

    rng = np.random.default_rng(11)
    for copies in (0, 40):
        x, ids = rng.normal(size=(20000, 64)), rng.permutation(20000)
        x[:copies] = x[-1]
        x[1 : copies // 2 : 2, 3] = x[: copies // 2 : 2, 2] = -0.0
        x[0 : copies // 2 : 2, 3] = x[1 : copies // 2 : 2, 2] = 0.0
        asked = x[np.r_[:20, -1, 500:700]]
        tracemalloc.start()
        at, found, dist = knn.best_of_block(ids, x, asked, 5)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert copies or most < 3 * x.nbytes
        for q in range(len(asked)):
            d = np.sqrt(((x - asked[q]) ** 2).sum(axis=1))
            best = np.lexsort((ids, d))[:5]
            assert found[at == q].tolist() == ids[best].tolist() and dist[at == q].tolist() == d[best].tolist()
