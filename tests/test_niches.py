"""The niche manager over batches, against the same steps in numpy."""

import numpy as np
import pytest

from duologue.operators.spaces import NicheManager, niche_count


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(3).normal(size=(45, 5))


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], "id long, e array<double>")


def nearest(x, c):
    return ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)


def test_batches_with_a_stop(spark, x, tmp_path):
    c = x[:4].copy()
    batches = [range(0, 12), range(12, 16), range(16, 24), range(24, 45)]
    since, fits, seen = 0, 0, []
    for k, ids in enumerate(batches):
        manager = NicheManager(spark, str(tmp_path / "m"), c.tolist() if k == 0 else None)  # each batch finds the state of the one before
        got = {r.id: r.niche for r in manager.assign(frame(spark, x, ids), "id", "e").collect()}
        assert [got[i] for i in ids] == nearest(x[list(ids)], c).tolist()
        seen += ids
        since += len(ids)
        if since >= 10:
            own = nearest(x[seen], c)
            c = np.array([x[seen][own == n].mean(0) if (own == n).any() else c[n] for n in range(4)])
            since, fits = 0, fits + 1
        assert (manager.since, manager.fits, manager.batches) == (since, fits, k + 1)
        assert np.allclose(manager.centroids, c)
    assert manager.rows().count() == 45 and fits == 3


def test_first_model_from_the_first_batch(spark, x, tmp_path):
    manager = NicheManager(spark, str(tmp_path / "f"))
    one = manager.assign(frame(spark, x, [0]), "id", "e").collect()
    assert [r.niche for r in one] == [0] and manager.centroids == []
    assert {r.niche for r in manager.assign(frame(spark, x, range(1, 20)), "id", "e").collect()} == {0}  # still without a model
    assert len(manager.centroids) == niche_count(20) and manager.fits == 1
    got = manager.assign(frame(spark, x, range(20, 45)), "id", "e")
    assert got.select("niche").distinct().count() > 1
