"""The number of probes follows from measured recall."""

import numpy as np
import pytest
from fixtures import plain
from test_vectors import by_hand, families, make

from weirlog.llm import near_vectors


@pytest.mark.parametrize("cells", [282, 2_000])
def test_recall_at_the_border_does_not_fall_with_more_cells(cells):
    """Pairs at cosine 0.9 of vectors that neither centres nor probes have seen."""
    rng = np.random.default_rng(7)
    units = near_vectors._units(rng.normal(size=(22_000, 64)))
    centres = near_vectors.fit_centres(units[:18_000], cells, rounds=3)
    probes = near_vectors.probes_for(units[:20_000], centres)
    x, other = units[20_000:], rng.normal(size=(2_000, 64))
    across = near_vectors._units(other - (other * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + 0.19**0.5 * across
    near = [np.argsort(-(v @ centres.T), axis=1)[:, :probes] for v in (x, y)]
    met = (near[0][:, :, None] == near[1][:, None, :]).any(axis=(1, 2)).mean()
    assert met >= 0.955, (probes, met)


def test_met_at():
    a, b = np.array([[0.9, 0.5, 0.1, 0.0]]), np.array([[0.0, 0.5, 0.9, 0.6]])
    assert near_vectors._met_at(a, a).tolist() == [1] and near_vectors._met_at(a, b).tolist() == [3]


def test_more_probes_than_the_least(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "PROBES", 1)
    monkeypatch.setattr(near_vectors, "RECALL", 1.0)
    rows = families(3)
    found = near_vectors.near_groups(make(spark, rows).repartition(4))
    assert plain(found, "vec_id", "n_links", "component_id", "kept") == by_hand(rows)
