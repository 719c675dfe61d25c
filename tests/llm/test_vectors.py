import numpy as np
import pytest
from fixtures import plain

from weirlog.llm import near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, cells string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def by_hand(rows):
    """All pairs in double precision."""
    usable = [
        (i, np.array(v, float))
        for i, v in ((i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows)
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {k: [] for k in range(len(usable))}
    for a, (_, x) in enumerate(usable):
        for b, (_, y) in enumerate(usable):
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[a].append(b)
    root = list(range(len(usable)))
    changed = True
    while changed:
        changed = False
        for a, others in links.items():
            for b in others:
                low = min(root[a], root[b], key=lambda k: usable[k][0])
                if root[a] != low or root[b] != low:
                    root[a] = root[b] = low
                    changed = True
    result = [(i, len(links[k]), usable[root[k]][0], i == usable[root[k]][0]) for k, (i, _) in enumerate(usable)]
    taken = [(i, id(v)) for i, v in rows]
    used = {i for i, _ in usable}
    result += [(i, 0, i, True) for i, _ in rows if i not in used]
    assert len(taken) == len(rows)
    return sorted(result, key=repr)


def families(seed, n=260, dims=16):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dims) for _ in range(n)]
    for base in range(0, 60, 6):
        rows += [rows[base] * rng.uniform(0.1, 9) + rng.normal(size=dims) * spread for spread in (0.05, 0.2, 0.3, 0.4)]
    rows += [rows[0]] * 5
    hot = rng.normal(size=dims)
    rows += [hot + rng.normal(size=dims) * 0.1 for _ in range(120)]
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [4096, 16])
def test_near_groups_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = families(3)
    found = near_vectors.near_groups(make(spark, rows).repartition(4))
    assert plain(found, "vec_id", "n_links", "component_id", "kept") == by_hand(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(7, [1.0, 0.0]), (8, [1e-30, 0.0]), (9, [1e30, 1e29]), (10, [1.0, 0.0, 0.0]), (11, [0.0, -1.0]), (None, None)]
    found = plain(near_vectors.near_groups(make(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert found == by_hand(rows)
    assert (9, 2, 7, False) in found and (10, 0, 10, True) in found
    assert near_vectors.near_groups(make(spark, [])).count() == 0


def test_repeated_ids_are_rows(spark):
    found = plain(near_vectors.near_groups(make(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0])])), "vec_id", "n_links", "component_id")
    assert found == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


@pytest.mark.parametrize("cosine, least", [(0.9, 0.9), (0.95, 0.98)])
def test_recall_of_pairs_at_the_border(cosine, least):
    """Pairs at a given cosine among random vectors, the hardest case for cells."""
    rng = np.random.default_rng(7)
    n, dims = 20_000, 64
    x = near_vectors._units(rng.normal(size=(n, dims)))
    other = near_vectors._units(rng.normal(size=(2_000, dims)))
    y = x[:2_000] * cosine + near_vectors._units(other - (other * x[:2_000]).sum(1, keepdims=True) * x[:2_000]) * (1 - cosine**2) ** 0.5
    centres = near_vectors.fit_centres(x, int(2 * n**0.5))
    cells = [np.argsort(-(v @ centres.T), axis=1)[:, : near_vectors.PROBES] for v in (x[:2_000], y)]
    met = (cells[0][:, :, None] == cells[1][:, None, :]).any(axis=(1, 2)).mean()
    assert met >= least, met


def test_local_roots():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, n))))
        root = list(range(n))
        for _ in range(n):
            for i, j in zip(a, b):
                root[i] = root[j] = min(root[i], root[j])
        assert near_vectors._local_roots(n, a, b).tolist() == root
