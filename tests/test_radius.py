"""Radius search, density clusters and communities against all pairs, on crowded points with copies."""

import numpy as np
import pytest

from ferrule.operators import clustering, radius


def points(seed, n=400, d=3, crowd=120):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (n - 2 * crowd, d)), rng.normal(5, 0.05, (crowd, d)), np.repeat(rng.normal(-3, 0.1, (3, d)), crowd // 3, 0)])
    return {k: v for k, v in enumerate(np.round(x, 4).tolist())}


def frame(spark, rows):
    return spark.createDataFrame([(k, v) for k, v in rows.items()], "id long, vector array<double>").repartition(4)


@pytest.mark.parametrize("r", [0.05, 0.4, 3.0, 30.0])
def test_all_pairs_within(spark, monkeypatch, r):
    for name, value in {"PER_PIVOT": 20, "BLOCK": 16}.items():
        monkeypatch.setattr(radius, name, value)
    rows = points(1)
    different, member = radius.collapsed(frame(spark, rows))
    reps = {x.id: x.vector for x in different.collect()}
    assert len(reps) < len(rows) and sum(x.n for x in different.collect()) == len(rows)
    assert all(reps[m.of] == rows[m.id] for m in member.collect())
    ids, x = list(reps), np.array(list(reps.values()))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(d <= r), strict=True) if i != j}
    got = [(p.a, p.b) for p in radius.within(different.select("id", "vector"), r).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = unit @ unit.T
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(cosine >= 1 - r / 20), strict=True) if i != j}
    assert {(p.a, p.b) for p in radius.similar(different.select("id", "vector"), 1 - r / 20).collect()} == want


def test_far_cells_are_not_met(spark, monkeypatch):
    """Most pairs are never compared: guests are few where the radius is small."""
    monkeypatch.setattr(radius, "PER_PIVOT", 20)
    rows = points(2)
    different, _ = radius.collapsed(frame(spark, rows))
    n = different.count()
    _, sizes = radius.placed(different.select("id", "vector"), 0.05)
    assert sizes[:, 0].sum() == n and (sizes[:, 0] * sizes[:, 1]).sum() < n * n / 4


def by_definition(rows, r, least):
    ids, x = list(rows), np.array(list(rows.values()))
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= r
    core = near.sum(1) >= least
    label = {}
    for i in range(len(ids)):
        if core[i] and ids[i] not in label:
            todo, seen = [i], {i}
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(near[k] & core):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                label[ids[j]] = min(ids[j2] for j2 in seen)
    for i in range(len(ids)):
        if not core[i] and (near[i] & core).any():
            label[ids[i]] = min(label[ids[j]] for j in np.flatnonzero(near[i] & core))
    return {k: label.get(k) for k in ids}


@pytest.mark.parametrize(("r", "least"), [(0.15, 5), (0.4, 3), (0.4, 60)])
def test_density_clusters(spark, monkeypatch, r, least):
    monkeypatch.setattr(radius, "PER_PIVOT", 25)
    rows = points(3)
    assert {x.id: x.cluster for x in clustering.dbscan(frame(spark, rows), r, least).collect()} == by_definition(rows, r, least)


def test_noise_is_a_cluster_and_nulls_are_noise(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, vector array<double>")
    got = {x.id: x.cluster for x in clustering.dbscan(df, 0.1, 2, "cosine", noise=True).collect()}
    assert got == {1: 1, 2: 1, 3: -1, 4: -1, 5: -1}
    assert clustering.dbscan(df.limit(0), 0.1, 2).collect() == []
    with pytest.raises(ValueError, match="metric"):
        clustering.dbscan(df, 1, 1, "other")


@pytest.mark.parametrize(("score", "size"), [(0.99, 4), (0.9, 10), (0.6, 3)])
def test_communities_in_order(spark, score, size):
    rows = points(4, 200, 3, 60)
    ids, x = list(rows), np.array(list(rows.values()))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= score
    taken, want = set(), set()
    for i in sorted(range(len(ids)), key=lambda i: (-near[i].sum(), ids[i])):
        left = [ids[j] for j in np.flatnonzero(near[i]) if ids[j] not in taken]
        if near[i].sum() >= size and len(left) >= size:
            want |= {(ids[i], j) for j in left}
            taken |= set(left)
    assert {(r.community, r.id) for r in clustering.communities(frame(spark, rows), score, size).collect()} == want


def test_guests_are_not_copied_into_all_cells(spark, monkeypatch):
    """In 32 dimensions each point is a guest of nearly each cell: blocks of all points are compared, with the same pairs, and the
    nearest of each point only, if asked."""
    for name, value in {"PER_PIVOT": 5, "BLOCK": 16, "WHOLE": 150, "AT_ONCE": 2000, "SOME": 64}.items():
        monkeypatch.setattr(radius, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 32))
    df = frame(spark, dict(enumerate(x.tolist()))).select("id", "vector")
    _, sizes = radius.placed(df, 7.0)
    assert sizes[:, 1].sum() > 20 * 300
    monkeypatch.setattr(radius, "placed", None)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = [(p.a, p.b) for p in radius.within(df, 7.0).collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(*(k.tolist() for k in np.nonzero(d <= 7.0)), strict=True))
    some = radius.within(df, 7.0, 3).collect()
    assert len(some) < len(got)
    for k in range(300):
        want = sorted(d[k][d[k] <= 7.0])[:3]
        assert np.allclose(sorted(p.distance for p in some if p.a == k)[:3], want)


def test_communities_without_pairs(spark, monkeypatch):
    """Neighbours are counted, never written as pairs, and batches of groups are decided as one after the other would be."""
    monkeypatch.setattr(clustering, "similar", None)
    monkeypatch.setattr(clustering, "BATCH", 40)
    for name, value in {"COUNTED": 70, "TILE": (8, 16)}.items():
        monkeypatch.setattr(radius, name, value)
    rows = points(7, 240, 3, 60) | {1000: [0.0, 0.0, 0.0]}
    ids, x = list(rows)[:-1], np.array(list(rows.values()))[:-1]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    taken, want = set(), set()
    for i in sorted(range(len(ids)), key=lambda i: (-near[i].sum(), ids[i])):
        left = [ids[j] for j in np.flatnonzero(near[i]) if ids[j] not in taken]
        if len(left) >= 3:
            want |= {(ids[i], j) for j in left}
            taken |= set(left)
    assert {(r.community, r.id) for r in clustering.communities(frame(spark, rows), 0.9, 3).collect()} == want
    assert clustering.communities(frame(spark, rows).limit(0), 0.9, 3).collect() == []


@pytest.mark.parametrize(("r", "least"), [(0.15, 5), (0.4, 3), (0.4, 60), (30.0, 3)])
def test_density_clusters_without_pairs(spark, monkeypatch, r, least):
    """Cores are counted and joined block by block, and no pairs are written."""
    for module, name, value in [(clustering, "within", None), (clustering, "similar", None), (clustering, "COUNTED", 70), (radius, "COUNTED", 70), (radius, "TILE", (8, 16)), (clustering, "FIRST", 50)]:
        monkeypatch.setattr(module, name, value)
    rows = points(9)
    assert {x.id: x.cluster for x in clustering.dbscan(frame(spark, rows), r, least).collect()} == by_definition(rows, r, least)


def test_chains_are_joined_across_blocks():
    """Parts of two sides whose largest changes while they are joined."""
    rng = np.random.default_rng(10)
    for n, m in [(30, 1), (1, 30), (40, 45), (200, 180)]:
        z = rng.uniform(0, 1, (n + m, 2)) * [n + m, 0.5]
        near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) <= 1.0
        inner = [radius.joined(side, side, np.arange(len(side)), 1.0, radius.Close, True) for side in (z[:n], z[n:])]
        got = radius.joined(z[:n], z[n:], np.r_[inner[0], inner[1] + n], 1.0, radius.Close, False)
        reach = near.copy()
        for _ in range(10):
            reach = reach @ reach
        assert ((got[:, None] == got[None]) == reach).all()


def test_near_the_radius_is_measured_exactly():
    for middle, r in [(0.0, 0.5), (1e6, 0.5), (0.0, 0.0), (0.0, 1e30)]:
        x = middle + np.array([[0.0, 0.0], [0.3, 0.4], [0.3, 0.4 + 1e-9], [0.5, 0.0], [0.3, 0.4]])
        want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= r
        assert (radius.Close(x, r)(x) == want).all()


def test_seeds_of_density_clusters_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(clustering, "within", None)
    rows = points(11, 200, 2, 60)
    df = frame(spark, rows)
    label = by_definition(rows, 0.4, 3)
    named = {c: k for k, c in enumerate(sorted(set(label.values()), key=lambda c: -1 if c is None else c))}
    centre = np.array([np.mean([rows[i] for i in rows if label[i] == c], 0) for c in named])
    want = {i: int(np.sqrt(((centre - v) ** 2).sum(1)).argmin()) for i, v in rows.items()}
    assert {r.id: r.cluster for r in clustering.density_seeded_k_means(df, df, 0.4, 3, 0).collect()} == want
