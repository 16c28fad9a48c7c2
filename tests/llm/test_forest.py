"""The forest on tables that need several splits, with copies, hot copies and vectors of other lengths."""

from __future__ import annotations

import numpy as np
import pytest

from perfloom.llm import forest

SCHEMA = "vec_id long, embedding array<double>, digest string, node long"


def _brute(rows, threshold=0.9):
    """n_links and component of every row."""
    links, label = [0] * len(rows), list(range(len(rows)))
    by_size: dict[int, list[int]] = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by_size.setdefault(len(v), []).append(k)

    def root(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for own in by_size.values():
        data = np.array([rows[k][1] for k in own])
        data /= np.linalg.norm(data, axis=1, keepdims=True)
        for i, j in np.argwhere(np.triu(data @ data.T >= threshold, 1)):
            for k in (own[i], own[j]):
                links[k] += 1
            label[max(root(own[i]), root(own[j]))] = min(root(own[i]), root(own[j]))
    groups = [root(k) for k in range(len(rows))]
    least: dict[int, int] = {}
    for (vec, _), g in zip(rows, groups, strict=True):
        if vec is not None:
            least[g] = min(vec, least.get(g, vec))
    return links, [least.get(g) for g in groups]


@pytest.fixture(scope="module")
def grown():
    draw = np.random.default_rng(4)
    base = draw.standard_normal((9000, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base[:3000] += base[0] * 0.9  # a wide cluster
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    close = draw.uniform(0.9, 0.94, (800, 1))
    away = draw.standard_normal((800, 24))
    away -= (away * unit[4000:4800]).sum(1, keepdims=True) * unit[4000:4800]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    pairs = close * unit[4000:4800] + np.sqrt(1 - close**2) * away
    data = np.vstack([base, pairs, np.repeat(base[5000:5002], [700, 2], axis=0), base[5003:5004] * 4])
    return [(i * 3 + 1, [float(x) for x in v]) for i, v in enumerate(data)]


def test_recall_where_trees_grow(spark, grown):
    links, least = _brute(grown)
    table = spark.createDataFrame([(*r, "x", 0) for r in grown], SCHEMA).repartition(5)
    found = {r.vec_id: r for r in forest.near_vectors(table).collect()}
    assert len(found) == len(grown) and set(found) == {r[0] for r in grown}
    given = [found[i].n_links for i, _ in grown]
    assert all(g <= w for g, w in zip(given, links, strict=True))  # no link below the threshold
    assert sum(given) >= 0.98 * sum(links)
    whole = sum(found[i].component_id == c for (i, _), c in zip(grown, least, strict=True))
    assert whole >= 0.98 * len(grown)
    assert given[5000] == 700 and given[-1] == links[-1]  # copies of one vector, and a multiple of a vector


def test_places_of_a_vector_stay_few(spark, grown):
    rows = spark.createDataFrame([(*r, "x", 0) for r in grown], SCHEMA).selectExpr("vec_id row", "vec_id", "embedding vector")
    nodes = rows.mapInArrow(forest.packed, "row long, vec_id long, size int, unit binary, digest binary").selectExpr("row", "size", "unit", "1L copies")
    leaves = forest.grow(nodes, 0.9, 2, 0)
    assert leaves.count() <= 2 * 2.72 * len(grown) and leaves.select("row", "tree").distinct().count() == 2 * len(grown)
    assert leaves.groupBy("tree", "node").count().agg({"count": "max"}).first()[0] <= forest.LEAF


def test_odd_vectors(spark):
    draw = np.random.default_rng(9)
    some = [[float(x) for x in v] for v in draw.standard_normal((6, 3))]
    rows = [(5, some[0]), (None, some[0]), (2, [2 * x for x in some[0]]), (2, some[1]), (7, [0.0, -0.0, 1.0]), (8, [0.0, 0.0, 1.0]), (9, [1e300, 1e300]), (10, [1e-300, 1e-300])]
    rows += [(11, None), (12, []), (13, [0.0, 0.0]), (14, [1.0, None]), (15, [float("inf"), 1.0]), (None, None)]
    links, least = _brute([(i, v) for i, v in rows if i != 9 and i != 10])
    table = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    found = sorted((tuple(r)[:3] for r in forest.near_vectors(table).collect() if r.vec_id not in (9, 10)), key=str)
    own = [i for i, _ in rows if i not in (9, 10)]
    assert found == sorted(zip(own, links, least, strict=True), key=str)
    tiny = {r.vec_id: r.n_links for r in forest.near_vectors(table.filter("vec_id in (9, 10)")).collect()}
    assert tiny == {9: 1, 10: 1}
    assert forest.near_vectors(table.limit(0)).count() == 0
