"""The cover tree: nested levels, pruned pairs, counts against brute force, ties at the threshold."""

from collections import Counter

import numpy as np
import pytest

from tidemark.llm import embed_dedup as ed


def cloud(seed, n, size, tight=0.06):
    """Points far from each other, a large cluster and small ones, scaled at will."""
    rng = np.random.default_rng(seed)
    far = rng.normal(size=(n, size))
    centres = rng.normal(size=(n // 20, size))
    near = centres[rng.integers(0, len(centres), n // 2)] + rng.normal(size=(n // 2, size)) * tight
    hot = centres[0] + rng.normal(size=(n // 3, size)) * tight
    v = np.concatenate([far, near, hot])
    return v * rng.uniform(0.1, 10, size=(len(v), 1))


@pytest.mark.parametrize("size", [1, 3, 16, 64])
def test_counts_and_parts_are_those_of_brute_force(size):
    v = cloud(size, 400, size)
    rng = np.random.default_rng(1)
    copies = rng.integers(1, 4, len(v))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.98
    np.fill_diagonal(hit, False)
    count, _, links = ed.search(v, None, copies, copies, 0.98)
    assert (count == hit @ copies).all()
    cut = len(v) // 2
    left, right, across = ed.search(v[:cut], v[cut:], copies[:cut], copies[cut:], 0.98)
    assert (left == hit[:cut, cut:] @ copies[cut:]).all() and (right == hit[cut:, :cut] @ copies[:cut]).all()
    root = np.arange(len(v))
    for _ in range(len(v)):
        new = np.minimum(root, np.where(hit, root[None, :], len(v)).min(axis=1))
        if (new == root).all():
            break
        root = new
    found = ed.Links(copies, copies, True)
    found.join(*links)
    assert (found.root == root).all()
    inside = [ed.search(v[s], None, copies[s], copies[s], 0.98)[2] + o for s, o in ((slice(0, cut), 0), (slice(cut, None), cut))]
    found = ed.Links(copies, copies, True)
    for pairs in (*inside, across):
        found.join(*pairs)
    assert (found.root == root).all()


def test_levels_nest_and_most_pairs_are_never_compared():
    v = np.random.default_rng(7).normal(size=(3000, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    tree = ed.CoverTree(unit, unit @ ed.directions(64), ed.reach_of(0.98) / 2)
    assert max(tree.depth) >= 2 and len(tree.centre) > 100
    for node, kids in enumerate(tree.kids):
        if kids:
            assert sorted(np.concatenate([tree.members[k] for k in kids])) == sorted(tree.members[node])
            assert all(tree.near[k] <= tree.near[node] + 1e-9 for k in kids)
        assert np.linalg.norm(unit[tree.members[node]] - unit[tree.centre[node]], axis=1).max() <= tree.far[node] + 1e-9
    seen = Counter()
    ed.search(v, None, np.ones(3000, dtype=int), np.ones(3000, dtype=int), 0.98, seen)
    assert seen["whole distances"] + seen["points compared"] < 0.1 * seen["pairs"]


def test_images_are_never_farther_apart_than_points():
    v = cloud(3, 100, 32)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    image = unit @ ed.directions(32)
    far = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    assert (np.linalg.norm(image[:, None] - image[None], axis=2) <= far + 1e-12).all()


def test_ties_at_the_threshold(spark):
    """Whole numbers whose cosine is 0.98 in double precision as well: (49, ...) with length 50."""
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [49.0, 9.0, float(np.sqrt(2500 - 49**2 - 81))], 0), (3, [48.99, 9.0, float(np.sqrt(2500 - 48.99**2 - 81))], 0), (4, [49.0, 9.0, float(np.sqrt(2500 - 49**2 - 81))], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in ed.near_duplicate_vectors(df).collect()}
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = {i: sum(j != i and x == y and cosine(np.array(a), np.array(b)) >= 0.98 for j, b, y in rows) for i, a, x in rows}
    assert want[1] == 1 and got == want


def test_large_cells_are_dealt_in_rounds(spark):
    """Floats, blocks of 40, three centres a round; many vectors of one direction, which no centre tells apart."""
    v = cloud(5, 300, 12).astype(np.float32)
    one = [(v[0] * k).astype(np.float32) for k in range(1, 200)]
    rows = [(i, x.tolist(), 0) for i, x in enumerate([*v, *one])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_duplicate_vectors(df, block=40, fan=3).collect()}
    whole = np.array([x for _, x, _ in rows], dtype=np.float64)
    count, _, links = ed.search(whole, None, np.ones(len(rows), dtype=int), np.ones(len(rows), dtype=int), 0.98)
    found = ed.Links(np.ones(len(rows), dtype=int), np.ones(0, dtype=int), True)
    found.join(*links)
    assert got == {i: (count[i], found.root[i]) for i in range(len(rows))}
