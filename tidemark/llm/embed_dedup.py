"""Embedding near-dedup by cover-tree dual traversal.

Vectors of one label are linked where the cosine, in double precision, reaches ``threshold``. On unit vectors that is a
distance of at most sqrt(2 - 2 * threshold), and the search works on distances:

1. Equal vectors of a label are one point from here on, with the number of its copies.
2. Each point has an image: its projection on a few fixed orthonormal directions. Two images are never farther apart than
   their points, so what is apart in the image is apart. Points of many dimensions lie about as far from each other as
   they can, and no ball but the whole holds many of them; their images have few dimensions, and there balls nest.
3. Cover trees stand over the images. Levels have halving radii; every node knows the distance of its farthest descendant,
   in the image and in the whole space. The upper levels are tables: a cell of more than ``block`` points is dealt among
   centres drawn from its own points (about ``fan``), round by round, so that the number of cells follows the table. Pairs
   of cells go down with the levels and end where the distance less both radii is beyond the bound.
4. Each surviving pair of last cells is a task: a cover tree on either side, walked down together under the same bound, in
   the image first and in the whole space for what is left. A pair of nodes wholly within the bound is counted without a
   look at its points. Leaves that remain are tested by their cosine. The result is exact.
5. A task gives back a count for each point, not the pairs, and a few links that join what is connected. Counts are
   summed, components are found over those links.

Vectors that are null, zero, or hold nulls or non-finite components, rows with a null label or id, and vectors of unequal
length link with nothing. A row with a null id has no component and is kept. Rows stay one to one; a row that repeats an
id counts as another vector. Empty tables give empty results. Other columns are left behind.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Rounding that distances may carry; candidates within it are judged by their cosine.
SLACK = 1e-6
#: Dimensions of an image.
IMAGE = 8
#: Pairs of points that are looked at together.
CHUNK = 1 << 19


def directions(size: int) -> np.ndarray:
    """``size`` x IMAGE: orthonormal columns, the same for every vector of that size."""
    drawn = np.random.default_rng(size).normal(size=(size, min(size, IMAGE)))
    return np.linalg.qr(drawn)[0]


def reach_of(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class CoverTree:
    """Nested levels with halving radii over the images of unit vectors.

    ``near`` is how far a node's points lie from its centre in the image, ``far`` in the whole space. A node of at most
    ``leaf`` points is a leaf, and so is one so tight that its points link with each other for the most part.
    """

    def __init__(self, units: np.ndarray, images: np.ndarray, tight: float, leaf: int = 12):
        self.units, self.images, self.tight, self.leaf = units, images, tight, leaf
        self.centre: list[int] = []
        self.near: list[float] = []
        self.far: list[float] = []
        self.depth: list[int] = []
        self.kids: list[list[int]] = []
        self.members: list[np.ndarray] = []
        level = 1.0
        work = [(-1, 0, np.arange(len(units)), level, 0)]
        while work:
            above, centre, members, level, depth = work.pop()
            node = len(self.centre)
            if above >= 0:
                self.kids[above].append(node)
            near = np.linalg.norm(images[members] - images[centre], axis=1)
            far = float(np.linalg.norm(units[members] - units[centre], axis=1).max())
            self.centre.append(centre)
            self.near.append(float(near.max()))
            self.far.append(far)
            self.depth.append(depth)
            self.kids.append([])
            self.members.append(members)
            if len(members) <= leaf or far <= tight or self.near[node] <= 1e-9:
                continue
            while level / 2 >= self.near[node]:
                level /= 2
            parts = self._cover(centre, members, level / 2)
            if len(parts) == 1:
                continue
            work += [(node, c, own, level / 2, depth + 1) for c, own in parts]
        self.near_, self.far_, self.centre_ = np.array(self.near), np.array(self.far), np.array(self.centre)
        self.size_ = np.fromiter(map(len, self.members), dtype=np.int64, count=len(self.members))
        self.n_kids = np.fromiter(map(len, self.kids), dtype=np.int64, count=len(self.kids))
        self.first_kid = np.cumsum(self.n_kids) - self.n_kids
        self.kid = np.fromiter((k for own in self.kids for k in own), dtype=np.int64, count=int(self.n_kids.sum()))

    def _cover(self, centre: int, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        """Centres more than ``radius`` from each other, each with the points that it covers first; the node's own first."""
        rest = members
        images = self.images[rest]
        parts = []
        c = centre
        while True:
            d = images - self.images[c]
            held = np.einsum("ij,ij->i", d, d) <= radius * radius
            parts.append((c, rest[held]))
            rest, images = rest[~held], images[~held]
            if not len(rest):
                return parts
            c = int(rest[0])


def _expand(tree: CoverTree, nodes: np.ndarray, open_: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where(open_, tree.kid[np.minimum(tree.first_kid[nodes] + place, max(0, len(tree.kid) - 1))] if len(tree.kid) else nodes, nodes)


def leaf_pairs(a: CoverTree, b: CoverTree, reach: float, seen: Counter | None = None):
    """(x, y, whole) of node pairs, each pair of nodes once: leaves that may hold points within ``reach``, and, where
    ``whole``, nodes all of whose points are. ``seen`` counts what was looked at and what was dropped."""
    same = a is b
    seen = Counter() if seen is None else seen
    x, y = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(x):
        nexts = []
        for at in range(0, len(x), CHUNK):
            p, q = x[at : at + CHUNK], y[at : at + CHUNK]
            seen["node pairs"] += len(p)
            one = (p == q) if same else np.zeros(len(p), dtype=bool)
            near = _apart(a.images[a.centre_[p]], b.images[b.centre_[q]])
            keep = one | (near - a.near_[p] - b.near_[q] <= reach)
            p, q, one = p[keep], q[keep], one[keep]
            seen["whole distances"] += len(p)
            d = _apart(a.units[a.centre_[p]], b.units[b.centre_[q]])
            keep = one | (d - a.far_[p] - b.far_[q] <= reach)
            p, q, one, d = p[keep], q[keep], one[keep], d[keep]
            inside = (d + a.far_[p] + b.far_[q] <= reach - 3 * SLACK) & (a.size_[p] * b.size_[q] > 16)
            leaf = ~inside & (a.n_kids[p] == 0) & (b.n_kids[q] == 0)
            for i in np.flatnonzero(inside):
                yield int(p[i]), int(q[i]), True
            if leaf.any():
                yield p[leaf], q[leaf], False
            go = ~inside & ~leaf
            p, q, one = p[go], q[go], one[go]
            if len(p):
                ox, oy = a.n_kids[p] > 0, b.n_kids[q] > 0
                # the wider side opens; both where they are as wide, and a node paired with itself
                both = one | ((a.near_[p] <= 2 * b.near_[q]) & (b.near_[q] <= 2 * a.near_[p]))
                ox, oy = ox & (both | ~oy | (a.near_[p] >= b.near_[q])), oy & (both | ~ox | (b.near_[q] > a.near_[p]))
                n, m = np.where(ox, a.n_kids[p], 1), np.where(oy, b.n_kids[q], 1)
                total = n * m
                row = np.repeat(np.arange(len(p)), total)
                k = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
                c, e = _expand(a, p[row], ox[row], k // m[row]), _expand(b, q[row], oy[row], k % m[row])
                once = ~one[row] | (c <= e)
                nexts.append((c[once], e[once]))
        x, y = (np.concatenate(z) for z in zip(*nexts)) if nexts else (np.zeros(0, dtype=np.int64),) * 2


class Links:
    """Counts by point, and roots that join what is linked."""

    def __init__(self, copies_a: np.ndarray, copies_b: np.ndarray, inner: bool):
        self.copies = copies_a if inner else np.concatenate([copies_a, copies_b])
        self.count = np.zeros(len(self.copies), dtype=np.int64)
        self.root = np.arange(len(self.copies))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Linked pairs, each once."""
        n = len(self.copies)
        self.count += np.bincount(i, weights=self.copies[j], minlength=n).astype(np.int64) + np.bincount(j, weights=self.copies[i], minlength=n).astype(np.int64)
        self.join(i, j)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(root, np.maximum(x, y), low)
            while True:  # roots of roots
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def block(self, own: np.ndarray, other: np.ndarray, hit: np.ndarray | None, inner: bool) -> None:
        """All pairs of two sets of points where ``hit`` (None: everywhere); ``inner`` where both are one set."""
        if hit is None:
            self.count[own] += int(self.copies[other].sum()) - (self.copies[own] if inner else 0)
            if not inner:
                self.count[other] += int(self.copies[own].sum())
            every = np.concatenate([own, other])
            self.join(every[1:], np.full(len(every) - 1, every[0]))
            return
        self.count[own] += hit @ self.copies[other]
        if not inner:
            self.count[other] += self.copies[own] @ hit
        some = np.flatnonzero(hit.any(axis=1))
        self.join(own[some], other[hit[some].argmax(axis=1)])
        some = np.flatnonzero(hit.any(axis=0))
        self.join(other[some], own[hit[:, some].argmax(axis=0)])
        # those two ties leave parts of a connected set apart where their first hits differ
        while True:
            r, c = self.root[own], self.root[other]
            low = np.where(hit, c[None, :], len(self.root)).min(axis=1)
            high = np.where(hit, c[None, :], -1).max(axis=1)
            split = np.flatnonzero((high >= 0) & ((low != r) | (high != r)))
            if not len(split):
                return
            self.join(np.concatenate([own[split], own[split]]), np.concatenate([low[split], high[split]]))


def search(left: np.ndarray, right: np.ndarray | None, copies_left: np.ndarray, copies_right: np.ndarray, threshold: float, seen: Counter | None = None):
    """Linked copies by point of either side, and links (indices, right ones after the left) that join what is connected.

    ``right`` is None for the pairs within ``left``.
    """
    seen = Counter() if seen is None else seen
    reach = reach_of(threshold)
    basis = directions(left.shape[1])

    def tree(v: np.ndarray) -> CoverTree:
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        return CoverTree(unit, unit @ basis, reach / 2)

    a = tree(left)
    b = a if right is None else tree(right)
    inner = right is None
    shift = 0 if inner else len(left)
    links = Links(copies_left, copies_right, inner)
    seen["pairs"] += len(left) * (len(left) - 1) // 2 if inner else len(left) * len(right)
    seen["nodes"] += len(a.centre) + (0 if inner else len(b.centre))
    sizes_a, sizes_b = a.size_, b.size_
    start_a, start_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    flat_a, flat_b = np.concatenate(a.members), np.concatenate(b.members)
    for x, y, whole in leaf_pairs(a, b, reach, seen):
        if whole:
            one = inner and x == y
            seen["pairs counted whole"] += len(a.members[x]) * len(b.members[y])
            links.block(a.members[x], b.members[y] + shift, None, one)
            continue
        area = sizes_a[x] * sizes_b[y]
        for k in np.flatnonzero(area > 1024):  # large leaves are tight: most of their pairs link
            own, other = a.members[x[k]], b.members[y[k]]
            one = inner and x[k] == y[k]
            for at in range(0, len(own), 2048):
                part = own[at : at + 2048]
                seen["points compared"] += len(part) * len(other)
                hit = a.units[part] @ b.units[other].T >= threshold
                if one:
                    hit[np.arange(len(part)), np.arange(at, at + len(part))] = False
                if hit.any():
                    links.block(part, other + shift, hit, one)
        x, y, area = x[area <= 1024], y[area <= 1024], area[area <= 1024]
        ends = np.cumsum(area)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            p, q, n = x[at:to], y[at:to], area[at:to]
            row = np.repeat(np.arange(len(p)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            width = sizes_b[q][row]
            i, j = flat_a[start_a[p][row] + k // width], flat_b[start_b[q][row] + k % width]
            if inner:
                once = (p[row] != q[row]) | (i < j)
                i, j = i[once], j[once]
            seen["images compared"] += len(i)
            close = _apart(a.images[i], b.images[j]) <= reach
            i, j = i[close], j[close]
            seen["points compared"] += len(i)
            linked = np.einsum("ij,ij->i", a.units[i], b.units[j]) >= threshold
            links.pairs(i[linked], j[linked] + shift)
            at = to
    joined = np.flatnonzero(links.root != np.arange(len(links.root)))
    count = links.count
    return (count, count[:0], np.stack([joined, links.root[joined]])) if inner else (count[:shift], count[shift:], np.stack([joined, links.root[joined]]))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _with_image(batches):
    """Vectors of one batch may have any sizes."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("vector"))
        made: list = [None] * batch.num_rows
        sizes = np.diff(lists.offsets.to_numpy())
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            v = _vectors(lists.take(pa.array(rows)))
            image = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ directions(int(size))
            for r, x in zip(rows, image):
                made[r] = x
        yield batch.append_column("image", pa.array(made, pa.list_(pa.float64())))


def _compare(threshold: float):
    """Rows come sorted by task; side 0 before side 1. Out: (point, n, other) with n > 0 for counts, other for links."""

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        side = whole["side"].to_numpy()
        point, copies = whole["point"].to_numpy(), whole["copies"].to_numpy()
        vectors = _vectors(whole["vector"])
        l, r = side == 0, side == 1
        count_l, count_r, links = search(vectors[l], vectors[r] if r.any() else None, copies[l], copies[r] if r.any() else copies[l], threshold)
        ids = np.concatenate([point[l], point[r]])
        counts = np.concatenate([count_l, count_r])
        got = counts > 0
        x, y = links
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[got], ids[x]])), pa.array(np.concatenate([counts[got], np.zeros(len(x), dtype=np.int64)])), pa.concat_arrays([pa.nulls(int(got.sum()), pa.int64()), pa.array(ids[y], pa.int64())])],
            names=["point", "n", "other"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if held and tasks[a] != now:
                    yield one(held)
                    held = []
                now = tasks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield one(held)

    return run


def _deal(fan: int):
    """Each point of a cell to the nearest of its centres; points as near to several go by their number."""

    def run(points: pa.Table, centres: pa.Table) -> pa.Table:
        if not points.num_rows:
            return points.select([]) if not points.num_columns else points.slice(0, 0)
        cell = points["cell"].to_numpy()
        image, point = _vectors(points["image"]), points["point"].to_numpy()
        made, apart = cell, np.full(len(cell), np.nan)
        drawn = centres["drawn"][0].as_py() if centres.num_rows else []
        if drawn:
            c = np.array(drawn)
            d = np.sqrt(np.maximum(0, (image**2).sum(axis=1)[:, None] - 2 * image @ c.T + (c**2).sum(axis=1)[None, :]))
            tied = d <= d.min(axis=1, keepdims=True) + 1e-9
            turn = (np.arange(len(c))[None, :] + (point.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)[:, None]) % len(c)
            pick = np.where(tied, turn, len(c)).argmin(axis=1)
            made, apart = cell * (4 * fan + 1) + 1 + pick, d[np.arange(len(cell)), pick]
        keep = [n for n in points.column_names if n in ("space", "point", "copies", "vector", "image")]
        out = points.select(keep)
        return out.append_column("parent", pa.array(cell)).append_column("cell", pa.array(made)).append_column("apart", pa.array(apart))

    return run


def _cells(points: DataFrame, block: int, fan: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """(space, cell, point, copies, vector), cells of at most ``block`` points; and (space, i, j), pairs of cells that may
    hold points within ``reach``. A round deals the cells that are too large and takes their pairs down a level."""
    kind = points.schema
    dealt_as = ", ".join([*(f"{c} {kind[c].dataType.simpleString()}" for c in ("space", "point", "copies", "vector", "image")), "parent long, cell long, apart double"])
    state = points.withColumn("cell", F.lit(0).cast("long"))
    pairs = points.select("space").distinct().select("space", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    known = None  # (space, cell, centre, radius) of cells that a round made
    turn = 0
    while True:
        large = state.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > block)
        if large.isEmpty():
            return state, pairs
        turn += 1
        large = written(large, "large")
        marked = state.join(large, ["space", "cell"], "left")
        busy, still = marked.where("total is not null"), marked.where("total is null")
        wanted = F.least(F.lit(fan), F.ceil(2 * F.col("total") / block))
        hashed = F.xxhash64("point", F.lit(turn))
        drawn = busy.where(F.pmod(hashed, F.ceil(F.col("total") / wanted)) == 0).groupBy("space", "cell").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("point", "image"))), 1, 4 * fan), lambda d: d["image"]).alias("drawn"), F.max("total").alias("total"))
        drawn = written(drawn, "drawn")
        parts = F.ceil(F.col("total") / (4 * block))
        left = busy.withColumn("salt", F.pmod(F.xxhash64("point"), parts)).drop("total")
        right = drawn.select("space", "cell", "drawn", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
        dealt = left.groupBy("space", "cell", "salt").cogroup(right.groupBy("space", "cell", "salt")).applyInArrow(_deal(fan), dealt_as)
        dealt = written(dealt, "dealt")
        radii = dealt.groupBy("space", "parent", "cell").agg(F.max("apart").alias("radius"))
        place = (F.col("cell") - F.col("parent") * (4 * fan + 1) - 1).cast("int")
        made = radii.join(drawn.select("space", F.col("cell").alias("parent"), "drawn"), ["space", "parent"], "left").select("space", "parent", "cell", F.get("drawn", place).alias("centre"), "radius")
        rest = still.select("space", "cell").distinct()
        rest = rest.select("space", F.col("cell").alias("parent"), "cell") if known is None else rest.join(known, ["space", "cell"], "left").select("space", F.col("cell").alias("parent"), "cell", "centre", "radius")
        kids = written(made.unionByName(rest, allowMissingColumns=True), "kids")
        known = kids.drop("parent")
        first, second = kids.toDF("space", "i", "a", "c1", "r1"), kids.toDF("space", "j", "b", "c2", "r2")
        apart = F.sqrt(F.aggregate(F.zip_with("c1", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        gone = F.coalesce(apart - F.col("r1") - F.col("r2") > reach + SLACK, F.lit(False)) & (F.col("a") != F.col("b"))
        pairs = written(pairs.join(first, ["space", "i"]).join(second, ["space", "j"]).where((F.col("i") != F.col("j")) | (F.col("a") <= F.col("b"))).where(~gone).select("space", F.col("a").alias("i"), F.col("b").alias("j")), "pairs")
        columns = ("space", "point", "copies", "vector", "image", "cell")
        state = written(dealt.select(*columns).unionByName(still.select(*columns)), "state")


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.98, block: int = 8192, fan: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    narrow = dict(df.dtypes)[vector_col] == "array<float>"  # floats travel as such; distances are of doubles either way
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("vector"), F.col(label_col).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    keyed = rows.withColumn("digest", F.when(F.coalesce(sound, F.lit(False)), F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("vector", lambda x: (x + 0.0).cast("string"))))))
    keyed = written(keyed.select("vec_id", "label", "vector", "digest"), "vectors")
    # one row stands for equal vectors, so that a vector with many copies is one row of every task before any exchange
    least = F.min_by(F.struct("label", "vector"), "vec_id").alias("own")
    points = keyed.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("copies"), least)
    v = F.col("own.vector")
    peak = F.array_max(F.transform(v, F.abs))
    plain = v if narrow else F.when(peak.between(1e-100, 1e100), v).otherwise(F.transform(v, lambda x: x / peak))  # squares stay in range
    space = F.struct(F.col("own.label").alias("label"), F.size(v).alias("size")).alias("space")
    points = written(points.select("digest", "point", "copies", space, plain.alias("vector")), "points")
    shape = points.select("space", "point", "copies", "vector")
    imaged = shape.mapInArrow(_with_image, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in shape.schema), "image array<double>"]))
    reach = reach_of(threshold)
    blocks, pairs = _cells(written(imaged, "images"), block, fan, reach)
    tasks = pairs.select("space", "i", "j", F.xxhash64("space", "i", "j").alias("task"))
    left = tasks.join(blocks.withColumnRenamed("cell", "i"), ["space", "i"]).select("task", F.lit(0).alias("side"), "point", "copies", "vector")
    right = tasks.where("i <> j").join(blocks.withColumnRenamed("cell", "j"), ["space", "j"]).select("task", F.lit(1).alias("side"), "point", "copies", "vector")
    dealt = left.unionByName(right).repartition("task").sortWithinPartitions("task", "side", "point")
    found = written(dealt.mapInArrow(_compare(threshold), "point long, n long, other long"), "found")

    counts = found.where("other is null").groupBy("point").agg(F.sum("n").alias("n"))
    final = connected_components(found.where("other is not null"), "point", "other")
    named = points.select("digest", "point", "copies").join(counts, "point", "left").join(final.withColumnRenamed("node", "point"), "point", "left").select("digest", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "point").alias("component"))
    every = keyed.select("vec_id", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "vec_id")
    links = F.when(F.col("digest").isNull(), 0).otherwise(F.col("n") + F.col("copies") - 1).cast("long")
    return every.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
