"""Centroid clustering over ball trees.

Vectors are turned to integers and put in metric trees, one for every some
thousand vectors of a partition, and the trees are stored once.  A node has a
centre, a radius, a count, the integer sum of its vectors and that of their
squares.  A round sends the few centroids to all trees: where the triangle
inequality leaves one centroid for a ball, the whole ball counts for it by its
sums, without a look at its vectors; else it descends, with the centroids that
are left, to leaves whose distances are computed exactly.  Trees answer with a
row for each centroid, which Spark adds up; what comes to the driver are k
centroids, however many vectors there are.

All that decides is in integers: bounds on balls carry a margin for rounding
and only ever leave work to the leaves, so the result is that of comparing
every vector with every centroid, and depends on no partition.

Defined cases: vectors of another length than `dims`, null ones, and those with
a null or non-finite component are left out, and so are those with a component
of 2**27 / scale or more, whose distances no long holds; fewer vectors than k
make fewer centroids, and no vector an empty table; equal hashes (equal ids,
null ones too) are put in order by the vector; ids keep their type; repeated
rows count each; a sum of distances that no long holds is null; columns other than id and vector are not looked at.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import kit

TREE, LEAF = 4096, 32  # vectors of a tree and of a leaf, at most
WIDE = 1 << 27  # components of integers are below it, so that a squared distance of 64 of them fits a long
FLAT = 1 << 20  # up to here products of vectors are exact in doubles
PARTS = ("vectors", "bounds", "radius", "sums", "squares")
SLACK = 1e-9  # of distances, for rounding; far above what doubles lose


class Tree:
    """A tree over rows x of integers, level by level; it puts the rows in an order in which every node has a stretch.

    Node j has children 2j + 1 and 2j + 2; nodes of the last level are leaves.
    """

    def __init__(self, x: np.ndarray, bounds: np.ndarray, radius: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        self.x, self.bounds, self.radius, self.sums, self.squares = x, bounds, radius, sums, squares
        self.centre = middle(sums, bounds)

    @staticmethod
    def order(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """(order of the rows, bounds of each node): halves by the median of the widest component."""
        order, bounds, level = np.arange(len(x)), [(0, len(x))], [(0, len(x))]
        while max(hi - lo for lo, hi in level) > leaf:
            below = []
            for lo, hi in level:
                mid = (lo + hi) // 2
                if lo < mid:
                    part = x[order[lo:hi]]
                    by = part[:, np.argmax(part.max(0) - part.min(0))]
                    order[lo:hi] = order[lo:hi][np.argpartition(by, mid - lo)]
                below += [(lo, mid), (mid, hi)]
            level = below
            bounds += level
        return order, np.array(bounds)

    @classmethod
    def over(cls, x: np.ndarray, bounds: np.ndarray) -> "Tree":
        """The tree over rows that are in order."""
        lo, hi = bounds.T
        ends = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0, dtype=np.int64)])
        sums = ends[hi] - ends[lo]
        squared = square(x)
        if np.abs(x).max(initial=0) >= FLAT:
            squared = squared.astype(object)  # their sums may pass 64 bits
        ends = np.concatenate([[0], np.cumsum(squared)])
        squares = ends[hi] - ends[lo]
        radius, centre = np.zeros(len(lo)), middle(sums, bounds)
        for j in range(len(lo)):
            if hi[j] > lo[j]:
                radius[j] = np.sqrt(((x[lo[j] : hi[j]] - centre[j]) ** 2).sum(1).max())
        return cls(x, bounds, radius * (1 + SLACK) + SLACK, sums, squares)

    def stored(self) -> tuple:
        """(vectors, bounds, radius, sums, squares) as a table keeps them."""
        squares = [Decimal(int(v)) for v in self.squares]
        return self.x.astype(np.int32).tobytes(), self.bounds.astype(np.int32).tobytes(), self.radius.tobytes(), self.sums.tobytes(), squares

    @classmethod
    def loaded(cls, batch: pa.RecordBatch, i: int, dims: int) -> "Tree":
        def array(name: str, kind: type, width: int) -> np.ndarray:
            return np.frombuffer(batch.column(name)[i].as_buffer(), kind).reshape(-1, width)

        x, bounds = array("vectors", np.int32, dims), array("bounds", np.int32, 2).astype(np.int64)
        squares = np.array([int(v) for v in batch.column("squares")[i].as_py()], object)
        return cls(x, bounds, array("radius", np.float64, 1)[:, 0], array("sums", np.int64, dims), squares)


def middle(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return sums / np.maximum(1, bounds[:, 1] - bounds[:, 0])[:, None]


def square(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return (x * x).sum(1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors, exactly."""
    if not len(x) or max(np.abs(x).max(), np.abs(centroids).max()) < FLAT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = square(x - c)
    return out


def visit(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes that one centroid owns whole, those centroids, leaves that are open)."""
    whole, owners, leaves = [], [], []
    nodes, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    many = len(tree.bounds)
    c = centroids.astype(np.float64)
    while len(nodes):
        filled = tree.bounds[nodes, 1] > tree.bounds[nodes, 0]
        nodes, left = nodes[filled], left[filled]
        far = np.sqrt(((tree.centre[nodes][:, None, :] - c[None]) ** 2).sum(2))
        r = tree.radius[nodes][:, None]
        # Every vector of a ball is nearer to the owner of the least upper bound than to a centroid beyond it.
        most = np.where(left, far + r, np.inf).min(1, keepdims=True)
        left = left & (far - r <= most * (1 + SLACK) + SLACK)
        one = left.sum(1) == 1
        whole.append(nodes[one])
        owners.append(left[one].argmax(1))
        nodes, left = nodes[~one], left[~one]
        last = 2 * nodes + 1 >= many
        leaves.append(nodes[last])
        nodes, left = nodes[~last], np.repeat(left[~last], 2, axis=0)
        nodes = np.stack([2 * nodes + 1, 2 * nodes + 2], 1).ravel()
    return np.concatenate(whole), np.concatenate(owners), np.concatenate(leaves)


def rows_of(tree: Tree, nodes: np.ndarray) -> np.ndarray:
    lo, hi = tree.bounds[nodes].T
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row of the tree."""
    whole, owners, leaves = visit(tree, centroids)
    cluster, distance = np.empty(len(tree.x), np.int64), np.empty(len(tree.x), np.int64)
    at = rows_of(tree, leaves)
    far = distances(tree.x[at], centroids)
    cluster[at] = far.argmin(1)  # the first of equal ones
    distance[at] = far[np.arange(len(at)), cluster[at]]
    for k in np.unique(owners):
        at = rows_of(tree, whole[owners == k])
        cluster[at], distance[at] = k, distances(tree.x[at], centroids[k : k + 1])[:, 0]
    return cluster, distance


def totals(tree: Tree, centroids: np.ndarray) -> list[tuple[int, int, list[int], int]]:
    """(cluster, vectors, sum of vectors, sum of squares) of each centroid that has some; whole balls by their own sums."""
    whole, owners, leaves = visit(tree, centroids)
    at = rows_of(tree, leaves)
    near = distances(tree.x[at], centroids).argmin(1)
    out = []
    for k in range(len(centroids)):
        mine, x = whole[owners == k], tree.x[at[near == k]]
        n = int((tree.bounds[mine, 1] - tree.bounds[mine, 0]).sum()) + len(x)
        if n:
            sums = tree.sums[mine].sum(0) + x.sum(0, dtype=np.int64)
            squares = sum(tree.squares[mine].tolist()) + sum(square(x).tolist())
            out.append((k, n, sums.tolist(), squares))
    return out


def whole_numbers(vector: Column, dims: int, scale: int) -> Column:
    """The vector as floor(scale * component), or null where it is left out."""
    good = F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < WIDE, F.lit(False))), F.lit(False))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _trees(numbered: DataFrame, dims: int, ddl: str, arrow: pa.DataType) -> DataFrame:
    """Rows (ids, vectors, bounds, radius, sums, squares): a tree each, built in the partition that the vectors are in."""
    kinds = [pa.list_(arrow), *[pa.binary()] * 4, pa.list_(pa.decimal128(38, 0))]
    schema = pa.schema(list(zip(("ids", *PARTS), kinds)))

    def tree(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order, bounds = Tree.order(x)
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        made = Tree.over(x[order], bounds).stored()
        return pa.RecordBatch.from_arrays([ids, *(pa.array([v], k) for v, k in zip(made, kinds[1:]))], schema=schema)

    def run(batches):
        ids, held, n = [], [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, TREE - n)
                batch = batch.slice(part.num_rows)
                ids.append(part.column("vec_id"))
                held.append(part.column("__x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims))
                n += part.num_rows
                if n == TREE:
                    yield tree(pa.concat_arrays(ids), np.concatenate(held))
                    ids, held, n = [], [], 0
        if n:
            yield tree(pa.concat_arrays(ids), np.concatenate(held))

    return numbered.mapInArrow(kit.trimmed(run), f"ids array<{ddl}>, vectors binary, bounds binary, radius binary, sums binary, squares array<decimal(38,0)>")


def _summed(trees: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int], int]]:
    """Of each cluster: vectors, their sum, the sum of their squares; at most k rows come to the driver."""
    c = np.array(centroids, np.int64)

    def run(batches):
        n, sums, squares = [0] * len(c), [[0] * dims for _ in c], [0] * len(c)
        for batch in batches:
            for i in range(batch.num_rows):
                for k, m, s, q in totals(Tree.loaded(batch, i, dims), c):
                    n[k], squares[k] = n[k] + m, squares[k] + q
                    sums[k] = [a + b for a, b in zip(sums[k], s)]
        got = [k for k in range(len(c)) if n[k]]
        whole = pa.decimal128(38, 0)
        cols = [pa.array(got, pa.int32()), pa.array([n[k] for k in got], pa.int64()), pa.array([[Decimal(v) for v in sums[k]] for k in got], pa.list_(whole)), pa.array([Decimal(squares[k]) for k in got], whole)]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "n", "sums", "squares"])

    parts = trees.select(*PARTS).mapInArrow(kit.trimmed(run), "cluster int, n long, sums array<decimal(38,0)>, squares decimal(38,0)")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), *added).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dims)], int(r["squares"])) for r in rows}


def first_centroids(numbered: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k smallest hashes of seed and id; Spark keeps k rows a partition."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["__x"]) for r in numbered.select(key.alias("__key"), "__x").orderBy("__key", "__x").limit(k).collect()]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def fit(table: DataFrame, vector: str = "embedding", key: str = "vec_id", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(stored trees over the vectors that are kept, centroids after all rounds)."""
    ddl, arrow = kit.id_types(table, key)
    x = whole_numbers(table[f"`{vector}`"], dims, scale)
    numbered = table.select(table[f"`{key}`"].alias("vec_id"), x.alias("__x")).where(F.col("__x").isNotNull())
    trees = kit.stored(_trees(numbered, dims, ddl, arrow))
    centroids = first_centroids(numbered, k, seed)
    for _ in range(rounds if centroids else 0):
        for i, (n, sums, _) in _summed(trees, centroids, dims).items():
            centroids[i] = [s // n for s in sums]
    return trees, centroids


def cluster(table: DataFrame, vector: str = "embedding", key: str = "vec_id", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """A row for each vector kept: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (integers), centroid_sha256."""
    ddl, arrow = kit.id_types(table, key)
    trees, centroids = fit(table, vector, key, dims, scale, k, rounds, seed)
    c = np.array(centroids, np.int64).reshape(-1, dims)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own, far = assigned(Tree.loaded(batch, i, dims), c)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(own.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    # The distances of a cluster add up to squares - 2 c s + n c c, so they need no pass over its vectors' distances.
    inertia = {}
    for i, (n, sums, squares) in (_summed(trees, centroids, dims) if centroids else {}).items():
        inertia[i] = squares - 2 * sum(a * b for a, b in zip(centroids[i], sums)) + n * sum(a * a for a in centroids[i])
    all_of = sum(inertia.values())
    held = {i: v if v < 1 << 63 else None for i, v in {**inertia, None: all_of}.items()}
    found = trees.mapInArrow(kit.trimmed(run), f"vec_id {ddl}, cluster int, distance long")
    said = [(i, held.get(i, 0), held[None], centroid, digest(centroid)) for i, centroid in enumerate(centroids)]
    about = table.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid array<int>, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
