"""Near-duplicate embeddings by dual traversal of cover trees: all pairs with a cosine of at least ``COSINE``.

On unit vectors a cosine is a distance, so the triangle inequality holds. A cover tree has nested
levels with halving radii: the nodes of a level cover their members within its radius, and each
node's children are a net of half that radius among its members. Two nodes whose centres are further
apart than the threshold plus both covering radii hold no pair and are pruned; two that are nearer
than the threshold minus both radii hold nothing but pairs and are counted without looking inside;
the rest are opened. Links are decided on double precision cosines.

1. Equal vectors become one node with a weight. Equality rests on two 64-bit hashes together, so vectors are
   exchanged once to find one of each class and once to form blocks; all else carries hashes.
2. The upper levels come from at most ``SAMPLE`` vectors: the finest level that has no more centres
   than there are blocks. Vectors go to their nearest centre's cell; cells are cut into blocks of
   about ``BLOCK`` vectors, each with its own centre and covering radius.
3. Pairs of cells, then of blocks, are pruned by these radii. Pairs of tight blocks are settled from
   centre, radius and count alone, so a cell of a third of all rows in near copies costs no
   comparisons. The others meet two by two in a task, where both blocks' lower levels are traversed:
   pairs of rows of the stored blocks, read where they lie, so no block is exchanged once per pair.
   A block's top nodes are made once and stored with it; their centres are screened in tiles, by the components
   in which a sample varies most and the length of the rest, which together are never below the cosine.
4. A task returns how many links each vector got, and a forest that connects linked vectors, never
   the pairs. Components come from the forests.

See ``vectors.comparable`` for rows that link with nothing; they are kept with n_links 0 and themselves
as component. Rows with equal vec_id are one vector if equal; a null vec_id has a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import components
from panelspark.llm.vectors import comparable, first_by_hash, matrix, number, places, stored
from panelspark.storage import cut_lineage, discard

COSINE, SAMPLE, CELLS, BLOCK = 0.9, 4096, 1024, 8192
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
SLACK = 1e-6
#: Node pairs with at most so many member pairs are compared member by member.
FEW = 64
#: Two hashes of a vector that together name its class.
KEYS = ["_k0", "_k1"]
#: Centres against centres whose cosines are held at once, in a core's own cache.
TALL, WIDE = 512, 512
#: Above this share of a tile its cosines are made from all components at once.
DENSE = 1 / 128


def reach(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of a net (the first row is one) and each row's centre, within ``radius`` in single precision."""
    small, least = x.astype(np.float32), np.float32(1 - radius * radius / 2)
    centres, taken, n = np.empty(len(x), np.int64), np.empty_like(small), 0
    owner = np.full(len(x), -1)
    for a in range(0, len(x), 512):
        part = np.arange(a, min(a + 512, len(x)))
        if n:
            cosine = small[part] @ taken[:n].T
            near = cosine.argmax(axis=1)
            ok = cosine[np.arange(len(part)), near] >= least
            owner[part[ok]] = near[ok]
            part = part[~ok]
        close = small[part] @ small[part].T >= least
        for i in range(len(part)):
            if owner[part[i]] < 0:
                free = (owner[part] < 0) & close[i]
                free[i] = True
                owner[part[free]] = n
                centres[n], taken[n] = part[i], small[part[i]]
                n += 1
    return centres[:n], owner


class Node:
    """Members (centre first), covering radius and level."""

    __slots__ = ("members", "radius", "level", "kids")

    def __init__(self, members, radius, level):
        self.members, self.radius, self.level, self.kids = members, radius, level, None

    def children(self, x) -> list[Node]:
        if self.kids is None:  # levels that would hold the same node again are skipped
            finer = next((k for k in range(self.level + 1, len(RADII)) if RADII[k] < self.radius), None)
            self.kids = [Node(self.members[i : i + 1], 0.0, self.level) for i in range(len(self.members))] if finer is None else nodes(x, self.members, finer)
        return self.kids

    def opened(self, x, most: float) -> list[Node]:
        """The highest nodes below this one, or itself, with a radius of at most ``most``."""
        return [self] if self.radius <= most else [n for kid in self.children(x) for n in kid.opened(x, most)]


def nodes(x: np.ndarray, members: np.ndarray, level: int) -> list[Node]:
    centres, owner = net(x[members], RADII[level])
    order = np.argsort(owner, kind="stable")
    out = []
    for centre, part in zip(centres, np.split(order, np.searchsorted(owner[order], np.arange(1, len(centres)))), strict=True):
        part = np.concatenate([[centre], part[part != centre]])
        radius = float(apart(x[members[part[:1]]], x[members[part]]).max()) if len(part) > 1 else 0.0
        out.append(Node(members[part], radius, level))
    return out


def tops(x: np.ndarray, cosine: float) -> list[Node]:
    """The top nodes of a block, opened until all pairs inside one are linked. Wide nodes of few members prune nothing."""
    most = max(0.0, (reach(cosine) - SLACK) / 2)
    return [t for node in nodes(x, np.arange(len(x)), 0) for t in node.opened(x, most)]


class Level:
    """Nodes as arrays: radii, centres, lengths, their members end to end and where each node's start. ``nodes``: if made already."""

    def __init__(self, radii, lengths, flat, nodes=None):
        self.radii, self.lengths, self.flat = np.asarray(radii, np.float32), lengths, flat
        self.starts = np.append(0, np.cumsum(lengths))
        self.centres, self.nodes, self.exact = flat[self.starts[:-1]], nodes or {}, radii

    @classmethod
    def of(cls, nodes: list[Node]) -> Level:
        return cls([n.radius for n in nodes], np.array([len(n.members) for n in nodes]), np.concatenate([n.members for n in nodes]), dict(enumerate(nodes)))

    def node(self, i: int) -> Node:
        if i not in self.nodes:
            self.nodes[i] = Node(self.flat[self.starts[i] : self.starts[i + 1]], float(self.exact[i]), 0)
        return self.nodes[i]


class Front:
    """A rotation of vectors after which ``size`` components hold most; the rest enter as their length alone.

    By Cauchy and Schwarz the front's product plus both rests' lengths is at least the cosine."""

    def __init__(self, sample: np.ndarray, cosine: float):
        self.turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
        dim, some = sample.shape[1], sample[:: max(1, len(sample) // 1024)].astype(np.float32)
        linked = float((some @ some.T >= cosine - 0.01).mean())
        costs = {dim: 0.2 + 0.012 * dim}  # nanoseconds of a pair, and of one that passes in vain; measured on one core
        for self.size in range(8, dim, 8):
            front = self.of(self.turned(some))
            costs[self.size] = 0.2 + 0.012 * (self.size + 1) + 60 * (float((front @ front.T >= cosine - 0.01).mean()) - linked)
        self.size = min(costs, key=costs.get)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x @ self.turn, np.float32)

    def of(self, small: np.ndarray) -> np.ndarray:
        rest = np.sqrt((small[:, self.size :] ** 2).sum(axis=1, keepdims=True))
        return np.concatenate([small[:, : self.size], rest], axis=1)


def tiles_of(radii: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Starts and lengths of runs of sorted radii; single vectors, whose radius is zero, apart from the rest."""
    single = int(np.searchsorted(radii, 0, side="right"))
    return [(a, min(size, end - a)) for start, end in ((0, single), (single, len(radii))) for a in range(start, end, size)]


class Forest:
    """Union-find over the vectors of a task."""

    def __init__(self, n):
        self.parent = np.arange(n)

    def find(self, i):
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, group):
        roots = {self.find(i) for i in group}
        low = min(roots)
        for r in roots:
            self.parent[r] = low


class Dual:
    """Traversal over one or two blocks whose vectors are rows of ``x``."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float, front: Front | None = None):
        self.x, self.small, self.weight, self.cosine, self.reach = x, front.turned(x) if front else x.astype(np.float32), weight, cosine, reach(cosine)
        self.links, self.forest = np.zeros(len(x), np.int64), Forest(len(x))
        self.front = front.of(self.small) if front and front.size < x.shape[1] else None
        self.held, self.over = np.empty(TALL * WIDE, np.float32), np.empty(TALL * WIDE, bool)

    def all_linked(self, a, b):
        self.links[a] += self.weight[b].sum()
        self.links[b] += self.weight[a].sum()
        self.forest.link(np.concatenate([a, b]).tolist())

    def all_inside(self, a):
        self.links[a] += self.weight[a].sum() - self.weight[a]
        self.forest.link(a.tolist())

    def exact(self, i, j):
        """Single vectors, pair by pair."""
        ok = [np.zeros(0, bool)]
        for a in range(0, len(i), 1 << 15):
            ok.append((self.x[i[a : a + (1 << 15)]] * self.x[j[a : a + (1 << 15)]]).sum(axis=1) >= self.cosine)
        ok = np.concatenate(ok)
        i, j = i[ok], j[ok]
        np.add.at(self.links, i, self.weight[j])
        np.add.at(self.links, j, self.weight[i])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            self.forest.link((a, b))

    def inside(self, node: Node):
        """Pairs among the members of one node."""
        if len(node.members) < 2:
            return
        if 2 * node.radius <= self.reach - SLACK:
            self.all_inside(node.members)
            return
        kids = node.children(self.x)
        for kid in kids:
            self.inside(kid)
        self.cross(kids, kids)

    def cross(self, left, right):
        """Pairs between two levels or lists of nodes, or between different nodes of one."""
        same = left is right
        left = left if isinstance(left, Level) else Level.of(left)
        right = left if same else right if isinstance(right, Level) else Level.of(right)
        by_l, by_r = np.argsort(left.radii, kind="stable"), np.argsort(right.radii, kind="stable")  # a tile's radii are alike
        rl, rr, cl, cr = left.radii[by_l], right.radii[by_r], left.centres[by_l], right.centres[by_r]
        full = self.small[cl], self.small[cr]
        front = None if self.front is None else (self.front[cl], self.front[cr])
        tiles = dense = 0
        for a, m in tiles_of(rl, TALL):
            for b, n in tiles_of(rr, WIDE):
                if same and b + n <= a + 1:
                    continue
                bound = self.least(rl[a + m - 1] + rr[b + n - 1])
                used = front if front and dense <= 8 + tiles // 2 else full
                hit = self.screened(*used, a, b, m, n, bound)
                if used is front and len(hit) > DENSE * m * n:
                    dense, used = dense + 1, full
                    hit = self.screened(*used, a, b, m, n, bound)
                tiles += 1
                if not len(hit):
                    continue
                i, j = a + hit // n, b + hit % n
                near = self.held[hit] if used is full else np.einsum("ij,ij->i", full[0][i], full[1][j])
                ok = near >= self.least(rl[i] + rr[j])
                if same:
                    ok &= i < j
                i, j = by_l[i[ok]], by_r[j[ok]]
                few = left.lengths[i] * right.lengths[j] <= FEW
                self.products(left.flat, left.starts, right.flat, right.starts, i[few], j[few])
                for u, v in zip(i[~few].tolist(), j[~few].tolist(), strict=True):
                    self.pair(left.node(u), right.node(v))

    def screened(self, left, right, a, b, m, n, bound):
        """Which products of ``m`` and ``n`` rows from ``a`` and ``b`` on reach the bound; all are made in the same memory each time."""
        np.matmul(left[a : a + m], right[b : b + n].T, out=self.held[: m * n].reshape(m, n))
        return places(np.greater_equal(self.held[: m * n], bound, out=self.over[: m * n]))

    def least(self, radii):
        """The cosine below which centres with these radii together hold no pair, with room for single precision."""
        return 1 - np.minimum(self.reach + 1e-3 + radii, 2.01) ** 2 / 2

    def products(self, flat_l, off_l, flat_r, off_r, i, j):
        """All member pairs of small node pairs, a bounded number at a time."""
        for a in range(0, len(i), 1 << 14):
            p, q = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            wide = off_r[q + 1] - off_r[q]
            size = (off_l[p + 1] - off_l[p]) * wide
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat(wide, size)
            self.exact(flat_l[np.repeat(off_l[p], size) + nth // width], flat_r[np.repeat(off_r[q], size) + nth % width])

    def pair(self, a: Node, b: Node):
        d = float(apart(self.x[a.members[:1]], self.x[b.members[:1]])[0, 0])
        if d > self.reach + a.radius + b.radius + SLACK:
            return
        if d + a.radius + b.radius <= self.reach - SLACK:
            self.all_linked(a.members, b.members)
        elif len(a.members) * len(b.members) <= FEW:
            self.exact(np.repeat(a.members, len(b.members)), np.tile(b.members, len(a.members)))
        elif a.radius >= b.radius:
            self.cross(a.children(self.x), [b])
        else:
            self.cross([a], b.children(self.x))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def blocks_of(rows: DataFrame, total: int, cosine: float) -> tuple[DataFrame, Front]:
    """A front for the screen of centres, and one row per block: place, block (its first vec_id), cell, count, centre, radius; its ids, weights and vectors in the
    order of its top nodes, whose sizes and radii are in ``sizes`` and ``radii``."""
    points = unit(matrix(first_by_hash(rows, SAMPLE).select("embedding").toArrow().column("embedding")))
    most = max(1, min(CELLS, total // BLOCK))
    centres = points[:1]
    for radius in RADII:
        level = net(points, radius)[0]
        if len(level) > most:
            break
        centres = points[level]

    def cells(batch):
        return (unit(matrix(batch.column("embedding"))) @ centres.T).argmax(axis=1)

    def counted(batches):
        n = np.zeros(len(centres), np.int64)
        for batch in batches:
            n += np.bincount(cells(batch), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["cell", "n"])

    parts = np.ones(len(centres), np.int64)  # at most CELLS rows
    for r in rows.select("embedding").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        parts[r["cell"]] = max(1, -(-r["n"] // BLOCK))

    def located(batches):
        for batch in batches:
            cell = cells(batch)
            yield batch.append_column("cell", pa.array(cell)).append_column("parts", pa.array(parts[cell]))

    def gathered(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        rough = stored(group.column("embedding"))
        x = unit(rough.astype(np.float64, copy=False))
        ids, weight = group.column("vec_id").to_numpy(), group.column("weight").to_numpy()
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        top = tops(x, cosine)
        order = np.concatenate([t.members for t in top])
        raw = {"ids": ids[order], "weights": weight[order], "x": rough[order], "sizes": np.array([len(t.members) for t in top]), "radii": np.array([t.radius for t in top])}
        cell = group.column("cell")[0].as_py()
        return pa.table({"place": [(cell << 32) + group.column("part")[0].as_py()], "block": [int(ids[0])], "cell": [cell], "n": [int(weight.sum())],
                         "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius],
                         **{c: pa.array([v.tobytes()], pa.binary()) for c, v in raw.items()}})

    dealt = rows.mapInArrow(located, f"vec_id long, embedding {dict(rows.dtypes)['embedding']}, weight long, cell long, parts long")
    made = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts").groupBy("cell", "part").applyInArrow(
        gathered, "place long, block long, cell long, n long, centre array<double>, radius double, ids binary, weights binary, x binary, sizes binary, radii binary")
    return cut_lineage(made, "blocks"), Front(points, cosine)


def distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def near_cells(blocks: DataFrame, cosine: float) -> DataFrame:
    """cell and, in ``cells``, those whose blocks' radii do not rule out a pair with one of its blocks; at most CELLS rows."""
    cell = blocks.groupBy("cell").agg(F.min(F.struct("block", "centre", "radius")).alias("_b"), F.collect_list(F.struct("centre", "radius")).alias("_all"))
    cell = cell.select("cell", F.col("_b.centre").alias("centre"), F.array_max(F.transform(
        "_all", lambda p: p["radius"] + distance(F.col("_b.centre"), p["centre"]))).alias("radius"))
    name, centre, radius = zip(*((r["cell"], r["centre"], r["radius"]) for r in cell.collect()), strict=True)  # at most CELLS rows
    name, centre, radius = np.array(name), np.array(centre), np.array(radius)
    near = [name[np.sqrt(((centre - c) ** 2).sum(axis=1)) <= reach(cosine) + r + radius + SLACK].tolist() for c, r in zip(centre, radius, strict=True)]
    return blocks.sparkSession.createDataFrame(list(zip(name.tolist(), near, strict=True)), "cell long, cells array<long>")


def side(blocks: DataFrame, s: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns])


def not_ruled_out(cosine: float):
    """Whether blocks a and b, a at most b, can hold a link: first by their cells, then by their own radii."""
    d = distance("centre_a", "centre_b")
    return (F.col("place_a") <= F.col("place_b")) & F.array_contains("cells_a", F.col("cell_b")) & (d <= reach(cosine) + F.col("radius_a") + F.col("radius_b") + SLACK)


def surely_linked(cosine: float):
    """Whether all vectors of blocks a and b are linked, by their radii alone."""
    d, tight = distance("centre_a", "centre_b"), F.lit(reach(cosine) - SLACK)
    return (d + F.col("radius_a") + F.col("radius_b") <= tight) & (2 * F.col("radius_a") <= tight) & (2 * F.col("radius_b") <= tight)


def compared(sides: list, cosine: float = COSINE, front: Front | None = None) -> pa.RecordBatch:
    """For a block, or two: vec_id, links found there, and a linked vec_id (itself, if root).

    A side has ids, weights, vectors, and the sizes and radii of its top nodes."""
    ids, weight, x = (np.concatenate([s[i] for s in sides]) for i in range(3))
    dual, tops, first = Dual(unit(x.astype(np.float64, copy=False)), weight, cosine, front), [], 0
    for *_, sizes, radii in sides:
        tops.append(Level(radii, sizes, np.arange(first, first + sizes.sum())))
        first += int(sizes.sum())
    if len(tops) == 1:
        for i in np.flatnonzero(tops[0].lengths > 1).tolist():
            dual.inside(tops[0].node(i))
    dual.cross(tops[0], tops[-1])
    hit = np.flatnonzero(dual.links)
    root = np.array([dual.forest.find(i) for i in hit], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(dual.links[hit]), pa.array(ids[root])], names=["vec_id", "links", "near"])


def side_of(batch: pa.RecordBatch, row: int, s: str, dtype) -> tuple:
    ids, weight, x, sizes, radii = (np.frombuffer(batch.column(f"{c}_{s}")[row].as_buffer(), t) for c, t in (
        ("ids", np.int64), ("weights", np.int64), ("x", dtype), ("sizes", np.int64), ("radii", np.float64)))
    return ids, weight, x.reshape(len(ids), -1), sizes, radii


def linked(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = comparable(df).withColumns({k: F.xxhash64(F.lit(i), "embedding") for i, k in enumerate(KEYS)})
    keyed = cut_lineage(rows.select("vec_id", *KEYS).distinct(), "vectors")
    same = cut_lineage(keyed.groupBy(*KEYS).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    total = same.count()
    everyone = df.select(F.col("vec_id").cast("long").alias("vec_id")).distinct() if total == 0 else None
    if total == 0:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    one = rows.groupBy(*KEYS).agg(F.min(F.struct("vec_id", "embedding")).alias("one")).join(same, KEYS)
    points = cut_lineage(one.select(F.col("rep").alias("vec_id"), "one.embedding", "weight"), "points")
    blocks, front = blocks_of(points, total, cosine)
    dtype = number(dict(points.dtypes)["embedding"])
    discard(points)

    n_blocks = blocks.count()
    narrow = cut_lineage(blocks.select("place", "block", "cell", "n", "centre", "radius").repartition(1 + n_blocks // 256), "radii")
    near = near_cells(narrow, cosine)
    sure = side(narrow.join(near, "cell"), "a").join(side(narrow, "b").hint("shuffle_replicate_nl"), not_ruled_out(cosine) & surely_linked(cosine))
    sure = cut_lineage(sure.select("place_a", "place_b", "block_a", "block_b", "n_a", "n_b"), "sure")
    gained = sure.select(F.col("place_a").alias("place"), F.col("n_b").alias("more")).union(
        sure.filter("place_a < place_b").select(F.col("place_b").alias("place"), F.col("n_a").alias("more"))).groupBy("place").agg(F.sum("more").alias("more"))

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, weight = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(row["more"] - weight), pa.array(np.full(len(ids), row["block"]))],
                                                 names=["vec_id", "links", "near"])

    out = "vec_id long, links long, near long"
    tight = blocks.join(gained, "place").select("block", "ids", "weights", "more").mapInArrow(spread, out)

    def meet(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                names = "a" if batch.column("place_a")[row] == batch.column("place_b")[row] else "ab"
                yield compared([side_of(batch, row, s, dtype) for s in names], cosine, front)
            del batch  # before the next one is read

    cores = df.sparkSession.sparkContext.defaultParallelism
    left = side(blocks.drop("block", "n").join(F.broadcast(near), "cell").repartition(max(1, min(n_blocks, 2 * cores))), "a")
    met = left.join(side(blocks.drop("block", "n"), "b").hint("shuffle_replicate_nl"), not_ruled_out(cosine) & ~surely_linked(cosine))
    met = met.select(*[f"{c}_{s}" for s in "ab" for c in ("place", "ids", "weights", "x", "sizes", "radii")]).mapInArrow(meet, out)
    found = cut_lineage(tight.unionByName(met), "links")

    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    edges = found.filter("near <> vec_id").select(F.col("vec_id").alias("a"), F.col("near").alias("b")).union(
        sure.filter("place_a < place_b").select(F.col("block_a").alias("a"), F.col("block_b").alias("b"))).distinct()
    roots = components(edges).withColumnRenamed("node", "rep")
    reps = same.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(roots, "rep", "left").select(
        *KEYS, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    valid = keyed.join(reps, KEYS).select("vec_id", "n_links", "component_id")
    return df.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().join(valid, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.l > 0 AND b.l > 0
  AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN k USING (vec_id)
"""
