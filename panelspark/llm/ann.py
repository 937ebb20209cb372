"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver on at most ``SAMPLE`` vectors, the first by a hash of their id. Every
vector descends to the nearest child at each level, so every row is indexed in one leaf. A query keeps
a priority queue of nodes by the inner product with their centre; popping the best node opens it or,
at a leaf, visits it. How many leaves are visited is calibrated: for ``PROBES`` queries (a bounded
sample) the exact neighbours among all rows are found, and visits are widened until these queries
reach ``RECALL``.

Neighbouring leaves form blocks of about ``CHUNK`` vectors (smaller ones where that keeps all cores busy), so
neither a leaf that holds a third of all vectors nor one that all queries visit goes to one task. Queries form
teams of about ``CHUNK``, by the leaf they lie in themselves. A block is one row, and so is a team: blocks and
teams with a visited leaf in common meet as pairs of rows, read from where they are stored, so no vector is
exchanged once per team. Inside such a pair a query only meets the leaves that it visits.

The inner products of a pair are screened in single precision against the score that a query's ``k``-th best has
at least, less what rounding can do. That bound starts with the sample's vectors in the visited leaves and rises
with what a task has found. What passes is scored by sums of products in double precision, in the same order for
equal vectors; ties go to the smaller vec_id. Of equal vectors in a block only the ``k`` + 1 smallest ids can be
among the best; the others are left out there. A task keeps the best ``k`` per query; the best of these are the result.

See ``vectors.usable`` for rows that take no part. Repeated rows count once; a query never finds its
own id. Fewer candidates than ``k`` give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.vectors import first_by_hash, matrix, number, places, stored, usable
from panelspark.storage import cut_lineage, discard

SAMPLE, BRANCH, LEAF, PROBES, RECALL, CHUNK = 20_000, 12, 64, 256, 0.97, 16_384
#: Blocks are not cut smaller than this for the sake of more tasks.
LEAST_CHUNK = 1024
#: Vectors of a leaf by queries that are screened at once, in a core's own cache; pairs that are scored, or wait for a ranking.
TALL, WIDE, SCORED, WAITING = 256, 1024, 1 << 12, 1 << 18


class Tree:
    """Nodes in one array: centre, first child and number of children (0 at a leaf), leaf number."""

    def __init__(self, sample: np.ndarray):
        self.centres, self.first, self.size, self.leaf = [sample.mean(axis=0)], [0], [0], [-1]
        self.leaves, open_ = 0, [(0, sample)]
        rng = np.random.default_rng(0)
        while open_:
            node, points = open_.pop()
            parts = self.split(points, rng) if len(points) > LEAF else None
            if parts is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            centres, label = parts
            self.first[node], self.size[node] = len(self.centres), len(centres)
            for c in range(len(centres)):
                open_.append((len(self.centres), points[label == c]))
                self.centres.append(centres[c])
                for column, value in ((self.first, 0), (self.size, 0), (self.leaf, -1)):
                    column.append(value)
        self.centres = np.array(self.centres)

    @staticmethod
    def split(points, rng, rounds=8):
        centres = points[rng.choice(len(points), min(BRANCH, len(points)), replace=False)]
        for _ in range(rounds):
            label = nearest(points, centres)
            centres = np.array([points[label == c].mean(axis=0) for c in np.unique(label)])
        label = nearest(points, centres)
        used = np.unique(label)
        return (centres[used], np.searchsorted(used, label)) if len(used) > 1 else None

    def descend(self, points: np.ndarray) -> np.ndarray:
        """Leaf number of every point."""
        node = np.zeros(len(points), np.int64)
        first, size, leaf = np.array(self.first), np.array(self.size), np.array(self.leaf)
        while True:
            inner = np.unique(node[size[node] > 0])
            if not len(inner):
                return leaf[node]
            for x in inner:
                own = np.flatnonzero(node == x)
                node[own] = first[x] + nearest(points[own], self.centres[first[x] : first[x] + size[x]])

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order, ``most`` at most."""
        far = (-(self.centres @ query)).tolist()
        queue, out = [(far[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.size[node]:
                out.append(self.leaf[node])
            for child in range(self.first[node], self.first[node] + self.size[node]):
                heapq.heappush(queue, (far[child], child))
        return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


class Block:
    """Vectors in the order of their leaves, and what screening them needs."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: np.ndarray):
        self.vectors, self.ids, self.leaf = np.require(vectors, requirements="A"), ids, leaf
        self.scale = float(np.abs(vectors).max())
        self.small = (vectors / self.scale).astype(np.float32)
        self.length = float(np.sqrt((self.small.astype(np.float64) ** 2).sum(axis=1).max()))
        starts = np.flatnonzero(np.diff(leaf, prepend=-1))
        self.parts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True))


class Best:
    """The ``k`` best other vectors of every query so far: query index, vec_id, score and leaf."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int):
        self.queries, self.ids, self.least, self.k = queries, ids, least.astype(np.float64), k
        self.scale = np.abs(queries).max(axis=1).astype(np.float64)
        self.small = (queries / self.scale[:, None]).astype(np.float32)
        length = np.sqrt((self.small.astype(np.float64) ** 2).sum(axis=1))
        self.room = (queries.shape[1] + 8) * 2.0**-23 * length  # rounding of a product of single precision, twice over
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.new, self.waiting, self.passed, self.passing = [], 0, [], 0
        self.held, self.over = np.empty(TALL * WIDE, np.float32), np.empty(TALL * WIDE, bool)  # all products are made in the same memory
        self.few, self.bound = np.empty((WIDE, queries.shape[1]), np.float32), None
        self.both = [np.empty((SCORED, queries.shape[1]), t) for t in (queries.dtype, queries.dtype, np.float64)]

    def meet(self, block: Block, visitors) -> None:
        """``visitors`` gives the indices of the queries that visit a leaf."""
        self.aim(block)
        for a, b in block.parts:
            who = visitors(int(block.leaf[a]))
            for i in range(0, len(who), WIDE):
                self.screen(block, a, b, who[i : i + WIDE])
        self.settle(block)

    def aim(self, block: Block) -> None:
        """The least product of a query with a vector of this block, both as they are screened."""
        with np.errstate(all="ignore"):
            bound = self.least / (self.scale * block.scale) - self.room * block.length
        self.bound = np.where(np.isnan(bound), -np.inf, bound).astype(np.float32)

    def screen(self, block: Block, start: int, end: int, who: np.ndarray) -> None:
        """Queries against the vectors of one leaf."""
        m = len(who)
        few = self.small.take(who, axis=0, out=self.few[:m], mode="clip").T
        for a in range(start, end, TALL):
            part = block.small[a : min(a + TALL, end)]
            product, over = (x[: len(part) * m].reshape(len(part), m) for x in (self.held, self.over))
            np.matmul(part, few, out=product)
            bound = self.bound[who]  # rises with what is found
            hit = places(np.greater_equal(product, bound, out=over).ravel())
            if len(hit):
                at, query = np.divmod(hit, m)
                self.passed.append((at + a, who[query]))
                self.passing += len(hit)
            if self.passing >= SCORED:
                self.settle(block)

    def settle(self, block: Block) -> None:
        """Score what passed the screen."""
        if self.passed:
            at, query = (np.concatenate(x) for x in zip(*self.passed, strict=True))
            self.passed, self.passing = [], 0
            for i in range(0, len(at), SCORED):
                self.score(block, at[i : i + SCORED], query[i : i + SCORED])

    def score(self, block: Block, at: np.ndarray, query: np.ndarray) -> None:
        other = block.ids[at] != self.ids[query]
        query, at = query[other], at[other]
        x, q, product = (b[: len(at)] for b in self.both)
        np.multiply(block.vectors.take(at, axis=0, out=x, mode="clip"), self.queries.take(query, axis=0, out=q, mode="clip"), out=product, dtype=np.float64)
        score = product.sum(axis=1)
        good = score >= self.least[query]
        query, at = query[good], at[good]
        self.new.append((query, block.ids[at], score[good], block.leaf[at]))
        self.waiting += len(query)
        if self.waiting >= max(WAITING, len(self.kept[0])):
            self.rank()
            self.aim(block)

    def rank(self) -> None:
        query, found, score, leaf = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        good = score >= self.least[query]
        query, found, score, leaf = query[good], found[good], score[good], leaf[good]
        order = np.lexsort((found, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        order, query = order[place < self.k], query[place < self.k]
        self.kept, self.new, self.waiting = (query, found[order], score[order], leaf[order]), [], 0
        full = np.flatnonzero(last[: len(place)][place < self.k])
        self.least[query[full]] = self.kept[2][full]

    def batch(self) -> pa.RecordBatch:
        self.rank()
        query, found, score, leaf = self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(found), pa.array(score), pa.array(leaf)], names=["query_id", "vec_id", "score", "leaf"])


FOUND = "query_id long, vec_id long, score double, leaf long"


def ranked(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def binary(batch: pa.RecordBatch, column: str, row: int, dtype) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), dtype)


def block_of(batch: pa.RecordBatch, row: int, dtype) -> Block:
    ids = binary(batch, "ids", row, np.int64)
    return Block(binary(batch, "vectors", row, dtype).reshape(len(ids), -1), ids, binary(batch, "leaf", row, np.int64))


def calibrated(tree: Tree, blocks: DataFrame, queries: DataFrame, dtype, k: int) -> int:
    """Leaves to visit so that probe queries reach ``RECALL``."""
    probes = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).toArrow()
    if not len(probes):
        return 1
    probe_ids, probe_vectors = probes.column("vec_id").to_numpy(), stored(probes.column("embedding"))

    def scan(batches):
        best, everyone = Best(probe_vectors, probe_ids, np.full(len(probe_ids), -np.inf), k), np.arange(len(probe_ids))
        for batch in batches:
            for row in range(batch.num_rows):
                best.meet(block_of(batch, row, dtype), lambda leaf: everyone)
        yield best.batch()

    true = ranked(blocks.select("ids", "leaf", "vectors").mapInArrow(scan, FOUND), k).select("query_id", "leaf").collect()
    place = {int(q): {leaf: i for i, leaf in enumerate(tree.visits(v, tree.leaves))} for q, v in zip(probe_ids, matrix(probes.column("embedding")), strict=True)}
    needed = np.sort([place[r["query_id"]][r["leaf"]] + 1 for r in true])
    visits = 1
    while visits < tree.leaves and np.searchsorted(needed, visits, side="right") < RECALL * len(needed):
        visits += max(1, visits // 16)
    return min(visits, tree.leaves)


def dealt(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For leaves with so many rows each: the first of the groups of about ``size`` rows that a leaf's rows go to, and their number."""
    end = np.cumsum(count)
    first = (end - count) // size
    return first, np.maximum(1, (end - 1) // size - first + 1)


def search(df: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for rows where ``is_query`` holds, among all others."""
    vectors = cut_lineage(usable(df), "vectors")
    sample = first_by_hash(vectors, SAMPLE).toArrow()
    if not len(sample):
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).filter("false")
    sample_ids, sample_vectors = sample.column("vec_id").to_numpy(), matrix(sample.column("embedding"))
    tree = Tree(sample_vectors)
    kind = dict(vectors.dtypes)["embedding"]
    dtype, cores = number(kind), vectors.sparkSession.sparkContext.defaultParallelism
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    rows = vectors.withColumn("asks", F.coalesce(is_query.cast("boolean"), F.lit(False)))

    def counted(batches):
        n, asking = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
        for batch in batches:
            leaf = tree.descend(matrix(batch.column("embedding")))
            n += np.bincount(leaf, minlength=tree.leaves)
            asking += np.bincount(leaf[batch.column("asks").to_numpy(zero_copy_only=False)], minlength=tree.leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tree.leaves)), pa.array(n), pa.array(asking)], names=["leaf", "n", "asking"])

    counts = np.zeros((2, tree.leaves), np.int64)  # per leaf, of which there are at most SAMPLE
    for r in rows.mapInArrow(counted, "leaf long, n long, asking long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("asking").alias("asking")).collect():
        counts[:, r["leaf"]] = r["n"], r["asking"]
    size = min(CHUNK, max(min(LEAST_CHUNK, CHUNK), int(counts[0].sum()) // (4 * cores)))
    (first, parts), (team, teams) = dealt(counts[0], size), dealt(counts[1], CHUNK)

    def located(batches):
        for batch in batches:
            leaf = tree.descend(matrix(batch.column("embedding")))
            for name, column in (("leaf", leaf), ("first", first[leaf]), ("parts", parts[leaf])):
                batch = batch.append_column(name, pa.array(column))
            yield batch

    def gathered(group: pa.Table) -> pa.Table:
        group = group.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
        x, ids, leaf = np.ascontiguousarray(stored(group.column("embedding"))) + dtype(0), group.column("vec_id").to_numpy(), group.column("leaf").to_numpy()
        same = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1]
        order = np.argsort(same, kind="stable")  # equal vectors have one leaf, so their ids ascend
        nth = np.empty(len(x), np.int64)
        nth[order] = np.arange(len(x)) - np.searchsorted(same[order], same[order])
        x, ids, leaf = x[nth <= k], ids[nth <= k], leaf[nth <= k]
        return pa.table({"leaves": pa.array([np.unique(leaf).tolist()], pa.list_(pa.int64())),
                         **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("ids", ids), ("leaf", leaf), ("vectors", x))}})

    blocks = rows.select("vec_id", "embedding").mapInArrow(located, f"vec_id long, embedding {kind}, leaf long, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    blocks = cut_lineage(blocks.select("vec_id", "embedding", "leaf", block.alias("block")).groupBy("block").applyInArrow(
        gathered, "leaves array<long>, ids binary, leaf binary, vectors binary"), "blocks")
    queries = rows.filter("asks").select("vec_id", "embedding")
    most = calibrated(tree, blocks, queries, dtype, k)
    home = tree.descend(sample_vectors)

    def routed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                ids, x = part.column("vec_id").to_numpy(), matrix(part.column("embedding"))
                visited = np.zeros((len(x), tree.leaves), bool)
                for i, query in enumerate(x):
                    visited[i, tree.visits(query, most)] = True
                leaf, least = tree.descend(x), np.full(len(x), -np.inf)
                if len(sample_ids) >= k:
                    score = x @ sample_vectors.T
                    slack = 1e-9 * np.maximum(1.0, np.abs(score).max(axis=1))
                    score[~visited[:, home] | (sample_ids == ids[:, None])] = -np.inf
                    least = np.partition(score, len(sample_ids) - k, axis=1)[:, len(sample_ids) - k] - slack
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("embedding"), pa.array([v.tobytes() for v in np.packbits(visited, axis=1)], pa.binary()), pa.array(least),
                     pa.array(team[leaf]), pa.array(teams[leaf])], names=["vec_id", "embedding", "visited", "least", "first", "parts"])

    def teamed(group: pa.Table) -> pa.Table:
        bits = b"".join(group.column("visited").to_pylist())
        seen = np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(len(group), -1), axis=0)
        columns = {"vec_id": "asking", "least": "least"}
        return pa.table({"team": pa.array(group.column("team").to_numpy()[:1]), "seen": pa.array([np.flatnonzero(np.unpackbits(seen)).tolist()], pa.list_(pa.int64())),
                         **{new: pa.array([group.column(c).to_numpy().tobytes()], pa.binary()) for c, new in columns.items()},
                         "visited": pa.array([bits], pa.binary()), "queries": pa.array([stored(group.column("embedding")).tobytes()], pa.binary())})

    asked = queries.mapInArrow(routed, f"vec_id long, embedding {kind}, visited binary, least double, first long, parts long")
    asked = cut_lineage(asked.withColumn("team", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("first", "parts").groupBy("team").applyInArrow(
        teamed, "team long, seen array<long>, asking binary, least binary, visited binary, queries binary"), "teams")
    discard(vectors)

    def meet(batches):
        teams = {}
        for batch in batches:
            for row in range(batch.num_rows):
                name = batch.column("team")[row].as_py()
                if name not in teams:
                    ids = binary(batch, "asking", row, np.int64).copy()
                    teams[name] = (Best(binary(batch, "queries", row, dtype).reshape(len(ids), -1).copy(), ids, binary(batch, "least", row, np.float64), k),
                                   binary(batch, "visited", row, np.uint8).reshape(len(ids), -1).copy())
                best, visited = teams[name]
                best.meet(block_of(batch, row, dtype), lambda leaf, bits=visited: np.flatnonzero(bits[:, leaf >> 3] & (128 >> (leaf & 7))))
            del batch  # before the next one is read
        for best, _ in teams.values():
            yield best.batch()

    n_teams = max(1, asked.count())
    asked = asked.repartition(n_teams).hint("shuffle_replicate_nl")
    spread = blocks.repartition(max(1, min(blocks.count(), -(-4 * cores // n_teams))))
    pairs = spread.join(asked, F.arrays_overlap("leaves", "seen")).drop("leaves", "seen")
    return ranked(pairs.mapInArrow(meet, FOUND).drop("leaf"), k).select("query_id", "rank", "vec_id", "score")
