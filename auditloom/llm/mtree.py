"""Exact top-k inner-product search with M-trees.

A tree is bulk-loaded over the integer vectors of one part: paged nodes of a routing vector, a covering radius, the
distance to the parent's routing vector and the largest norm below. The search is best-first by the highest score that a
node can hold: with distance d and norms known, the inner product is (|q|^2 + |x|^2 - d^2) / 2, so a lower bound of the
distance from the triangle inequality bounds the score from above. A child is skipped on its stored parent distance
alone, before its own distance is computed, and leaf entries likewise. Ties are kept open until ids decide, so results are exact.

The root page of the whole is a table of at most CELLS routing vectors (8 MB at most), taken from the vectors with the smallest hashes
of their ids; each vector belongs to the nearest, and a cell of over PART vectors is cut into parts by the hash of
the id, which spreads equal vectors evenly. Each part's tree is built and written once. A query first searches one part of its nearest cell; the
score that it has for its k-th then decides, by the same bound, which other parts it is sent to. Queries of one part are dealt to blocks. Vectors are never copied to queries.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; an
id that is repeated takes part once, with its greatest vector; only vectors of the same number of components are compared (each number is a search of its own); ties in the score go to
the smaller id; fewer than k candidates give fewer rows; an empty table gives no rows. Vectors whose square norm reaches 2**53, where scores would not be exact, are refused. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PART = 8192  #: vectors of a part
CELLS = 4096  #: routing vectors of the root page at most
ROOT_BYTES = 8 << 20  #: and their size
BLOCK = 2048  #: queries of a part that one task answers
LEAF = 128
FANOUT = 16
NOBODY = -(1 << 63)  #: stands for the id of a score to beat; behind any id in a tie
SLACK = 1e-6  #: relative slack of distance bounds against rounding


class Node:
    __slots__ = ("ids", "children", "vectors", "center", "radius", "norm", "away", "centers", "radii", "norms", "parent")

    def __init__(self):
        self.ids = self.children = self.vectors = self.centers = None


class MTree:
    """A height-balanced M-tree over integer vectors (float64 arrays holding integers)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.size = len(ids)
        self.computed = 0  # distances computed by searches
        self.root = self._build(ids, vectors) if len(ids) else None

    @staticmethod
    def _halves(v: np.ndarray, rows: np.ndarray, pieces: int) -> list[np.ndarray]:
        """``rows`` in equal pieces: split again and again between two vectors that lie far apart."""
        out = [rows]
        while len(out) < pieces:
            out.sort(key=len)
            r = out.pop()
            if len(r) < 2:
                out.append(r)
                break
            a = v[r[((v[r] - v[r[0]]) ** 2).sum(1).argmax()]]
            da = ((v[r] - a) ** 2).sum(1)
            b = v[r[da.argmax()]]
            order = np.argsort(da - ((v[r] - b) ** 2).sum(1), kind="stable")
            out += [r[order[: len(r) // 2]], r[order[len(r) // 2 :]]]
        return out

    def _build(self, ids, v) -> Node:
        height = max(0, math.ceil(math.log(max(1, len(ids) / LEAF), FANOUT)))
        return self._node(ids, v, np.arange(len(ids)), height)

    def _node(self, ids, v, rows, height) -> Node:
        node, x = Node(), v[rows]
        mean = x.mean(0)
        node.center = x[((x - mean) ** 2).sum(1).argmin()]
        away = np.sqrt(((x - node.center) ** 2).sum(1))
        node.radius, node.norm = float(away.max()), float((x**2).sum(1).max())
        if height == 0:
            node.ids, node.vectors, node.parent, node.norms = ids[rows], x, away, (x**2).sum(1)
            return node
        pieces = min(FANOUT, max(1, math.ceil(len(rows) / (LEAF * FANOUT ** (height - 1)))))
        node.children = [self._node(ids, v, r, height - 1) for r in self._halves(v, rows, pieces)]
        node.centers = np.stack([c.center for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.norms = np.array([c.norm for c in node.children])
        node.parent = np.sqrt(((node.centers - node.center) ** 2).sum(1))
        return node

    def search(self, q: np.ndarray, k: int, skip: int, best: list | None = None) -> list[tuple[float, int]]:
        """The k best (score, -id), ascending, of all vectors but that of id ``skip``; ``best`` may hold earlier results."""
        best = list(best or [])
        heapq.heapify(best)
        if self.root is None:
            return sorted(best)
        q2 = float(q @ q)
        d = math.sqrt(((q - self.root.center) ** 2).sum())
        queue = [(-math.inf, 0, d, self.root)]
        serial = 0

        def bound(low, norms):
            return (q2 + norms - (np.maximum(low - SLACK * (1 + low), 0)) ** 2) / 2

        while queue:
            top, _, d, node = heapq.heappop(queue)
            if len(best) == k and -top < best[0][0]:
                break
            floor = best[0][0] if len(best) == k else -math.inf
            low = np.abs(d - node.parent)  # the parent is this node: distances to it are stored
            if node.children is None:
                live = np.flatnonzero(bound(low, node.norms) >= floor)
                self.computed += len(live)
                scores = node.vectors[live] @ q
                order = np.lexsort((node.ids[live], -scores))
                for i in order:
                    one = (float(scores[i]), -int(node.ids[live[i]]))
                    if one[1] == -skip:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
                    else:
                        break
                continue
            live = np.flatnonzero(bound(low - node.radii, node.norms) >= floor)
            self.computed += len(live)
            away = np.sqrt(((node.centers[live] - q) ** 2).sum(1))
            tops = bound(away - node.radii[live], node.norms[live])
            for i, a, t in zip(live.tolist(), away.tolist(), tops.tolist(), strict=True):
                if t >= floor:
                    serial += 1
                    heapq.heappush(queue, (-t, serial, a, node.children[i]))
        return sorted(best)


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; one row per id."""
    x = F.col(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.where(F.col(vec_id).isNotNull() & x.isNotNull() & whole).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


class Root:
    """The root page: routing vectors, and of each cell the number of parts, the covering radius and the largest square norm."""

    def __init__(self, centers: np.ndarray):
        self.centers, self.norms = centers, (centers**2).sum(1)

    def away(self, v: np.ndarray) -> np.ndarray:
        """(vectors, cells) distances."""
        return np.sqrt(np.maximum((v**2).sum(1)[:, None] + self.norms - 2 * v @ self.centers.T, 0))

    def measure(self, cells: list, part: int) -> None:
        self.parts, self.radii, self.most = np.zeros(len(self.centers), np.int64), np.zeros(len(self.centers)), np.zeros(len(self.centers))
        for c in cells:
            self.parts[c.cell], self.radii[c.cell], self.most[c.cell] = math.ceil(c.n / part), c.radius, c.norm

    def bounds(self, v: np.ndarray, away: np.ndarray) -> np.ndarray:
        """(vectors, cells) the greatest score that a cell can hold; none for an empty cell."""
        low = np.maximum(away - self.radii - SLACK * (1 + away), 0)
        return np.where(self.parts > 0, ((v**2).sum(1)[:, None] + self.most - low**2) / 2, -np.inf)


def _pieces(batches, rows: int):
    """The batches cut to at most so many rows, without empty ones."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column.to_numpy(zero_copy_only=False)])


def _search(rows: DataFrame, trees: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(query_id, vec_id, score): for each row (query_id, v, cell, part, best) the k best of that part among those above ``best``, the score to beat."""
    rows = scratch.save(rows, name)
    many = rows.groupBy("cell", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    pages = trees.join(many, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = rows.join(many, ["cell", "part"]).withColumn("block", F.expr("int(pmod(xxhash64(query_id), blocks))")).drop("blocks")

    def run(page: pa.Table, ask: pa.Table) -> pa.Table:
        out = []
        if page.num_rows:
            tree = pickle.loads(page.column("tree")[0].as_py())
            for i, v, least in zip(ask.column("query_id").to_pylist(), ask.column("v").to_pylist(), ask.column("best").to_pylist(), strict=True):
                floor = [(float(least), NOBODY)] * k if least is not None else None  # a tie with it isn't ruled out
                out += [(i, -b, int(s)) for s, b in tree.search(np.array(v, np.float64), k, i, floor) if b != NOBODY]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), zip(*out, strict=True) if out else ((), (), ()), strict=True)})

    keys = ["cell", "part", "block"]
    return scratch.save(pages.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long"), f"{name}-found")


def _top_k(rows: DataFrame, n: int, dim: int, k: int, every: int, scratch: Scratch) -> DataFrame:
    """The search among vectors of one size; see ``top_k``."""
    spark = rows.sparkSession
    cells = max(1, min(math.ceil(n / PART), CELLS, ROOT_BYTES // (8 * max(1, dim))))
    root = Root(np.array([r.v for r in rows.select("v").orderBy(F.xxhash64("vec_id")).limit(cells).collect()], np.float64))
    shared = spark.sparkContext.broadcast(root)

    def assign(batches):
        for b in _pieces(batches, 1000):
            v = _matrix(b.column(1))
            away = shared.value.away(v)
            cell = away.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(v)), cell]), pa.array((v**2).sum(1))], names=[*b.schema.names, "cell", "away", "norm"])

    dealt = scratch.save(rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<long>, cell int, away double, norm double"), "dealt")
    root.measure(dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect(), PART)  # one row a cell
    shared = spark.sparkContext.broadcast(root)
    parts = F.array(*map(F.lit, root.parts.tolist()))
    place = F.expr("pmod(xxhash64(vec_id), parts)").cast("int")
    dealt = dealt.withColumn("parts", F.element_at(parts, F.col("cell") + 1)).withColumn("part", place)

    def build(t: pa.Table) -> pa.Table:
        tree = MTree(t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks()))
        return pa.table({"cell": t.column("cell")[:1], "part": t.column("part")[:1], "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    trees = scratch.save(dealt.select("vec_id", "v", "cell", "part").groupBy("cell", "part").applyInArrow(build, "cell int, part int, tree binary"), "trees")
    asked = dealt.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "cell", "part", F.lit(None).cast("long").alias("best"))
    first = _search(asked, trees, k, scratch, "first")

    def elsewhere(batches):
        root = shared.value
        for b in _pieces(batches, 200):
            v = _matrix(b.column(1))
            best = b.column(4).to_numpy(zero_copy_only=False).astype(float)  # null: fewer than k so far
            live = root.bounds(v, root.away(v)) >= np.where(np.isnan(best), -np.inf, best)[:, None]
            q, c = np.nonzero(live)
            of = root.parts[c]
            q, c = np.repeat(q, of), np.repeat(c, of)
            p = np.arange(len(c)) - np.repeat(np.cumsum(of) - of, of)
            new = (c != b.column(2).to_numpy()[q]) | (p != b.column(3).to_numpy()[q])
            for at in range(0, int(new.sum()), 10_000):
                q_, c_, p_ = (x[new][at : at + 10_000] for x in (q, c, p))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q_)), b.column(1).take(pa.array(q_)), pa.array(c_, pa.int32()), pa.array(p_, pa.int32()), b.column(4).take(pa.array(q_))], names=["query_id", "v", "cell", "part", "best"])

    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("best")).select("query_id", F.when(F.col("n") >= k, F.col("best")).alias("best"))
    more = asked.drop("best").join(kth, "query_id", "left").select("query_id", "v", "cell", "part", "best").mapInArrow(elsewhere, "query_id long, v array<long>, cell int, part int, best long")
    out = first.unionByName(_search(more, trees, k, scratch, "second"))
    scratch.drop(dealt)
    return out


def top_k(table: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    scratch = Scratch(spark, "mtree")
    rows = scratch.save(integer_vectors(table, vec_id, vector).withColumn("dim", F.size("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()  # one row a size
    if any(s.norm >= 2**53 for s in sizes):
        raise ValueError("a square norm reaches 2**53: scores would not be exact")
    found = [_top_k(rows.where(F.col("dim") == s.dim), s.n, s.dim, k, every, scratch) for s in sizes]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
