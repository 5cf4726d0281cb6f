"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become whole numbers, floor(256 x).  Equal vectors are searched once.
A net of bounded size over the vectors (farthest points of a bounded sample,
as many as the vectors fill blocks) forms the upper level of the tree; below it,
the vectors of each net cell are dealt into blocks of bounded size and every
block has its own cover tree: a node has a centre, a covering radius and
children whose centres are a net of its points.  Queries are grouped by a net
of their own and have trees of the same kind.

A pair of nodes (query centre a and radius r, reference centre b and radius s)
can't score above a.b + r|b| + s|a| + rs.  Each query group first searches one
block of its three nearest cells, which gives every query a k-th score; then
all cells, blocks and, inside the blocks, node pairs whose bound is below the
worst k-th score of the query node are left, and the rest is searched.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut, salted_join

#: bounds: sample for the net, net points, vectors of a reference block, queries of a group, points of a leaf, children of a node
SAMPLE, NET, BLOCK, GROUP, LEAF, FAN = 4096, 128, 2048, 512, 48, 8
SLACK = 1e-6


def codes(x: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("long"))


def usable(x: Column) -> Column:
    """Not null, without null or non-finite components."""
    def fine(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: F.coalesce(fine(v.cast("double")), F.lit(False))), F.lit(False))


def matrix(rows: list, width: int) -> np.ndarray:
    """Rows as float64, shorter ones filled up with 0."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def net_of(points: np.ndarray, size: int, stop: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Farthest-first net: places of its points, the nearest of them and the distance for every point."""
    chosen = [0]
    gap = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    owner = np.zeros(len(points), dtype=np.int64)
    while len(chosen) < size:
        far = int(gap.argmax())
        if gap[far] <= stop:
            break
        d = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        nearer = d < gap
        owner[nearer], gap[nearer] = len(chosen), d[nearer]
        chosen.append(far)
    return np.array(chosen), owner, gap


class CoverTree:
    """Nodes in arrays: centre (place of a point), radius, range of ``order``, children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.span, self.children = [], [], [], []
        self.order = np.arange(len(points))
        self._grow(0, len(points))

    def _grow(self, lo: int, hi: int) -> int:
        own = self.order[lo:hi]
        node = len(self.centre)
        sub = self.points[own]
        # the point nearest to the mean is the centre, and first in the net
        first = int(((sub - sub.mean(axis=0)) ** 2).sum(axis=1).argmin())
        own[[0, first]] = own[[first, 0]]
        sub = self.points[own]
        gap = np.sqrt(((sub - sub[0]) ** 2).sum(axis=1))
        self.centre.append(int(own[0]))
        self.radius.append(float(gap.max()))
        self.span.append((lo, hi))
        self.children.append([])
        if hi - lo > LEAF and gap.max() > 0:
            _, owner, _ = net_of(sub, FAN, gap.max() / 2)
            if owner.max() == 0:  # the covering radius is not halved by a net of this size: go on with two
                _, owner, _ = net_of(sub, 2)
            by = np.argsort(owner, kind="stable")
            self.order[lo:hi] = own[by]
            at = lo
            for n in np.bincount(owner):
                if n:
                    self.children[node].append(self._grow(at, at + int(n)))
                    at += int(n)
        else:
            self.order[lo:hi] = own
        return node


def exact_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by float64 products where these are exact, else in whole numbers."""
    if np.abs(a).sum(axis=1).max(initial=0.0) * np.abs(b).max(initial=0.0) < 2.0 ** 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class DualSearch:
    """The k best references (larger score, then smaller id) for each query of a tree, from one block after another."""

    def __init__(self, tree: CoverTree, kth: np.ndarray, k: int):
        self.tree, self.k = tree, k
        self.kth = kth.astype(np.float64)  # scores that the final k-th can't be below
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in range(len(tree.points))]
        self.norm = np.sqrt((tree.points ** 2).sum(axis=1))

    def search(self, other: CoverTree, uids: np.ndarray, firsts: np.ndarray) -> None:
        norm = np.sqrt((other.points ** 2).sum(axis=1))
        tree = self.tree

        def bound(q: int, r: int) -> float:
            a, b = tree.centre[q], other.centre[r]
            x = float(tree.points[a] @ other.points[b]) + tree.radius[q] * norm[b] + other.radius[r] * self.norm[a] + tree.radius[q] * other.radius[r]
            return x + SLACK * (1.0 + abs(x))

        heap = [(-bound(0, 0), 0, 0)]
        while heap:
            top, q, r = heapq.heappop(heap)
            lo, hi = tree.span[q]
            own = tree.order[lo:hi]
            if -top < self.kth[own].min():
                continue
            split_q = tree.children[q] and (not other.children[r] or tree.radius[q] > other.radius[r])
            if split_q:
                for c in tree.children[q]:
                    heapq.heappush(heap, (-bound(c, r), c, r))
            elif other.children[r]:
                for c in other.children[r]:
                    heapq.heappush(heap, (-bound(q, c), q, c))
            else:
                f, g = other.span[r]
                place = other.order[f:g]
                score = exact_dots(tree.points[own], other.points[place])
                for n, i in enumerate(own):
                    hit = np.nonzero(score[n] >= self.kth[i])[0]
                    if len(hit):
                        merged = sorted(self.best[i] + [(-int(score[n, h]), int(firsts[place[h]]), int(uids[place[h]])) for h in hit])[:self.k]
                        self.best[i] = merged
                        if len(merged) == self.k:
                            self.kth[i] = max(self.kth[i], -merged[-1][0])


def _pack(rows: pd.DataFrame) -> dict:
    rows = rows.sort_values("uid")
    width = int(rows["v"].map(len).max())
    points = matrix(rows["v"].tolist(), width)
    tree = CoverTree(points)
    kind = np.int16 if np.abs(points).max(initial=0) < 32_000 else np.int64
    return {"centre": points[tree.centre[0]].tolist(), "radius": tree.radius[0], "width": width, "rows": len(rows),
            "body": pickle.dumps((rows["uid"].to_numpy(), rows["first"].to_numpy(), points.astype(kind), tree.centre, tree.radius, tree.span, tree.children, tree.order))}


def _unpack(body: bytes, width: int) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    uids, firsts, points, centre, radius, span, children, order = pickle.loads(body)
    tree = CoverTree.__new__(CoverTree)
    wide = np.zeros((len(points), max(width, points.shape[1])))
    wide[:, :points.shape[1]] = points
    tree.points, tree.centre, tree.radius, tree.span, tree.children, tree.order = wide, centre, radius, span, children, order
    return uids, firsts, tree


TREE = "cell int, part int, centre array<double>, radius double, width int, rows int, body binary"


def _trees(vectors: DataFrame, net: np.ndarray, size: int) -> DataFrame:
    """One row per block of about ``size`` vectors of a net cell, with its cover tree; written."""
    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = matrix(frame["v"].tolist(), max(net.shape[1], int(frame["v"].map(len).max()) if len(frame) else 0))
            wide = np.zeros((len(net), points.shape[1]))
            wide[:, :net.shape[1]] = net
            d = (wide ** 2).sum(axis=1)[None, :] - 2 * points @ wide.T
            yield frame.assign(cell=d.argmin(axis=1).astype(np.int32))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"cell": key[0], "part": key[1], **_pack(rows)}])

    placed = cut(vectors.mapInPandas(nearest, "uid long, first long, v array<long>, cell int"))
    # at most NET rows
    counts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    return cut(dealt.select("cell", "part", "uid", "first", "v").groupBy("cell", "part").applyInPandas(grow, TREE))


FOUND = "cell int, part int, quid long, uid long, first long, score long"


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of every pair of a query group and a block, for each query of the group.

    ``pairs`` holds both trees and ``kth``, a list of (quid, score that the
    query's k-th can't be below); each pair is a group of one row, so a task
    holds two trees at a time.
    """
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in rows.itertuples():
            width = max(q.width, q.r_width)
            qids, _, tree = _unpack(q.body, width)
            uids, firsts, other = _unpack(q.r_body, width)
            known = {x["quid"]: x["kth"] for x in q.kth} if q.kth is not None else {}
            run = DualSearch(tree, np.array([known.get(i, -np.inf) for i in qids.tolist()]), k)
            run.search(other, uids, firsts)
            out += [(q.cell, q.part, int(qids[i]), uid, first, -score) for i, best in enumerate(run.best) for score, first, uid in best]
        return pd.DataFrame(out, columns=["cell", "part", "quid", "uid", "first", "score"])
    return pairs.groupBy("cell", "part", "r_cell", "r_part").applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "first", "uid")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _cells_for(groups: DataFrame, net: np.ndarray, reach: dict[int, float], nearest: int | None) -> DataFrame:
    """(cell, part, low, r_cell): for each query group its nearest cells, or all cells whose bound is not below ``low``."""
    cells = np.array(sorted(reach), dtype=np.int64)
    radius = np.array([reach[c] for c in cells])

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for g in frame.itertuples():
                width = max(len(g.centre), net.shape[1])
                a, b = matrix([g.centre], width)[0], matrix(list(net[cells]), width)
                if nearest is not None:
                    keep = np.argsort(((b - a) ** 2).sum(axis=1), kind="stable")[:nearest]
                else:
                    x = b @ a + g.radius * np.sqrt((b ** 2).sum(axis=1)) + radius * np.sqrt(a @ a) + g.radius * radius
                    keep = np.nonzero(x + SLACK * (1 + np.abs(x)) >= (-np.inf if pd.isna(g.low) else g.low))[0]
                out += [(g.cell, g.part, g.low, int(cells[c])) for c in keep]
            yield pd.DataFrame(out, columns=["cell", "part", "low", "r_cell"])
    return groups.select("cell", "part", "centre", "radius", "low").mapInPandas(choose, "cell int, part int, low double, r_cell int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of largest integer inner product for each query row.

    ``vectors`` has (vec_id, embedding); ``is_query`` is a condition on vec_id
    that marks the query rows, whose own id is no candidate; ties go to the smaller
    vec_id.  Null ids, null vectors and vectors with null or non-finite
    components take no part.  Vectors of different lengths are compared as if
    filled up with 0.  Repeated rows count once; of an id with several vectors
    the smallest counts.  An empty table gives an empty result.
    """
    rows = (vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), codes(F.col("embedding")).alias("v")))
    rows = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    asked = rows.where(is_query)
    # equal vectors once, with the k + 1 smallest ids (Spark keeps so many of each before the shuffle)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    single = (rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    single = cut(cut(single).withColumn("uid", F.monotonically_increasing_id()).withColumn("first", F.col("ids")[0]))
    wanted = cut(cut(asked.select("v").distinct()).withColumn("uid", F.monotonically_increasing_id()).withColumn("first", F.col("uid")))
    sample = single.orderBy(F.xxhash64("v"), "uid").select("v").limit(SAMPLE).collect()
    if not sample or wanted.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = matrix([r["v"] for r in sample], max(len(r["v"]) for r in sample))
    # the first points of a farthest-first net are a net themselves
    net = points[net_of(points, NET)[0]]
    coarse = net[:-(-wanted.count() // GROUP)]
    net = net[:-(-single.count() // BLOCK)]
    refs = _trees(single.select("uid", "first", "v"), net, BLOCK)
    groups = _trees(wanted.select("uid", "first", "v"), coarse, GROUP)
    blocks = refs.select(*[F.col(c).alias(f"r_{c}") for c in refs.columns])

    # reach of a cell: the farthest any of its vectors can lie from the net point (at most NET rows)
    at_net = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in net]), F.col("cell") + 1)
    apart = F.sqrt(F.greatest(_dot(F.col("centre"), F.col("centre")) + _dot(at_net, at_net) - 2 * _dot(F.col("centre"), at_net), F.lit(0.0)))
    reach = {r["cell"]: r["reach"] for r in refs.groupBy("cell").agg(F.max(apart + F.col("radius")).alias("reach")).collect()}

    empty = F.lit(None).cast("array<struct<quid:long,kth:double>>")
    start = _cells_for(groups.withColumn("low", F.lit(None).cast("double")), net, reach, 3)
    start = (groups.withColumn("kth", empty).join(start.select("cell", "part", "r_cell"), ["cell", "part"])
             .join(blocks.where("r_part = 0"), "r_cell"))
    trial = cut(_searched(start, k + 1))
    worst = (_best(trial, k + 1).groupBy("cell", "part", "quid").agg(F.max("n").alias("n"), F.min("score").cast("double").alias("kth"))
             .where(F.col("n") == k + 1).groupBy("cell", "part")
             .agg(F.collect_list(F.struct("quid", "kth")).alias("kth"), F.min("kth").alias("low"), F.count(F.lit(1)).alias("known")))
    bounded = cut(groups.join(worst, ["cell", "part"], "left")
                  .withColumn("low", F.when(F.col("known") == F.col("rows"), F.col("low"))).drop("known"))
    cells = _cells_for(bounded, net, reach, None)
    meta = blocks.select("r_cell", "r_part", "r_centre", "r_radius")
    a, b, r, s = F.col("centre"), F.col("r_centre"), F.col("radius"), F.col("r_radius")
    x = _dot(a, b) + r * F.sqrt(_dot(b, b)) + s * F.sqrt(_dot(a, a)) + r * s
    alive = (cells.join(bounded.select("cell", "part", "centre", "radius"), ["cell", "part"]).join(meta, "r_cell")
             .where(F.col("low").isNull() | (x + SLACK * (F.lit(1.0) + F.abs(x)) >= F.col("low")))
             .select("cell", "part", "r_cell", "r_part"))
    pairs = (alive.join(bounded.select("cell", "part", "width", "body", "kth"), ["cell", "part"])
             .join(blocks.select("r_cell", "r_part", "r_width", "r_body"), ["r_cell", "r_part"]))
    best = _best(_searched(pairs, k + 1), k + 1).select("quid", "uid", "score")

    spread = best.join(single.select("uid", "ids"), "uid").select("quid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    listed = (spread.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
              .groupBy("quid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top")))
    named = listed.join(wanted.select(F.col("uid").alias("quid"), "v"), "quid").select("v", "top")
    out = salted_join(asked.select(F.col("vec_id").alias("query_id"), "v"), named, "v")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return (out.select("query_id", F.posexplode(others).alias("place", "t"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "t.vec_id", "t.score"))


def embedding_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top k of the rows whose vec_id is divisible by ``every``, against all rows."""
    return top_k(embeddings, F.pmod(F.col("vec_id"), F.lit(every)) == 0, k)
