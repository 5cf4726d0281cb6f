"""Hard negatives by anchor-clustered shared lists.

Vectors become whole numbers, floor(256 x); a score is an integer inner
product.  Each anchor first needs its positives, the best other rows of its own
label, then for each positive the best rows of other labels whose score lies in
a window below the positive's.  Both are searches for the k best rows of a
window of scores, and both go the same way:

* Anchors are clustered by direction.  The centres come from a bounded sample;
  every anchor joins its nearest centre.
* Rows are dealt into blocks of bounded size.  In a block, a cluster sorts all
  rows once by an upper bound that holds for each of its members: a member u
  lies within angle t of the centre c, so u.x <= |u| |x| cos(max(0, angle(c, x) - t)).
* Every member of the cluster walks that shared list from the top and stops
  where the bound of the next row, times its own norm, is below the worst score
  it still needs: that of its k-th row so far, or the window's lower end.
  What is left of the list can't hold a result, so the search is exact.

One block is searched first; the k-th scores found there let the walks of all
other blocks stop earlier.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut
from riskframe.llm.topk import codes, exact_dots, matrix, usable

#: bounds: anchors that the centres are fitted on, anchors of a cluster on average, centres, rounds of the fit
SAMPLE, MEMBERS, CENTRES, ROUNDS = 4096, 64, 256, 10
#: anchors of one task, members that walk together, rows of a block, rows of a step of the walk
GROUP, WALKERS, BLOCK, STEP = 8192, 256, 16_384, 256
#: room for rounding in the bounds
SLACK = 1e-6

NO_LOW, NO_HIGH = -(1 << 62), 1 << 62
FOUND = "uid long, w int, other long, vec_id long, score long"


def _units(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zero for a zero vector) and norms."""
    norm = np.sqrt((points ** 2).sum(axis=1))
    return points / np.where(norm > 0, norm, 1.0)[:, None], norm


def centres_of(points: np.ndarray, size: int) -> np.ndarray:
    """Directions of ``size`` clusters: spherical k-means from starts spread over the points."""
    unit, _ = _units(points)
    centre = unit[np.linspace(0, len(unit) - 1, size).astype(int)]
    for _ in range(ROUNDS):
        owner = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, owner, unit)
        moved, norm = _units(total)
        centre = np.where((norm > 0)[:, None], moved, centre)
    return centre


def shared_list(unit: np.ndarray, rows_unit: np.ndarray, rows_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows for a cluster of directions ``unit``, and their bounds in that order (for a member of norm 1)."""
    centre, _ = _units(unit.sum(axis=0, keepdims=True))
    some = (unit != 0).any(axis=1)
    spread = np.arccos(np.clip(unit[some] @ centre[0], -1, 1)).max(initial=0.0)
    angle = np.arccos(np.clip(rows_unit @ centre[0], -1, 1))
    bound = rows_norm * np.cos(np.maximum(0.0, angle - spread))
    bound += SLACK * (1 + rows_norm)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Walk:
    """The k best rows (larger score, then smaller vec_id) in each window of the members of a cluster."""

    def __init__(self, members: pd.DataFrame, width: int, k: int, same: bool):
        self.k, self.same = k, same
        self.uid, self.label = members["uid"].to_numpy(), members["label"].to_numpy()
        self.points = matrix(list(members["v"]), width)
        windows = [(m, *w) for m, row in enumerate(zip(members["w"], members["low"], members["high"], members["least"]))
                   for w in zip(*row)]
        member, w, low, high, least = np.array(windows, dtype=np.int64).reshape(-1, 5).T
        self.member, self.w, self.low, self.high = member, w, low, high
        #: scores below this are of no use
        self.need = np.maximum(low, least)
        self.found = np.zeros((0, 4), dtype=np.int64)  # window, score, vec_id, row

    def over(self, order: np.ndarray, bound: np.ndarray, rows: dict[str, np.ndarray]) -> None:
        norm = _units(self.points)[1]
        for at in range(0, len(order), STEP):
            reach = norm * bound[at]
            going = np.nonzero((reach + SLACK * (1 + np.abs(reach)))[self.member] >= self.need)[0]
            if not len(going):
                return
            step = order[at:at + STEP]
            walkers, place = np.unique(self.member[going], return_inverse=True)
            score = exact_dots(self.points[walkers], rows["points"][step])
            allowed = (self.label[walkers][:, None] == rows["label"][step][None, :]) == self.same
            allowed &= self.uid[walkers][:, None] != rows["uid"][step][None, :]
            score, allowed = score[place], allowed[place]
            allowed &= (score >= self.need[going][:, None]) & (score <= self.high[going][:, None])
            i, j = np.nonzero(allowed)
            if len(i):
                new = np.stack([going[i], score[i, j], rows["vec_id"][step[j]], step[j]], axis=1)
                self._keep(np.concatenate([self.found, new]))

    def _keep(self, found: np.ndarray) -> None:
        found = found[np.lexsort((found[:, 3], found[:, 2], -found[:, 1], found[:, 0]))]
        start = np.searchsorted(found[:, 0], np.arange(len(self.need)))
        place = np.arange(len(found)) - start[found[:, 0]]
        self.found = found[place < self.k]
        last = found[place == self.k - 1]
        self.need[last[:, 0]] = np.maximum(self.need[last[:, 0]], last[:, 1])


def _searcher(k: int, same: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            width = max(max(map(len, anchors["v"])), max(map(len, rows["v"])), 1)
            points = matrix(list(rows["v"]), width)
            held = {"points": points, "label": rows["label"].to_numpy(), "uid": rows["uid"].to_numpy(), "vec_id": rows["vec_id"].to_numpy()}
            unit, norm = _units(points)
            for _, cluster in anchors.groupby("cluster"):
                order, bound = shared_list(_units(matrix(list(cluster["v"]), width))[0], unit, norm)
                for at in range(0, len(cluster), WALKERS):
                    walk = Walk(cluster.iloc[at:at + WALKERS], width, k, same)
                    walk.over(order, bound, held)
                    f = walk.found
                    out.append(np.stack([walk.uid[walk.member[f[:, 0]]], walk.w[f[:, 0]], held["uid"][f[:, 3]], f[:, 2], f[:, 1]], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        return pd.DataFrame(found, columns=["uid", "w", "other", "vec_id", "score"]).astype({"w": "int32"})
    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, k: int, same: bool) -> DataFrame:
    """(uid, w, other, vec_id, score, rank): the k best rows of each window of each anchor.

    ``anchors`` has (uid, cluster, grp, v, label, w, low, high), the last three
    arrays; ``same`` asks for rows of the same label, else of others.
    """
    def over(asked: DataFrame, first: int, last: int) -> DataFrame:
        left = asked.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last))))
        right = (rows.where(F.col("block").between(first, last))
                 .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
        return (left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block"))
                .applyInPandas(_searcher(k, same), FOUND))

    none = anchors.withColumn("least", F.transform("w", lambda w: F.lit(NO_LOW).cast("long")))
    found = cut(over(none, 0, 0))
    if blocks > 1:
        worst = (_best(found, k).where(F.col("rank") == k).groupBy("uid")
                 .agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth")))
        known = (anchors.join(worst, "uid", "left")
                 .withColumn("least", F.transform("w", lambda w: F.coalesce(F.col("kth")[w], F.lit(NO_LOW).cast("long")))).drop("kth"))
        found = found.unionByName(cut(over(known, 1, blocks - 1)))
    return cut(_best(found, k))


def _clustered(anchors: DataFrame, count: int) -> tuple[DataFrame, int]:
    """``anchors`` with cluster and group (a task's anchors), and the number of groups."""
    sample = anchors.orderBy(F.xxhash64("uid"), "uid").select("v").limit(SAMPLE).collect()
    points = matrix([r["v"] for r in sample], max(len(r["v"]) for r in sample) or 1)
    centre = centres_of(points, min(CENTRES, -(-count // MEMBERS), len(points)))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        width = max(centre.shape[1], max(map(len, v), default=0))
        return pd.Series((matrix(list(v), width) @ matrix(list(centre), width).T).argmax(axis=1).astype("int32"))

    dealt = cut(anchors.withColumn("cluster", nearest("v")))
    # neighbouring clusters share a group; a large cluster is dealt over several
    sizes = sorted((r["cluster"], r["n"]) for r in dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect())
    first, parts, group, filled = {}, {}, 0, 0
    for cluster, n in sizes:
        if filled and filled + n > GROUP:
            group, filled = group + 1, 0
        first[cluster], parts[cluster] = group, -(-n // GROUP)
        if n > GROUP:
            group, filled = group + parts[cluster], 0
        else:
            filled += n
    begin = F.array(*[F.lit(first.get(c, 0)) for c in range(len(centre))])
    share = F.array(*[F.lit(parts.get(c, 1)) for c in range(len(centre))])
    at = F.col("cluster") + 1
    return (dealt.withColumn("grp", F.element_at(begin, at) + F.pmod(F.xxhash64("uid"), F.element_at(share, at)).cast("int")),
            group + 1)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has (vec_id, embedding, label); anchors are the rows whose
    vec_id is divisible by ``every``.  An anchor's positives are its first
    ``positives`` other rows of its label; the negatives of a positive are the
    first ``negatives`` rows of other labels whose score lies between ``low``
    and ``high`` hundredths of the positive's.  Higher scores come first, ties
    by smaller vec_id.  Rows with a null vec_id, label or vector, or a null or
    non-finite component, take no part.  Vectors of different lengths are
    compared as if filled up with 0.  Repeated rows stay repeated: each is a
    row of its own, an anchor too, and another row of its copies.  A negative
    positive score has an empty window.  An empty table gives an empty result.
    """
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                    codes(F.col("embedding")).alias("v"))
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    blocks = max(1, -(-rows.count() // BLOCK))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    count = asked.count()
    if not count:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                     "positive_score long, negative_score long")
    anchors, groups = _clustered(asked, count)
    anchors = cut(anchors)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))

    def one(value, kind):
        return F.array(F.lit(value).cast(kind))
    whole = anchors.withColumn("w", one(0, "int")).withColumn("low", one(NO_LOW, "long")).withColumn("high", one(NO_HIGH, "long"))
    best = _search(whole, rows, blocks, groups, positives, True)
    windows = (best.where("score >= 0")
               .select("uid", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                       F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"{high} * score div 100").alias("high")))
    by_anchor = (windows.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("w", "low", "high"))).alias("s"))
                 .select("uid", F.col("s.w").alias("w"), F.col("s.low").alias("low"), F.col("s.high").alias("high")))
    found = _search(anchors.join(by_anchor, "uid"), rows, blocks, groups, negatives, False)
    return (found.select("uid", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(windows, ["uid", "w"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def embedding_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the ``embeddings`` table, where the label of every seventh vec_id is first moved on by one."""
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", "embedding", moved.alias("label")))
