"""Near duplicates by BagMinHash on five-word shingles, banded and verified.

A text is a bag of shingles (five words in a row; a text of fewer words is one
shingle of all its words; copies of a shingle count).  Two texts are near
copies when their weighted Jaccard similarity, sum of minima over sum of
maxima of the counts, is 0.8 or more; classes are the connected components.

Signature: a shingle's weight range [0, 2^k) is cut into [0, 1), [1, 2),
[2, 4), ... and every interval has a Poisson process of points, rate 1 per unit
of weight, seeded by the shingle and the interval.  A point has a time, a
component and a weight position; it exists for a text when the position lies
below the text's weight.  A component's value is its earliest point, and two
texts agree in it with probability equal to their weighted Jaccard similarity.
Points come in order of time, so the search ends once every component has one.

Bands of four components make buckets.  First every member of a bucket is
compared with the bucket's representative, a number of pairs in proportion to
the members; links join classes.  In buckets that still hold several classes,
all members outside the largest class are then compared with all members, as
products of 0/1 matrices inside tasks of at most two chunks of members; only
links that join classes leave a task.  So no pairs of copies of one text are
listed, and no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut, words_of

SHINGLE, BANDS, ROWS = 5, 20, 4
COMPONENTS = BANDS * ROWS
#: members of a bucket in one chunk
CHUNK = 1024
#: elements of so many bags are counted pair by pair
FEW = 16
#: similarity 4/5, as whole numbers
PART, WHOLE = 4, 5
#: sketch bits in which texts of similarity 0.8 differ: 8 of 80 on average; 28 and more has odds below 1e-8
SKETCH_LIMIT = 28

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOW, _PARTS = np.uint64(2047), np.uint64(COMPONENTS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def shingle_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - SHINGLE + 1)
    s = np.full(n, min(len(w), SHINGLE), dtype=np.uint64)
    for k in range(min(len(w), SHINGLE)):
        s *= _C
        s += w[k:k + n]
    return np.unique(_mix(s), return_counts=True)


def signature(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The earliest point of every component, as 64-bit values."""
    base, low, width, weight = [hashes], [np.zeros(len(hashes))], [np.ones(len(hashes))], [np.ones(len(hashes))]
    step = 1
    while (more := counts > step).any():
        seed = np.uint64((step * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
        base.append(_mix(hashes[more] + seed))
        low.append(np.full(more.sum(), float(step)))
        width.append(np.full(more.sum(), float(step)))
        weight.append(np.minimum(counts[more], 2 * step).astype(np.float64))
        step *= 2
    base, low, width, weight = map(np.concatenate, (base, low, width, weight))
    first = np.full(COMPONENTS, np.inf)
    time = np.zeros(len(base))
    # points of a round: so many that one round nearly fills all components
    block = int(min(1024, max(1, np.ceil(1.2 * COMPONENTS * np.log(COMPONENTS) / width.sum()))))
    done = 0
    while len(base):
        x = _mix(base[:, None] + np.arange(done + 1, done + block + 1, dtype=np.uint64) * _C)
        gap = -np.log(_unit(x)) / width[:, None]
        at = time[:, None] + (np.cumsum(gap, axis=1) if block > 1 else gap)
        component = (((x & _LOW) * _PARTS) >> np.uint64(11)).astype(np.int64)
        if (weight < low + width).any():  # a range that the text's weight fills in part
            there = low[:, None] + width[:, None] * _unit(_mix(x ^ _B)) < weight[:, None]
            np.minimum.at(first, component[there], at[there])
        else:
            np.minimum.at(first, component.ravel(), at.ravel())
        time = at[:, -1]
        on = time < first.max()
        base, low, width, weight, time = base[on], low[on], width[on], weight[on], time[on]
        done += block
    return _mix(first.view(np.uint64))


def bands_of(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _C
    for k in range(ROWS):
        key = _mix(key ^ rows[:, k])
    return key.view(np.int64)


def sketch_of(sig: np.ndarray) -> np.ndarray:
    """One bit of each component, in two 64-bit numbers."""
    bits = np.zeros(128, dtype=np.uint8)
    bits[:COMPONENTS] = sig & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def _signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        seen: dict[str, tuple] = {}
        out = []
        for key, text in zip(frame["key"], frame["text"]):
            if key not in seen:
                words = words_of(text or "")
                if words:
                    hashes, counts = shingle_hashes(words)
                    sig = signature(hashes, counts)
                    seen[key] = (int(counts.sum()), *sketch_of(sig).tolist(), bands_of(sig))
                else:
                    seen[key] = (0, 0, 0, np.zeros(0, np.int64))
            out.append(seen[key])
        yield pd.DataFrame({"key": frame["key"], "doc_id": frame["doc_id"], "n": [x[0] for x in out], "s1": [x[1] for x in out],
                            "s2": [x[2] for x in out], "bands": [x[3] for x in out]})


def similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """Weighted Jaccard similarity of two bags (sorted shingle hashes, counts) is at least ``PART / WHOLE``."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    both = y[0][at] == x[0]
    common = int(np.minimum(x[1][both], y[1][at[both]]).sum())
    return common * WHOLE >= (int(x[1].sum()) + int(y[1].sum()) - common) * PART


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bags, held = {}, 0

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        if text not in bags:
            if held > 2_000_000:
                bags.clear()
                held = 0
            bags[text] = shingle_hashes(words_of(text))
            held += len(bags[text][0])
        return bags[text]

    for frame in frames:
        keep = [similar(bag(a), bag(b)) for a, b in zip(frame["text_a"], frame["text_b"])]
        yield frame.loc[keep, ["a", "b"]]


def _overlaps(bags: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of minima of the counts of every left with every right bag (``left`` and ``right`` number the bags).

    The c-th copy of a shingle is an element of its own, so a sum of minima is
    the size of a common set: elements of many bags are counted by products of
    0/1 matrices, those of few bags pair by pair, those of one bag are left out.
    """
    sets = [np.repeat(h, c) + np.concatenate([np.arange(n) for n in c]).astype(np.uint64) * _C if (c > 1).any() else h for h, c in bags]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    owner, start = owner[order], np.concatenate([[0], np.cumsum(seen)])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    at_left, at_right = np.full(len(bags), -1), np.full(len(bags), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    for k in range(2, FEW + 1):
        for some in np.array_split(np.nonzero(seen == k)[0], 1 + int((seen == k).sum()) * k * k // 2_000_000):
            own = owner[start[some][:, None] + np.arange(k)]
            i, j = np.broadcast_arrays(at_left[own][:, :, None], at_right[own][:, None, :])
            both = (i >= 0) & (j >= 0)
            np.add.at(out, (i[both], j[both]), 1.0)
    many = np.nonzero(seen > FEW)[0]
    for first in range(0, len(many), 4096):
        some = many[first:first + 4096]
        ones = np.zeros((len(bags), len(some)), dtype=np.float32)
        for column, e in enumerate(some):
            ones[owner[start[e]:start[e + 1]], column] = 1.0
        out += ones[left] @ ones[right].T
    return out


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Links that join the classes of a bucket, or of two chunks of one: no more than there are classes less one."""
    frame = frame.sort_values("uid").drop_duplicates(["uid", "role"])
    one = frame.drop_duplicates("uid")
    uid, root = one["uid"].to_numpy(), one["root"].to_numpy()
    left = np.nonzero(np.isin(uid, frame.loc[frame["role"] != "right", "uid"]))[0]
    right = np.nonzero(np.isin(uid, frame.loc[frame["role"] != "left", "uid"]))[0]
    found = []
    if len(left) and len(right):
        bags = [shingle_hashes(words_of(t)) for t in one["text"]]
        size = np.array([float(c.sum()) for _, c in bags])
        common = _overlaps(bags, left, right)
        near = common * (WHOLE + PART) >= (size[left][:, None] + size[right][None, :]) * PART
        near &= root[left][:, None] != root[right][None, :]
        x, y = np.nonzero(near)
        _, kind = np.unique(root, return_inverse=True)
        _, pick = np.unique(kind[left[x]] * len(uid) + kind[right[y]], return_index=True)
        up = list(range(len(uid)))

        def top(k):
            while up[k] != k:
                k = up[k]
            return k

        for n in pick:
            a, b = left[x[n]], right[y[n]]
            p, q = top(kind[a]), top(kind[b])
            if p != q:
                up[p] = q
                found.append((int(uid[a]), int(uid[b])))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with the classes joined that the links (a, b) connect."""
    now = roots.select("uid", "root")
    edges = (links.join(now.select(F.col("uid").alias("a"), F.col("root").alias("ra")), "a")
             .join(now.select(F.col("uid").alias("b"), F.col("root").alias("rb")), "b"))
    merged = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return cut(roots.join(merged, "root", "left").select("uid", "n", "s1", "s2", F.coalesce("new", "root").alias("root")))


def id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("-"))


def text_key(doc_id: Column, text: Column) -> Column:
    """Equal for equal texts; a null text is a text of its own for each id."""
    return F.coalesce(F.md5(text), F.concat(F.lit("null "), id_key(doc_id)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of the links (a, b): the root is the smallest node.

    Every round points each node to its smallest neighbour, follows the
    pointers twice and contracts the links.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    labels = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = cut(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("p")).select("x", F.least("x", "p").alias("p")))
        for _ in range(2):
            over = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            up = up.join(over, "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        up = cut(up)
        labels = cut(labels.join(up, labels["root"] == up["x"], "left").select("node", F.coalesce("p", "root").alias("root")))
        ua, ub = up.select(F.col("x").alias("a"), F.col("p").alias("pa")), up.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        edges = cut(edges.join(ua, "a").join(ub, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    return labels


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: (key, doc_id) of every row of ``docs``; (key, uid, doc_id, copies, root) of every different text.

    ``docs`` has (doc_id, text).  ``root`` numbers the class of a text.
    """
    keyed = docs.select(text_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(keyed.mapInPandas(_signatures, "key string, doc_id long, n long, s1 long, s2 long, bands array<long>"))
    texts = cut(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
                                        F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("bands").alias("bands")))
    texts = cut(texts.withColumn("uid", F.monotonically_increasing_id()))
    dealt = texts.select("uid", F.explode("bands").alias("bucket"))
    shared = cut(dealt.groupBy("bucket").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo < hi").select("bucket", "lo"))
    live = cut(dealt.join(shared.select("bucket"), "bucket"))
    member = texts.join(live.select("uid").distinct(), "uid").select("uid", "key", "doc_id", "n", "s1", "s2")
    member = cut(member.withColumn("root", F.col("uid")))
    wanted = member.select("uid", "key", id_key(F.col("doc_id")).alias("idk"))
    bodies = cut(keyed.withColumn("idk", id_key(F.col("doc_id"))).join(wanted, ["key", "idk"]).select("uid", "text").dropDuplicates(["uid"]))
    roots = member.select("uid", "n", "s1", "s2", "root")

    # first every member of a bucket with the bucket's representative
    reps = shared.withColumnRenamed("lo", "rep").join(roots.withColumnRenamed("uid", "rep"), "rep")
    reps = reps.select("bucket", *[F.col(c).alias(f"r_{c}") for c in ("n", "s1", "s2")], "rep")
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("r_s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("r_s2")))
    pairs = (live.join(roots, "uid").join(reps, "bucket")
             .where((F.col("uid") != F.col("rep")) & (apart < SKETCH_LIMIT)
                    & (F.least("n", "r_n") * WHOLE >= F.greatest("n", "r_n") * PART))
             .select(F.col("uid").alias("a"), F.col("rep").alias("b")).distinct())
    full = (pairs.join(bodies.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
            .join(bodies.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b"))
    roots = _merged(roots, cut(full.mapInPandas(_verified, "a long, b long")))

    # then, in buckets that still hold several classes, all members outside the largest with all members
    at = live.join(roots.select("uid", "root"), "uid")
    held = at.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = (held.groupBy("bucket").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("k"), F.max(F.struct("m", "root")).alias("top"))
             .where("k > 1 and m > 2").select("bucket", F.col("top.root").alias("top"), F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    role = lambda i, j, r: F.struct(i.alias("i"), j.alias("j"), F.lit(r).alias("role"))
    outside = F.col("root") != F.col("top")
    tasks = F.when(F.col("chunks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"),
                                                          F.when(outside, "both").otherwise("right").alias("role")))).otherwise(
        F.concat(F.transform(every, lambda i: role(i, F.col("c"), "right")),
                 F.when(outside, F.transform(every, lambda j: role(F.col("c"), j, "left")))
                 .otherwise(F.array().cast("array<struct<i:int,j:int,role:string>>"))))
    rows_in = at.join(mixed, "bucket").withColumn("c", chunk).withColumn("t", F.explode(tasks))
    groups = rows_in.select("bucket", "t.i", "t.j", "t.role", "uid", "root").join(bodies, "uid")
    links = groups.groupBy("bucket", "i", "j").applyInPandas(_linked, "a long, b long")
    roots = _merged(roots, cut(links.distinct()))
    found = texts.join(roots.select("uid", "root"), "uid", "left")
    return rows.select("key", "doc_id"), cut(found.select("key", "uid", "doc_id", "copies", F.coalesce("root", "uid").alias("root")))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, texts) of every document.

    ``class_id`` is the smallest doc_id of the class, ``class_size`` its rows,
    ``texts`` its different texts.  Needs doc_id and text; other columns are
    ignored.  Equal texts are one class, also empty ones and ones without a
    word; these are near copies of no other text.  A null text is in a class
    with rows of the same id only.  An empty table gives an empty result.
    """
    rows, texts = classes(docs.select("doc_id", "text"))
    sizes = texts.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"),
                                      F.count(F.lit(1)).alias("texts"))
    named = texts.select("key", "root").join(sizes, "root").select("key", "class_id", "class_size", "texts")
    return rows.join(named, "key").select("doc_id", "class_id", "class_size", "texts")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the smallest doc_id (a null id comes last), with the columns of ``docs``."""
    _, texts = classes(docs.select("doc_id", "text"))
    keep = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k"))
    keep = keep.select(F.col("k.key").alias("key"), id_key(F.col("k.doc_id")).alias("idk"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", text_key(F.col("doc.doc_id"), F.col("doc.text")).alias("key"), id_key(F.col("doc.doc_id")).alias("idk"))
    first = F.row_number().over(Window.partitionBy("key", "idk").orderBy("key"))
    return rows.join(keep, ["key", "idk"]).withColumn("nth", first).where("nth = 1").select("doc.*")
