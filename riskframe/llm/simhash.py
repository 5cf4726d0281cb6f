"""Near duplicates by SimHash, found by a range join of per-segment bit counts.

A text's words (ASCII upper case lowered, ASCII white space apart) make
three-word shingles, repeats included; a fingerprint bit is set when it is set
in over half of the shingles' 64-bit hashes.  Two fingerprints are linked when
they differ in ``REACH`` = 2 bits or fewer.

The embedding cuts a fingerprint into 32 segments of two bits and maps it to
the vector of their bit counts (0, 1 or 2), a point of a grid.  One changed bit
moves one count by one, so the Manhattan distance of two points is at most the
Hamming distance of the fingerprints.  Points at distance 2 or less share a
grid point at distance 1 or less from both; every fingerprint therefore visits
its own grid point and the neighbours of that point (65 at most, 49 on
average), and fingerprints that meet nowhere can't be linked.

Where two fingerprints meet alone they are compared bit by bit.  Where more
meet, their pairs are not listed: each of them visits the 65 bit patterns that
differ from it in at most one bit, and those that meet at a pattern (65 at
most, all within two bits of each other) are linked to the smallest of them.
Two fingerprints within two bits always meet at a pattern, so the classes are
those of all links, and the work is linear in the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut
from riskframe.llm.neardup import components

SHINGLE, SEED, REACH = 3, 42, 2
#: shingles whose hash bits are summed at a time
BLOCK = 1 << 16
#: the fingerprints of most documents, whose rows are named without a shuffle (bound of a broadcast)
HOTTEST = 4096

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: the lower bit of every segment
_LOW_BITS = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned; 0 for a null text and for one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    n = max(1, len(words) - SHINGLE + 1)
    last = end[-n:]
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(start[at:min(at + BLOCK, n)].tolist(), last[at:at + BLOCK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        seen: dict[str | None, int] = {}
        for text in frame["text"]:
            if text not in seen:
                seen[text] = fingerprint(text)
        found = np.array([seen[t] for t in frame["text"]], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": found})


def _bits(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def counts(fp: Column) -> Column:
    """The 32 bit counts of a fingerprint, two bits each in one 64-bit number."""
    high = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(high).bitwiseAND(_bits(_LOW_BITS)), 1).bitwiseOR(fp.bitwiseXOR(high).bitwiseAND(_bits(_LOW_BITS)))


def visits(points: DataFrame, keep: list[str], point: str = "v") -> DataFrame:
    """``keep`` and ``w``: the grid point ``point`` and its neighbours at distance one.

    Counts are the bit pairs 00, 01 and 10: one more or less turns 00 to 01
    and back (one bit changes) or 01 to 10 and back (both bits change).
    """
    v, k = F.col(point), F.col("_k")
    lane = F.expr("shiftleft(1L, _k % 32 * 2)")
    both = F.expr("shiftleft(3L, _k % 32 * 2)")
    low, high = v.bitwiseAND(lane) != 0, v.bitwiseAND(lane.bitwiseXOR(both)) != 0
    w = (F.when(k == 64, v)
         .when((k < 32) & ~high, v.bitwiseXOR(lane))
         .when((k >= 32) & (low | high), v.bitwiseXOR(both)))
    return (points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(64))))
            .select(*keep, w.alias("w")).where("w IS NOT NULL"))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), enough of them to connect what all pairs of fingerprints ``fp`` within two bits connect.

    ``fps`` has every fingerprint once.
    """
    points = fps.select("fp", counts(F.col("fp")).alias("v"))
    met = (visits(points, ["fp"]).groupBy("w").agg(F.count(F.lit(1)).alias("m"), F.min("fp").alias("a"), F.max("fp").alias("b"))
           .where("m > 1"))
    met = cut(met)
    pairs = met.where((F.col("m") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= REACH)).select("a", "b")
    # the fingerprints of crowded grid points: their own points are at distance one or less
    crowded = visits(met.where("m > 2").select("w"), [], "w").select(F.col("w").alias("v")).distinct()
    members = points.join(crowded, "v", "left_semi").select("fp")
    flip = F.explode(F.sequence(F.lit(0), F.lit(64)))
    near = members.withColumn("_k", flip).select(
        "fp", F.when(F.col("_k") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, _k % 64)"))).alias("z"))
    first = near.groupBy("z").agg(F.count(F.lit(1)).alias("m"), F.sort_array(F.collect_list("fp")).alias("fps")).where("m > 1")
    stars = first.select(F.explode(F.slice("fps", 2, 65)).alias("a"), F.col("fps")[0].alias("b"))
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest doc_id that
    links of fingerprints reach, the row's own included.  Needs doc_id and
    text; other columns are ignored.  Null texts and texts without a word have
    fingerprint zero and are linked like any other.  Repeated rows stay
    repeated; a null doc_id is never the smallest unless its component has no
    other (then component_id is null).  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(rows.mapInPandas(_fingerprints, "doc_id long, fp long"))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(cut(links(fps.select("fp"))))
    named = cut(fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
                .select("fp", "n", "first", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(named.join(ids, "root").select("fp", "n", "component_id"))
    # all other fingerprints have less than a HOTTEST-th of the rows each
    hot = F.broadcast(named.orderBy(F.desc("n"), "fp").limit(HOTTEST).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    rows = rows.join(hot, "fp", "left")
    found = (rows.where("is_hot").select("doc_id", "fp", F.col("hot_id").alias("component_id"))
             .unionByName(rows.where("is_hot IS NULL").select("doc_id", "fp").join(named.select("fp", "component_id"), "fp")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
