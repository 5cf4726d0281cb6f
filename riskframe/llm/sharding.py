"""Sharding by histogram sort.

The sort key of a document is (hash of its text, hash of its id, hash of its
row number), three numbers of 60 bits.  The boundaries between shards are
found by counting exact bytes below candidate keys: each round cuts the
interval that holds a boundary into 4096 equal parts, adds up the bytes of
every part over all partitions and goes on in the part where the wanted byte
count lies, until a part border is within the tolerance.  Equal texts have
equal first numbers, so a group is cut only where a boundary falls inside it;
then the rounds go on by the second and third number.  One exchange deals the
rows out.  Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut

KEYS = ("h1", "h2", "h3")
SHIFTS = (48, 36, 24, 12, 0)
PART_BITS = 12


def doc_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def _hash60(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 4)


def keyed(docs: DataFrame, keep: Column) -> DataFrame:
    """Size, checksum and sort key; ``h3`` is added by :func:`numbered` on a written table."""
    return docs.select(keep.alias("doc"), doc_bytes(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"),
                       _hash60(F.col("text")).alias("h1"), _hash60(F.col("doc_id"), F.lit(1)).alias("h2"))


def numbered(written: DataFrame) -> DataFrame:
    return written.withColumn("h3", _hash60(F.monotonically_increasing_id(), F.lit(2)))


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int, int]]:
    """The first key of each shard but shard 0, in order.

    ``rows`` has (h1, h2, h3, size).  Only the part in which each boundary
    lies comes back to the driver: at most ``shards - 1`` rows a round.  A
    part with a single key value goes on by the next number at once; a part
    with a single row ends the search for its boundary.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = total / shards * tolerance
    wanted = {j: j * total / shards for j in range(1, shards)} if total else {}
    # open boundaries: number -> (values of finished keys, level, prefix in the current key, bytes below)
    state = {j: ((), 0, -1, 0) for j in wanted}
    done: dict[int, tuple[int, int, int]] = {}
    while state:
        brackets = sorted(set(state.values()))
        at = {b: n for n, b in enumerate(brackets)}
        name = part = value = F.lit(None)
        for n, (fixed, level, prefix, _) in enumerate(brackets):
            key = KEYS[len(fixed)]
            cond = reduce(lambda x, y: x & y, [F.col(KEYS[i]) == F.lit(v) for i, v in enumerate(fixed)], F.lit(True))
            if prefix >= 0:
                cond = cond & (F.shiftrightunsigned(key, SHIFTS[level] + PART_BITS) == F.lit(prefix))
            name = F.when(cond, F.lit(n)).otherwise(name)
            part = F.when(cond, F.shiftrightunsigned(key, SHIFTS[level])).otherwise(part)
            value = F.when(cond, F.col(key)).otherwise(value)
        hist = (rows.select(name.cast("int").alias("bracket"), part.cast("long").alias("part"), value.cast("long").alias("value"), "size")
                .where(F.col("bracket").isNotNull()).groupBy("bracket", "part")
                .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
        run = Window.partitionBy("bracket").orderBy("part")
        hist = hist.withColumn("upto", F.sum("bytes").over(run)).withColumn("below", F.col("upto") - F.col("bytes"))
        aims = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(at[s]).alias("b"), F.lit(float(wanted[j] - s[3])).alias("aim"))
                         for j, s in state.items()])
        here = F.filter(aims, lambda x: (x["b"] == F.col("bracket")) & (x["aim"] > F.col("below")) & (x["aim"] <= F.col("upto")))
        for r in hist.withColumn("x", F.explode(here)).select("x.j", "part", "below", "upto", "n", "lo", "hi").collect():
            j = r["j"]
            fixed, level, _, base = state.pop(j)
            low, high = base + r["below"], base + r["upto"]
            one_value = r["lo"] == r["hi"]
            if r["n"] == 1 or min(wanted[j] - low, high - wanted[j]) <= slack or (one_value and len(fixed) + 1 == len(KEYS)):
                edge = r["lo"] if wanted[j] - low <= high - wanted[j] else r["hi"] + 1
                done[j] = tuple([*fixed, edge, 0, 0][:3])
            elif one_value:
                state[j] = ((*fixed, r["lo"]), 0, -1, low)
            else:
                state[j] = (fixed, level + 1, r["part"], low)
    out = [done.get(j, (0, 0, 0)) for j in range(1, shards)]
    for i in range(1, len(out)):
        out[i] = max(out[i], out[i - 1])
    return out


def shard_of(bounds: list[tuple[int, int, int]]) -> Column:
    """The shard of a key, by a balanced tree of comparisons."""
    def at_least(b):
        h1, h2, h3 = (F.col(k) for k in KEYS)
        return (h1 > b[0]) | ((h1 == b[0]) & ((h2 > b[1]) | ((h2 == b[1]) & (h3 >= b[2]))))

    def tree(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at_least(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))
    return tree(0, len(bounds))


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, the gapless place within the shard.

    A shard is dealt out in cells (12 bits of the first, 4 of the second
    number), so no task orders a whole shard or a whole group of copies.
    """
    cell = ["shard", "c1", "c2"]
    rows = (rows.withColumn("c1", F.shiftrightunsigned("h1", 48).cast("int"))
            .withColumn("c2", F.shiftrightunsigned("h2", 56).cast("int")))
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("shard").orderBy("c1", "c2").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*cell, F.coalesce(F.sum("n").over(run), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("h1", "h2", "h3"))
    placed = rows.withColumn("place", place)
    return (placed.join(starts, cell).withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long"))
            .drop("start", "place", "c1", "c2"))


def shard_report(docs: DataFrame, shards: int = 24, tolerance: float = 0.0005) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, law ``bytes``.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text
    has 8 bytes and a null checksum; equal rows are told apart by their row
    number.  An empty table gives an empty result.
    """
    rows = numbered(cut(keyed(docs, F.col("doc_id"))))
    rows = cut(rows)
    bounds = splitters(rows, shards, tolerance)
    out = with_slots(rows.withColumn("shard", shard_of(bounds)))
    return out.select(F.col("doc").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
                      F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.0005) -> DataFrame:
    """The columns of ``docs`` and (shard, slot); a column of ``docs`` with such a name is replaced."""
    if {"shard", "slot"} & set(docs.columns):
        docs = docs.drop("shard", "slot")
    rows = numbered(cut(keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    bounds = splitters(rows, shards, tolerance)
    out = with_slots(rows.withColumn("shard", shard_of(bounds)))
    return out.select("doc.*", F.col("shard").cast("int").alias("shard"), "slot")
