"""Exact quantiles of many columns without a value map per column.

``percentile`` keeps every distinct value of a column in one reducer.  Here
one scan sketches all columns (``percentile_approx``, mergeable, bounded) and
gives each wanted rank a bracket of values that must hold it; a second scan
counts, for all columns and brackets at once, the rows of each cell between
bracket ends and the values inside brackets, both with map-side aggregation.
The few cells that hold a wanted rank are cut into a histogram of equal steps,
and only the values of one step are ranked by a window.  So a task never sorts
more than a small part of a bracket, whatever the table's size, and the result
is that of ``percentile`` (linear interpolation between two ranks), which
tables of up to ``WHOLE`` rows are given to, as two more scans cost them more.

Without groups the sketch is one of some ``PLACING`` rows, which only place the
brackets, and the second scan, over every row, is numpy's; it counts the rows too.  A rank that lay
outside its bracket would raise, never give another value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

#: accuracy of the sketch, and how many times its error a bracket reaches beyond its rank
ACCURACY, MARGIN = 4_000, 4
#: groups of no more values than this have one bracket, all their values
SMALL = 16 * ACCURACY
#: in tables of no more rows than this ``percentile`` has a small value map and needs one scan (the results are the same)
WHOLE = 1_000_000
#: rows that place brackets where there are no groups; a bracket reaches ``SPREAD`` standard errors beyond its rank
PLACING, SPREAD = 2_000_000, 8
#: steps of the histogram of a cell
STEPS = 4_096


def _rank(p: float, n: Column) -> Column:
    return F.lit(float(p)) * (n - 1)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a small table on null-safe keys; its size is bounded by groups x columns x probabilities."""
    small = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(F.broadcast(small), same).drop(*[f"_r_{k}" for k in keys])


def _brackets(df: DataFrame, xs: list[Column], probs: list[float], by: list[str]) -> DataFrame:
    """(by, _at, _n, _lo, _hi): for each group and column the ends of the bracket of every probability."""
    room = MARGIN / ACCURACY
    points = sorted({min(max(p + s * room, 0.0), 1.0) for p in probs for s in (-1, 1)})
    sketched = [F.struct(F.lit(i).alias("at"), F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"),
                         F.percentile_approx(x, points, ACCURACY).alias("s")) for i, x in enumerate(xs)]
    row = df.groupBy(*by).agg(F.array(*sketched).alias("_all")).select(*by, F.explode("_all").alias("_c"))
    n, low, high = F.col("_c.n"), F.col("_c.least"), F.col("_c.most")

    def end(p: float, sign: int) -> Column:
        at = p + sign * room
        if not 0 < at < 1:
            return low if sign < 0 else high
        return F.when(n <= SMALL, low if sign < 0 else high).otherwise(F.col("_c.s")[points.index(at)])
    return row.select(*by, F.col("_c.at").alias("_at"), n.alias("_n"),
                      F.array(*[end(p, -1) for p in probs]).alias("_lo"), F.array(*[end(p, 1) for p in probs]).alias("_hi"))


def _placed(df: DataFrame, xs: list[Column], probs: list[float], rows: int) -> list[tuple[int, list[float], list[float]]]:
    """(n, low ends, high ends) of each column: what ``_brackets`` finds, as numbers and from one sketch of some rows.

    ``n`` is that of the sketch's rows, scaled up, and only tells small columns
    apart; an end beyond all values is an infinity, or NaN, the largest value.
    """
    part = min(1.0, PLACING / rows)
    some = df.sample(part, seed=1) if part < 1 else df

    def room(n: float) -> float:
        return MARGIN / ACCURACY + (SPREAD * 0.5 / n ** 0.5 if part < 1 else 0.0)
    # how many rows of a column the sketch will see is not known before: its ends are asked for by halves of the count
    sizes = [2.0 * PLACING]
    while part < 1 and sizes[-1] > SMALL * part and room(sizes[-1]) < 1:
        sizes.append(sizes[-1] / 2)
    points = sorted({p + s * room(n) for p in probs for s in (-1, 1) for n in sizes if 0 < p + s * room(n) < 1}) or [0.5]
    row = some.agg(*[c for i, x in enumerate(xs) for c in (F.count(x).alias(f"n_{i}"), F.percentile_approx(x, points, ACCURACY).alias(f"s_{i}"))]).first()

    def end(i: int, p: float, sign: int) -> float:
        n = row[f"n_{i}"]
        size = next((s for s in sizes if s <= n), None) if part < 1 else sizes[0]
        at = p + sign * room(size) if size and n > SMALL * part else 0.0
        if not 0 < at < 1:
            return float("-inf") if sign < 0 else float("nan")
        return row[f"s_{i}"][points.index(at)]
    n = [row[f"n_{i}"] if part == 1 else max(1, int(row[f"n_{i}"] / part)) for i in range(len(xs))]
    return [(n[i], [end(i, p, -1) for p in probs], [end(i, p, 1) for p in probs]) if n[i] else (0, [], []) for i in range(len(xs))]


def _cell_counts(df: DataFrame, xs: list[Column], placed: list[tuple[int, list[float], list[float]]]) -> DataFrame:
    """(_at, _cell, _v, _c): rows of every cell, and of every value inside a bracket; NaN is the largest value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside = [np.zeros(2 * len(lo) + 1, dtype="int64") for _, lo, _ in placed]
        schema = pa.schema([("_at", pa.int32()), ("_cell", pa.int32()), ("_v", pa.float64()), ("_c", pa.int64())])
        for batch in batches:
            found = []
            for i, (n, lo, hi) in enumerate(placed):
                if not n:
                    continue
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False) + 0.0
                v, c = np.unique(x, return_counts=True)  # one NaN, the last
                nan = np.isnan(v)
                cell, inside = np.zeros(len(v), dtype="int32"), np.zeros(len(v), dtype=bool)
                for a, b in zip(lo, hi):
                    over, above = (v >= a) | nan, (v > b) | (nan & (not np.isnan(b)))
                    cell += over.astype("int32") + above
                    inside |= over & ~above
                outside[i] += np.bincount(cell[~inside], weights=c[~inside], minlength=len(outside[i])).astype("int64")
                found.append((np.full(inside.sum(), i, dtype="int32"), cell[inside], v[inside], c[inside]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found)], schema=schema)
        left = [(i, j, None, int(c)) for i, counts in enumerate(outside) for j, c in enumerate(counts) if c]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in left], schema.field(k).type) for k in range(4)], schema=schema)

    return (df.select(*[x.alias(f"_x{i}") for i, x in enumerate(xs)]).mapInArrow(run, "_at int, _cell int, _v double, _c bigint")
            .groupBy("_at", "_cell", "_v").agg(F.sum("_c").alias("_c")))


def _grouped_counts(df: DataFrame, xs: list[Column], brackets: DataFrame, by: list[str], every: range) -> DataFrame:
    """``_cell_counts`` by group, with the brackets of every group and probability."""
    key = [*by, "_at"]
    values = (df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("at"), x.alias("v")) for i, x in enumerate(xs)])).alias("_x"))
              .select(*by, F.col("_x.at").alias("_at"), F.col("_x.v").alias("_v")).where("_v IS NOT NULL"))
    v = F.col("_v")
    cell = reduce(lambda a, b: a + b, [(v >= F.col("_lo")[j]).cast("int") + (v > F.col("_hi")[j]).cast("int") for j in every])
    inside = reduce(lambda a, b: a | b, [(v >= F.col("_lo")[j]) & (v <= F.col("_hi")[j]) for j in every])
    return (_joined(values, brackets.drop("_n"), key).select(*key, cell.alias("_cell"), F.when(inside, v).alias("_v"))
            .groupBy(*key, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c")))


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, q): non-null values of each column, and their quantiles as an array in the order of ``probs``.

    ``columns`` names numeric expressions over ``df``; NaN counts as the
    largest value, ``q`` is null for a column without values.  ``by`` are
    columns of few distinct values (clusters, models): the brackets, one row
    for each group and column, are broadcast.
    """
    by, probs, names = list(by), [float(p) for p in probs], list(columns)
    if not names:
        raise ValueError("no columns to take quantiles of")
    xs = [c.cast("double") for c in columns.values()]
    rows = df.count()
    if rows <= WHOLE:
        each = [F.struct(F.lit(name).alias("column"), F.count(x).alias("n"), F.percentile(x, probs).alias("q")) for name, x in zip(names, xs)]
        return df.groupBy(*by).agg(F.array(*each).alias("_all")).select(*by, F.explode("_all").alias("_c")).select(*by, "_c.*")
    key = [*by, "_at"]
    ensure_checkpoint_dir(df.sparkSession)
    # written, as more than one step reads them: the table itself is scanned twice
    if by:
        brackets = _brackets(df, xs, probs, by).checkpoint()
        counted = _grouped_counts(df, xs, brackets, by, range(len(probs))).checkpoint()
    else:
        placed = _placed(df, xs, probs, rows)
        counted = _cell_counts(df, xs, placed).checkpoint()
        totals = counted.groupBy("_at").agg(F.sum("_c").alias("_n"))  # one row a column
        every = df.sparkSession.createDataFrame([(i,) for i in range(len(xs))], "_at int")
        brackets = every.join(F.broadcast(totals), "_at", "left").select("_at", F.coalesce("_n", F.lit(0).cast("bigint")).alias("_n"))

    # cells in order of value (two a probability and one more), and the wanted ranks in each
    before = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (counted.groupBy(*key, "_cell").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
             .withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
             .withColumn("_n", F.sum("_c").over(Window.partitionBy(*key))))
    ranks = F.array_distinct(F.array(*[f(_rank(p, F.col("_n"))).cast("long") for p in probs for f in (F.floor, F.ceil)]))

    def held(wanted: Column, start: Column, count: Column) -> Column:
        return F.filter(wanted, lambda r: (r >= start) & (r < start + count))
    cells = (cells.withColumn("_want", held(ranks, F.col("_start"), F.col("_c"))).where(F.size("_want") > 0)
             .withColumn("_least", F.coalesce("_least", F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))
             .select(*key, "_cell", "_least", "_most", "_start", "_want"))

    # equal steps inside those cells; where the ends are not finite all values are one step
    width = F.col("_most") - F.col("_least")
    finite = (width < F.lit(float("inf"))) & (F.abs("_least") < F.lit(float("inf")))
    step = F.when(finite, F.coalesce(F.width_bucket("_v", F.col("_least"), F.col("_most"), F.lit(STEPS)), F.lit(0))).otherwise(0)
    stepped = (_joined(counted.where("_v IS NOT NULL"), cells, [*key, "_cell"])
               .select(*key, "_cell", step.cast("int").alias("_step"), "_v", "_c", "_start", "_want"))
    before = Window.partitionBy(*key, "_cell").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = (stepped.groupBy(*key, "_cell", "_step").agg(F.sum("_c").alias("_c"), F.first("_start").alias("_start"), F.first("_want").alias("_want"))
             .withColumn("_start", F.col("_start") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
             .withColumn("_want", held(F.col("_want"), F.col("_start"), F.col("_c"))).where(F.size("_want") > 0)
             .select(*key, "_cell", "_step", "_start", "_want"))
    before = Window.partitionBy(*key, "_cell", "_step").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    picked = (_joined(stepped.drop("_start", "_want"), steps, [*key, "_cell", "_step"])
              .withColumn("_start", F.col("_start") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
              .select(*key, F.explode(held(F.col("_want"), F.col("_start"), F.col("_c"))).alias("_rank"), "_v"))
    found = picked.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at_rank"))

    def quantile(p: float) -> Column:
        at = _rank(p, F.col("_n"))
        below, above = F.floor(at).cast("long"), F.ceil(at).cast("long")
        x, y = F.col("_at_rank")[below], F.col("_at_rank")[above]
        return F.when((below == above) | (x == y), x).otherwise((above - at) * x + (at - below) * y)
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("_at") + 1)
    small = found.select(*[F.col(k).alias(f"_r_{k}") for k in key], "_at_rank")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key])
    return (brackets.select(*key, "_n").join(F.broadcast(small), same, "left")
            .select(*by, named.alias("column"), F.col("_n").alias("n"),
                    F.when(F.col("_n") > 0, F.array(*[quantile(p) for p in probs])).alias("q")))


def quantile_values(df: DataFrame, columns: dict[str, Column], probs: Sequence[float], approx: bool = False) -> dict[str, list[float] | None]:
    """The quantiles of each column as numbers (one row per column reaches the driver); None for a column without values.

    With ``approx`` a single sketch is taken at its word.
    """
    if not columns:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(c.cast("double"), list(probs), 100_000).alias(f"q_{i}") for i, c in enumerate(columns.values())]).first()
        return {name: row[f"q_{i}"] for i, name in enumerate(columns)}
    return {r["column"]: r["q"] for r in exact_quantiles(df, columns, probs).collect()}
