"""DuckDB SQL for the profiling queries."""

from __future__ import annotations

from .sql import r

NUMERIC = ("bigint", "int", "double")


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _numeric(types: dict[str, str], exclude=()) -> list[str]:
    return [c for c, t in types.items() if t in NUMERIC and c not in exclude]


def compare_columns(a: str, a_cols: list[str], b: str, b_cols: list[str]) -> str:
    def side(view, cols, s):
        agg = ", ".join(f'count("{c}") AS n_{i}' for i, c in enumerate(cols))
        rows = _union([f"SELECT '{c}' AS column_name, n_{i} AS n FROM agg_{s}" for i, c in enumerate(cols)])
        return f"agg_{s} AS (SELECT {agg} FROM {view}), long_{s} AS ({rows})"
    return f""", {side(a, a_cols, 'a')}, {side(b, b_cols, 'b')}
SELECT coalesce(long_a.column_name, long_b.column_name) AS "column",
  long_a.column_name IS NOT NULL AS in_a, long_b.column_name IS NOT NULL AS in_b,
  long_a.n AS non_null_a, long_b.n AS non_null_b
FROM long_a FULL OUTER JOIN long_b ON long_a.column_name = long_b.column_name"""


def overview(view: str, types: dict[str, str]) -> str:
    cols = list(types)
    agg = ", ".join([f'count("{c}") AS nn_{i}, count(DISTINCT "{c}") AS nd_{i}' for i, c in enumerate(cols)])
    rows = _union([f"SELECT '{c}' AS \"column\", '{types[c]}' AS dtype, n_rows - nn_{i} AS missing_count, "
                   f"nd_{i} AS unique_count, n_rows FROM agg" for i, c in enumerate(cols)])
    return f""", agg AS (SELECT count(*) AS n_rows, {agg} FROM {view})
SELECT "column", dtype, missing_count, {r('missing_count / n_rows', 4)} AS missing_rate,
  unique_count, {r('unique_count / n_rows', 4)} AS unique_rate
FROM ({rows}) AS t"""


def duplicate_summary(view: str, cols: list[str], id_col: str) -> str:
    collist = ", ".join(f'"{c}"' for c in cols)
    return f"""
SELECT CAST(f.n_rows AS BIGINT) AS n_rows, CAST(f.duplicate_rows AS BIGINT) AS duplicate_rows,
  CAST(i.d AS BIGINT) AS duplicate_{id_col}
FROM (SELECT sum(cnt) AS n_rows, sum(cnt - 1) AS duplicate_rows
      FROM (SELECT count(*) AS cnt FROM {view} GROUP BY {collist}) AS g) AS f,
     (SELECT sum(cnt - 1) AS d FROM (SELECT count(*) AS cnt FROM {view} GROUP BY "{id_col}") AS g) AS i"""


def _missing_long(view: str, cols: list[str]) -> str:
    agg = ", ".join(f'count(*) - count("{c}") AS m_{i}' for i, c in enumerate(cols))
    rows = _union([f"SELECT '{c}' AS \"column\", m_{i} AS m, n_rows FROM agg" for i, c in enumerate(cols)])
    return f", agg AS (SELECT count(*) AS n_rows, {agg} FROM {view}), mlong AS ({rows})"


def missing_summary(view: str, cols: list[str]) -> str:
    return _missing_long(view, cols) + f"""
SELECT "column", m AS missing_count, {r('m / n_rows', 4)} AS missing_ratio FROM mlong WHERE m > 0"""


def missing_rate_top_n(view: str, cols: list[str], n: int) -> str:
    return _missing_long(view, cols) + f"""
SELECT "column", {r('m / n_rows', 4)} AS missing_rate FROM mlong WHERE m > 0
ORDER BY missing_rate DESC, "column" LIMIT {n}"""


def missing_rate_table(view: str, cols: list[str], n: int) -> str:
    return _missing_long(view, cols) + f"""
SELECT "column", {r('m / n_rows', 4)} AS missing_rate FROM mlong
ORDER BY missing_rate DESC, "column" LIMIT {n}"""


def constant_columns(view: str, cols: list[str]) -> str:
    agg = ", ".join(f'count(DISTINCT "{c}") AS d_{i}' for i, c in enumerate(cols))
    rows = _union([f"SELECT '{c}' AS \"column\", d_{i} AS d FROM agg" for i, c in enumerate(cols)])
    return f""", agg AS (SELECT {agg} FROM {view})
SELECT "column" FROM ({rows}) AS t WHERE d <= 1"""


def target_summary(view: str, target: str) -> str:
    return f"""
SELECT "{target}" AS value, count(*) AS "count",
  {r('count(*) / sum(count(*)) OVER ()')} AS ratio,
  {r('100.0 * count(*) / sum(count(*)) OVER ()')} AS percentage
FROM {view} GROUP BY "{target}" """


def target_distribution(view: str, target: str) -> str:
    return f"""
SELECT "{target}" AS value, count(*) AS "count", {r('count(*) / sum(count(*)) OVER ()')} AS rate
FROM {view} GROUP BY "{target}" """


PS7 = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def numeric_summary(view: str, types: dict[str, str]) -> str:
    cols = _numeric(types)
    names = ["p1", "p5", "p25", "p50", "p75", "p95", "p99"]
    parts = []
    for c in cols:
        x = f'CAST("{c}" AS DOUBLE)'
        qs = ", ".join(f"{r(f'quantile_cont({x}, {p})')} AS {n}" for p, n in zip(PS7, names))
        parts.append(f"SELECT '{c}' AS \"column\", count({x}) AS \"count\", {r(f'avg({x})')} AS mean, "
                     f"{r(f'stddev_samp({x})')} AS std, {r(f'min({x})')} AS \"min\", {qs}, "
                     f"{r(f'max({x})')} AS \"max\" FROM {view}")
    return "\n" + _union(parts)


def negative_numeric_summary(view: str, types: dict[str, str]) -> str:
    parts = []
    for c in _numeric(types):
        x = f'CAST("{c}" AS DOUBLE)'
        parts.append(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {x} < 0) AS negative_count, "
                     f"{r(f'count(*) FILTER (WHERE {x} < 0) / count(*)')} AS negative_rate, "
                     f"{r(f'min({x})')} AS min_value FROM {view}")
    return f"\nSELECT * FROM ({_union(parts)}) AS t WHERE negative_count > 0"


def categorical_summary(view: str, types: dict[str, str], top_n: int) -> str:
    cols = [c for c, t in types.items() if t not in NUMERIC]
    longs = _union([f"SELECT '{c}' AS feature, CAST(\"{c}\" AS VARCHAR) AS value FROM {view}" for c in cols])
    return f"""
SELECT feature AS "column", value, "count", {r('"count" / n_rows', 4)} AS ratio FROM (
  SELECT feature, value, count(*) AS "count",
    row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value ASC NULLS FIRST) AS rn
  FROM ({longs}) AS l GROUP BY feature, value) AS g,
  (SELECT count(*) AS n_rows FROM {view}) AS n
WHERE rn <= {top_n}"""


def _rate_select(value_cols: str) -> str:
    return (f"feature, {value_cols}, count(*) AS customer_count, "
            f"CAST(sum(t) AS BIGINT) AS default_count, "
            f"{r('avg(CAST(t AS DOUBLE))', 4)} AS default_rate, "
            f"{r('100.0 * avg(CAST(t AS DOUBLE))', 2)} AS default_rate_percentage")


def rate_by_category(view: str, cols: list[str], target: str, max_n: int) -> str:
    longs = _union([f"SELECT '{c}' AS feature, CAST(\"{c}\" AS VARCHAR) AS category_value, "
                    f"\"{target}\" AS t FROM {view}" for c in cols])
    nd = _union([f"SELECT '{c}' AS feature, count(DISTINCT \"{c}\") AS nd FROM {view}" for c in cols])
    return f"""
SELECT {_rate_select('category_value')}
FROM ({longs}) AS l
WHERE feature IN (SELECT feature FROM ({nd}) AS d WHERE nd <= {max_n})
GROUP BY feature, category_value"""


def _fin(c: str) -> str:
    x = f'CAST("{c}" AS DOUBLE)'
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


def binned_rates(view: str, cols: list[str], target: str, n_bins: int, strategy: str) -> str:
    """Edges per column as a list, bin = number of interior edges below x."""
    edge_parts = []
    for c in cols:
        x = _fin(c)
        if strategy == "quantile":
            # linear interpolation written out: (hi_pos - pos) * lo + (pos - lo_pos) * hi, exact on ties
            srt = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
            n = f"count({x})"
            qs = []
            for i in range(n_bins + 1):
                pos = f"({n} - 1) * {i / n_bins}"
                lo, hi = f"{srt}[CAST(floor({pos}) AS BIGINT) + 1]", f"{srt}[CAST(ceil({pos}) AS BIGINT) + 1]"
                qs.append(f"(CASE WHEN {lo} = {hi} THEN {lo} ELSE (ceil({pos}) - {pos}) * {lo} "
                          f"+ ({pos} - floor({pos})) * {hi} END)")
            e = f"list_sort(list_distinct([{', '.join(qs)}]))"
        else:
            pts = ", ".join(f"min({x}) + {k} * ((max({x}) - min({x})) / {n_bins})" for k in range(n_bins))
            e = f"[{pts}, max({x})]"
        edge_parts.append(f"SELECT '{c}' AS feature, {e} AS edges, count(DISTINCT {x}) AS nd FROM {view}")
    edges = _union(edge_parts)
    longs = _union([f"SELECT '{c}' AS feature, {_fin(c)} AS x, \"{target}\" AS t FROM {view}" for c in cols])
    return f""", edges AS (SELECT * FROM ({edges}) AS e WHERE nd > 1),
binned AS (
  SELECT l.feature, t,
    CASE WHEN x IS NULL THEN NULL
         ELSE CAST(len(list_filter(edges[2:len(edges) - 1], lambda v: v < x)) AS INTEGER) END AS bin, edges
  FROM ({longs}) AS l JOIN edges ON l.feature = edges.feature)
SELECT feature, bin,
  {r('CASE WHEN bin IS NULL THEN NULL ELSE any_value(edges)[bin + 1] END')} AS bin_lower,
  {r('CASE WHEN bin IS NULL THEN NULL ELSE any_value(edges)[bin + 2] END')} AS bin_upper,
  count(*) AS customer_count, CAST(sum(t) AS BIGINT) AS default_count,
  {r('avg(CAST(t AS DOUBLE))', 4)} AS default_rate,
  {r('100.0 * avg(CAST(t AS DOUBLE))', 2)} AS default_rate_percentage
FROM binned GROUP BY feature, bin"""


def outlier_summary(view: str, types: dict[str, str], lo: float, hi: float) -> str:
    parts = []
    for c in _numeric(types):
        x = f'CAST("{c}" AS DOUBLE)'
        parts.append(f"""SELECT '{c}' AS "column", {lo} AS lower_quantile, {hi} AS upper_quantile,
  b.lb, b.ub, count(*) FILTER (WHERE {x} < b.lb OR {x} > b.ub) AS outlier_count,
  count(*) FILTER (WHERE {x} < b.lb OR {x} > b.ub) / count(*) AS outlier_rate,
  min({x}) AS min_value, max({x}) AS max_value
FROM {view}, (SELECT quantile_cont({x}, {lo}) AS lb, quantile_cont({x}, {hi}) AS ub FROM {view}) AS b
GROUP BY b.lb, b.ub HAVING b.lb IS NOT NULL""")
    return f"""
SELECT "column", CAST(lower_quantile AS DOUBLE) AS lower_quantile, CAST(upper_quantile AS DOUBLE) AS upper_quantile,
  {r('lb')} AS lower_bound, {r('ub')} AS upper_bound, outlier_count, {r('outlier_rate')} AS outlier_rate,
  {r('min_value')} AS min_value, {r('max_value')} AS max_value
FROM ({_union(parts)}) AS t"""


def _pearson(a: str, b: str) -> str:
    x, y = _fin(a), _fin(b)
    both = f"({x} IS NOT NULL AND {y} IS NOT NULL)"
    xv, yv = f"(CASE WHEN {both} THEN {x} END)", f"(CASE WHEN {both} THEN {y} END)"
    den = f"sqrt(var_samp({xv}) * var_samp({yv}))"
    return f"(CASE WHEN {den} > 0 THEN covar_samp({xv}, {yv}) / {den} END)"


def _pairs_sql(view: str, pairs: list[tuple[str, str]]) -> str:
    agg = ", ".join(f"{_pearson(a, b)} AS r_{i}" for i, (a, b) in enumerate(pairs))
    rows = _union([f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, r_{i} AS r FROM pagg"
                   for i, (a, b) in enumerate(pairs)])
    return f", pagg AS (SELECT {agg} FROM {view}), pairs AS ({rows})"


def correlated_pairs(view: str, types: dict[str, str], target: str, threshold: float) -> str:
    cols = _numeric(types, [target])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return _pairs_sql(view, pairs) + f"""
SELECT feature_1, feature_2, {r('abs(r)')} AS correlation FROM pairs WHERE abs(r) >= {threshold}"""


def _usable(view: str, types: dict[str, str], target: str) -> str:
    cols = _numeric(types, [target])
    return _union([f"SELECT '{c}' AS feature FROM {view} HAVING count(DISTINCT {_fin(c)}) > 1" for c in cols])


def target_correlation(view: str, types: dict[str, str], target: str) -> str:
    cols = _numeric(types, [target])
    return _pairs_sql(view, [(c, target) for c in cols]) + f"""
SELECT feature_1 AS feature, {r('abs(r)')} AS abs_target_correlation FROM pairs
WHERE feature_1 IN ({_usable(view, types, target)})"""


def correlated_pairs_with_target(view: str, types: dict[str, str], target: str, threshold: float) -> str:
    cols = _numeric(types, [target])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    tpairs = [(c, target) for c in cols]
    allp = pairs + tpairs
    # one materialised pass: correlations, and which columns vary
    agg = ", ".join([f"{_pearson(a, b)} AS r_{i}" for i, (a, b) in enumerate(allp)]
                    + [f"min({_fin(c)}) < max({_fin(c)}) AS u_{i}" for i, c in enumerate(cols)])
    rows = _union([f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, r_{i} AS r FROM pagg" for i, (a, b) in enumerate(allp)])
    usable = _union([f"SELECT '{c}' AS feature FROM pagg WHERE u_{i}" for i, c in enumerate(cols)])
    return f""", pagg AS MATERIALIZED (SELECT {agg} FROM {view}), pairs AS ({rows}), usable AS ({usable}),
cp AS (SELECT feature_1, feature_2, {r('abs(r)')} AS correlation FROM pairs
       WHERE feature_2 <> '{target}' AND abs(r) >= {threshold}),
tc AS (SELECT feature_1 AS feature, {r('abs(r)')} AS atc FROM pairs
       WHERE feature_2 = '{target}' AND feature_1 IN (SELECT feature FROM usable))
SELECT cp.feature_1, cp.feature_2, cp.correlation, t1.atc AS feature_1_target_corr,
  t2.atc AS feature_2_target_corr,
  CASE WHEN t1.atc >= t2.atc THEN cp.feature_2 ELSE cp.feature_1 END AS suggested_feature_to_drop
FROM cp LEFT JOIN tc AS t1 ON cp.feature_1 = t1.feature LEFT JOIN tc AS t2 ON cp.feature_2 = t2.feature"""


def correlation_matrix(view: str, types: dict[str, str], exclude=()) -> str:
    cols = _numeric(types, exclude)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return _pairs_sql(view, pairs) + f"""
SELECT feature_1, feature_2, {r('r')} AS correlation FROM pairs
UNION ALL
SELECT feature_2 AS feature_1, feature_1 AS feature_2, {r('r')} AS correlation FROM pairs
WHERE feature_1 <> feature_2"""


def boxplot_stats(view: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f'CAST("{c}" AS DOUBLE)'
        parts.append(f"""SELECT '{c}' AS "column", q.q1, q.med, q.q3,
  min(CASE WHEN {x} >= q.q1 - 1.5 * (q.q3 - q.q1) THEN {x} END) AS lw,
  max(CASE WHEN {x} <= q.q3 + 1.5 * (q.q3 - q.q1) THEN {x} END) AS uw,
  count(*) FILTER (WHERE {x} < q.q1 - 1.5 * (q.q3 - q.q1) OR {x} > q.q3 + 1.5 * (q.q3 - q.q1)) AS o
FROM {view}, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med,
                     quantile_cont({x}, 0.75) AS q3 FROM {view}) AS q
GROUP BY q.q1, q.med, q.q3""")
    return f"""
SELECT "column", {r('q1')} AS q1, {r('med')} AS median, {r('q3')} AS q3, {r('q3 - q1')} AS iqr,
  {r('lw')} AS lower_whisker, {r('uw')} AS upper_whisker, o AS outlier_count
FROM ({_union(parts)}) AS t"""


def duplicated_rows(view: str, cols: list[str], keys: list[str]) -> str:
    allc = ", ".join(f'"{c}" ASC NULLS FIRST' for c in cols)
    part = ", ".join(f'"{k}"' for k in keys)
    sel = ", ".join(f'"{c}"' for c in cols)
    return f"""
SELECT {sel} FROM (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {allc}) AS rn FROM {view}) AS t
WHERE rn > 1"""


SPREAD = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
SPREAD_NAMES = ["q000", "q001", "q025", "q050", "q075", "q099", "q100"]


def quantile_spread(view: str, types: dict[str, str], top: int, exclude=()) -> str:
    parts = []
    for c in _numeric(types, exclude):
        x = f'CAST("{c}" AS DOUBLE)'
        qs = ", ".join(f"quantile_cont({x}, {p}) AS {n}" for p, n in zip(SPREAD, SPREAD_NAMES))
        parts.append(f"SELECT '{c}' AS \"column\", {qs} FROM {view}")
    qcols = ", ".join(f"{r(n)} AS {n}" for n in SPREAD_NAMES)
    return f"""
SELECT "column", {qcols}, {r('q075 - q025')} AS iqr, {r('q100 - q000')} AS "range",
  {r('(q100 - q000) / nullif(q075 - q025, 0)')} AS range_to_iqr_ratio
FROM ({_union(parts)}) AS t
ORDER BY range_to_iqr_ratio DESC NULLS LAST, "column" LIMIT {top}"""
