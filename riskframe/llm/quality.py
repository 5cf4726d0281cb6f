"""Quality classifier: a sparse ensemble of rules over text statistics.

The statistics of a text are Spark column expressions.  A random forest is
grown on a bounded sample of labelled documents; every path from a root is a
conjunction of threshold tests, that is a rule.  A lasso logistic regression
over the rules keeps few of them, and these are compiled into one column
expression, so scoring is a single pass without Python.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, held_out, labelled_sample

#: bounds of the fit: labelled documents, trees, depth, lasso penalty
EXAMPLES, TREES, DEPTH, PENALTY = 8_000, 16, 3, 0.001
_NODE = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)")


def _share(text: Column, pattern: str) -> Column:
    """Share of the characters that match."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(F.lit(0.0))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; those of an empty text are 0."""
    n = F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    k = F.size(words)

    def over(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(F.lit(0.0)).cast("double")

    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(k.cast("double")),
        "letters": _share(text, r"\p{L}+"),
        "capitals": _share(text, r"\p{Lu}+"),
        "digits": _share(text, r"[0-9]+"),
        "marks": _share(text, r"[!?*#$%&|<>{}=~^+]+"),
        "stops": _share(text, r"[.,;:]+"),
        "space": _share(text, r"\s+"),
        "word_length": over(F.length(F.regexp_replace(text, r"\s+", "")), k),
        "new_words": over(F.size(F.array_distinct(words)), k),
        "new_lines": over(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_per_line": over(k, F.size(lines)),
    }


def with_statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    base = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    stats = statistics(F.col("text"))
    return base.select(*[c for c in base.columns if c != "text"], *[v.alias(k) for k, v in stats.items()])


def rules_of(debug: str) -> list[tuple[tuple[int, str, float], ...]]:
    """All paths from a root in a forest's description, each rule once, in a fixed order."""
    found, path = set(), []
    for line in debug.splitlines():
        if line.strip().startswith("Tree"):
            path = []
        if m := _NODE.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[3]), m[4], float(m[5])))]
            found.add(tuple(sorted({test for _, test in path})))
    return sorted(found)


def rule_column(rule: tuple[tuple[int, str, float], ...], names: list[str]) -> Column:
    tests = [(F.col(names[f]) <= v) if op == "<=" else (F.col(names[f]) > v) for f, op, v in rule]
    return reduce(lambda a, b: a & b, tests)


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0) -> tuple[float, list[tuple[float, tuple]]]:
    """(intercept, [(weight, rule)]) from at most ``EXAMPLES`` labelled documents outside the held-out fold.

    With one class, or none, in the sample there are no rules and the
    intercept is the log odds of the smoothed rate.
    """
    names = list(statistics(F.lit("")))
    sample = labelled_sample(docs, labels, "quality", parts, rest, EXAMPLES)
    # the sample is bounded; one partition in a fixed order makes the fit repeatable
    table = cut(with_statistics(sample, F.col("doc_id"), F.col("y").cast("double").alias("y")).orderBy("doc_id").coalesce(1))
    n, good = table.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, good = n or 0, good or 0.0
    rate = (good + 0.5) / (n + 1.0)
    base = math.log(rate / (1 - rate))
    if n < 10 or good in (0, n):
        return base, []
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(table)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=7,
                                    featureSubsetStrategy="0.5", minInstancesPerNode=5).fit(vectors)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return base, []
    on = cut(table.select("y", F.array(*[rule_column(r, names).cast("double") for r in rules]).alias("rules")).coalesce(1))
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, maxIter=60,
                               standardization=False).fit(on.select("y", array_to_vector("rules").alias("x")))
    kept = [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules) if w != 0.0]
    return float(lasso.intercept), kept


def score_column(model: tuple[float, list[tuple[float, tuple]]]) -> Column:
    names = list(statistics(F.lit("")))
    z = F.lit(model[0])
    for weight, rule in model[1]:
        z = z + F.when(rule_column(rule, names), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null texts are scored as empty ones.  Needs doc_id and text; other columns
    are ignored; repeated rows are scored alike.  An empty table gives an
    empty result.
    """
    model = fit(docs, labels)
    rows = with_statistics(docs.select("doc_id", "text"), F.col("doc_id"))
    out = rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
