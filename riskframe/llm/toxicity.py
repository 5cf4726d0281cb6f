"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are the words of a text and their first four and five letters.  From a
bounded sample of labelled documents, the terms that tell the classes apart
(chi-square and lift) make the vocabulary; each example is a TF-IDF vector over
it.  The inverted index keeps postings by term in blocks of examples with the
block's largest weight; a search visits blocks by falling upper bound until the
bound is below the k-th best cosine, so the k nearest examples are exact.
Votes weighted by cosine are calibrated on the sample itself, each example
searched without itself.  A text without any vocabulary term gets the rate of
such texts in the sample.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, held_out, labelled_sample, words_of

#: bounds of the fit: labelled documents, vocabulary terms
EXAMPLES, VOCABULARY = 4_000, 2_000
NEIGHBOURS, BLOCK = 15, 64
#: lengths of word starts that are terms
STARTS = (4, 5)
#: a term needs places, significance (chi-square), strength (chi-square over documents) and a lift
MIN_PLACES, MIN_CHI2, MIN_PHI2, MIN_LIFT = 3, 10.0, 0.01, 4.0
CHECKED = 1_500
SCORED = "struct<score:double,evidence:array<struct<doc_id:long,similarity:double,label:int>>>"


def terms_of(text: str) -> dict[str, tuple[int, int]]:
    """Of the words and their first four and five letters: count and a hash of the words around the first one."""
    words = ["", *words_of(text), ""]
    out: dict[str, tuple[int, int]] = {}
    for at in range(1, len(words) - 1):
        word = words[at]
        for term in (word, *(f"{n}:{word[:n]}" for n in STARTS if len(word) > n)):
            if term in out:
                out[term] = (out[term][0] + 1, out[term][1])
            else:
                out[term] = (1, zlib.crc32(f"{words[at - 1]} {words[at + 1]}".encode()))
    return out


class NearestExamples:
    """Block-max inverted index over the examples' unit vectors."""

    def __init__(self, vocab: list[tuple[str, float]], examples: list[tuple[int, int, dict[int, float]]], empty: tuple[int, int]):
        self.term = {w: i for i, (w, _) in enumerate(vocab)}
        self.starts = [(n, {w[2:] for w, _ in vocab if w.startswith(f"{n}:")}) for n in STARTS]
        self.idf = np.array([x for _, x in vocab], dtype=np.float64)
        rows = [(i, y, *self._unit(tf)) for i, y, tf in examples]
        # examples with the same strongest term are neighbours, so that block maxima are tight
        rows.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), r[0]))
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.y = np.array([r[1] for r in rows], dtype=np.int64)
        self.rows = [(r[2], r[3]) for r in rows]
        self.blocks = -(-len(rows) // BLOCK)
        self.block_max = np.zeros((len(vocab), max(1, self.blocks)), dtype=np.float64)
        self.postings = []  # of each block: the place of a term in it (-1: none), the weights of its terms by example
        for n in range(self.blocks):
            own = self.rows[n * BLOCK:(n + 1) * BLOCK]
            terms = np.unique(np.concatenate([t for t, _ in own]))
            place = np.full(len(vocab), -1, dtype=np.int32)
            place[terms] = np.arange(len(terms))
            weights = np.zeros((len(terms), BLOCK))
            for e, (t, w) in enumerate(own):
                weights[place[t], e] = w
            self.block_max[terms, n] = weights.max(axis=1)
            self.postings.append((place, weights))
        self.empty = (empty[1] + 0.5 * self._base()) / (empty[0] + 0.5)
        self.platt = (0.0, 0.0)
        self._calibrate()

    def _base(self) -> float:
        return (self.y.sum() + 0.01) / (len(self.y) + 1.0)

    def _unit(self, tf: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(tf), dtype=np.int64)
        w = (1.0 + np.log([tf[i] for i in t])) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (equal ones in index order), example ``but`` left out."""
        bound = w @ self.block_max[t]
        best_e, best_s = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best_s) == k and bound[b] < best_s[-1] - 1e-12):
                break
            low, (place, weights) = b * BLOCK, self.postings[b]
            at = place[t]
            score = w[at >= 0] @ weights[at[at >= 0]]
            if low <= but < low + BLOCK:
                score[but - low] = 0.0
            hit = np.nonzero(score > 0)[0]
            e, s = np.concatenate([best_e, hit + low]), np.concatenate([best_s, score[hit]])
            top = np.lexsort((e, -np.round(s, 12)))[:k]
            best_e, best_s = e[top], s[top]
        return best_e, best_s

    def _vote(self, e: np.ndarray, s: np.ndarray) -> float:
        return float((s * self.y[e]).sum() / s.sum())

    def _calibrate(self) -> None:
        """Logistic curve of the vote, fitted on at most ``CHECKED`` examples searched without themselves."""
        step = max(1, len(self.rows) // CHECKED)
        x, y = [], []
        for n in range(0, len(self.rows), step):
            e, s = self.nearest(*self.rows[n], NEIGHBOURS, but=n)
            if len(e):
                x.append(self._vote(e, s))
                y.append(self.y[n])
        x, y = np.array([*x, 0.0, 1.0]), np.array([*y, 0.0, 1.0])
        design, beta = np.stack([np.ones_like(x), x - 0.5], axis=1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            grad = design.T @ (p - y) + 0.05 * beta
            hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
            beta = beta - np.clip(np.linalg.solve(hess, grad), -2, 2)
        self.platt = (float(beta[0]), float(beta[1]))

    def score(self, text: str) -> dict:
        counts, tf = Counter(words_of(text)), Counter()
        for word in counts.keys() & self.term.keys():
            tf[self.term[word]] += counts[word]
        for size, known in self.starts:
            if {word[:size] for word in counts} & known:
                for word, n in counts.items():
                    if len(word) > size and word[:size] in known:
                        tf[self.term[f"{size}:{word[:size]}"]] += n
        if tf:
            e, s = self.nearest(*self._unit(tf), NEIGHBOURS)
            if len(e):
                z = self.platt[0] + self.platt[1] * (self._vote(e, s) - 0.5)
                return {"score": float(1 / (1 + np.exp(-z))),
                        "evidence": [{"doc_id": int(self.ids[i]), "similarity": float(x), "label": int(self.y[i])} for i, x in zip(e, s)]}
        return {"score": float(self.empty), "evidence": []}


def _sparse_terms(frames):
    for frame in frames:
        rows = [(i, y, w, n, place) for i, text, y in zip(frame["doc_id"], frame["text"], frame["y"])
                for w, (n, place) in terms_of(text).items()]
        yield pd.DataFrame(rows, columns=["doc_id", "y", "term", "n", "place"])


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, rest: int = 2) -> NearestExamples:
    """Fit on at most ``EXAMPLES`` labelled documents outside the held-out fold.

    Term statistics are aggregated on the cluster; at most ``VOCABULARY``
    terms and the sample's vectors over them come to the driver.
    """
    sample = cut(labelled_sample(docs, labels, "toxic", parts, rest, EXAMPLES).dropDuplicates(["doc_id"]))
    terms = cut(sample.mapInPandas(_sparse_terms, "doc_id long, y int, term string, n int, place long"))
    total, toxic = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    total, toxic = total or 0, toxic or 0
    clean = total - toxic
    a, n = F.col("a").cast("double"), F.col("df").cast("double")
    b = n - a
    lift = ((a + 0.5) / F.lit(toxic + 1.0)) / ((b + 0.5) / F.lit(clean + 1.0))
    chi2 = F.lit(float(total)) * F.pow(a * F.lit(float(clean)) - b * F.lit(float(toxic)), F.lit(2.0)) / (
        n * F.greatest(F.lit(float(total)) - n, F.lit(0.5)) * F.lit(max(1.0, float(toxic * clean))))
    # distinct places instead of documents: what only the copies of one text share counts once
    vocab = (terms.groupBy("term", "place").agg(F.max("y").alias("y"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("a"))
             .where((F.col("df") >= MIN_PLACES) & (chi2 >= max(MIN_CHI2, MIN_PHI2 * total)) & ((lift >= MIN_LIFT) | (lift <= 1 / MIN_LIFT)))
             .orderBy(chi2.desc(), "term").limit(VOCABULARY).select("term", "df").collect())
    words = [(r["term"], float(np.log((1 + total) / (1 + r["df"])) + 1)) for r in sorted(vocab, key=lambda r: r["term"])]
    number = {w: i for i, (w, _) in enumerate(words)}
    rows: dict[tuple[int, int], dict[int, float]] = {}
    if number:
        for r in terms.where(F.col("term").isin(list(number))).select("doc_id", "y", "term", "n").collect():
            rows.setdefault((r["doc_id"], r["y"]), {})[number[r["term"]]] = r["n"]
    known = [(i, y, tf) for (i, y), tf in sorted(rows.items())]
    return NearestExamples(words, known, (total - len(known), toxic - sum(y for _, y, _ in known)))


def with_score(docs: DataFrame, model: NearestExamples) -> DataFrame:
    """(doc, score, evidence): every row as a struct, its toxicity in [0, 1], its nearest examples."""
    @F.pandas_udf(SCORED)
    def score(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.score(t) for t in text.fillna("")], columns=["score", "evidence"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.withColumn("x", score(F.col("doc.text"))).select("doc", "x.score", "x.evidence")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document.

    Null and empty texts count as texts without a vocabulary term.  Without
    labelled documents every score is near 0.  Columns other than doc_id and
    text are ignored; repeated rows are scored alike.
    """
    rows = docs.select("doc_id", "text")
    out = with_score(rows, fit(docs, labels))
    return out.select(F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id"), 4, 2).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    model = fit(docs if learn_from is None else learn_from, labels)
    return with_score(docs, model).where(F.col("score") < threshold).select("doc.*")
