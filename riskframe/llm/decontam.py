"""Benchmark decontamination: BM25 block-max WAND, then question and answer overlap.

Test items are cut into parts of at most ``PART`` words and indexed; a posting
holds the part's BM25 impact for a word divided by the part's own score, so a
passage that holds a whole part scores 1 on it.  A training passage is two
neighbouring runs of ``PART`` words, and runs overlap by one, so any part lies
whole in some passage.  Every passage is a query; all parts of score
``threshold`` or more are retrieved:

1. for all passages of a text in one numpy step, maxima over large blocks of
   parts (``COLUMNS`` of them) are added up; a passage that stays below the
   threshold in every block is left;
2. the others add up the maxima of small blocks and skip those below;
3. in the blocks left, scores are exact.

A retrieved item counts when runs of five words or more that it shares with the
passage cover at least ``overlap`` of its question and either as much of its
answer or nearly the whole item.  A last sentence that is cut or changed in one
word often shares no run, so an answer is also covered by the last quarter of
the item (five words at least), and nearly the whole means that at most a fifth
of the item, or five words, is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import words_of

SENTENCE = re.compile(r"(?<=[.!?])\s+")
PART, BLOCK, RUN, COLUMNS = 64, 4, 5, 64
K1, B = 1.2, 0.75
#: shares of an item: the least answer, and what a copy of nearly the whole may leave out
QUARTER, LEFT_OUT = 0.25, 0.2
#: items in one index; more items are searched in several passes
MAX_ITEMS = 50_000
FOUND = "array<struct<item_id:long,passage:long,score:double,question_overlap:double,answer_overlap:double>>"


def split_item(text: str) -> tuple[list[str], int]:
    """The words of an item and how many of them are the question (the answer is the last sentence, or the last quarter of a single one)."""
    words = words_of(text)
    last = words_of(SENTENCE.split(text.strip())[-1])
    question = len(words) - len(last)
    if question <= 0:
        question = len(words) - max(1, len(words) // 4)
    return words, max(question, 0)


class ItemIndex:
    """Block-max inverted index of the items' parts."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, overlap: float):
        self.threshold, self.overlap = threshold, overlap
        split = [(i, *split_item(t)) for i, t in items]
        self.items = [(i, words, q) for i, words, q in split if words]
        vocab: dict[str, int] = {}
        parts = []
        for n, (_, words, _) in enumerate(self.items):
            for word in words:
                vocab.setdefault(word, len(vocab) + 1)
            for at in range(0, len(words), PART):
                # a short rest goes with the words before it
                parts.append((n, words[max(0, min(at, len(words) - PART)):at + PART]))
        self.vocab, self.n_parts = vocab, len(parts)
        self.part_item = np.array([n for n, _ in parts], dtype=np.int64)
        df = Counter(w for _, words in parts for w in set(words))
        mean = sum(len(w) for _, w in parts) / max(1, len(parts))
        posts = defaultdict(list)
        for p, (_, words) in enumerate(parts):
            tf = Counter(words)
            imp = {w: math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean))
                   for w, c in tf.items()}
            own = sum(imp.values())
            for w, x in imp.items():
                posts[vocab[w]].append((p, x / own))
        size = len(vocab) + 1
        self.start = np.zeros(size + 1, dtype=np.int64)
        for t in range(1, size):
            self.start[t + 1] = self.start[t] + len(posts[t])
        flat = [x for t in range(1, size) for x in posts[t]]
        self.post_part = np.array([p for p, _ in flat], dtype=np.int64)
        self.post_impact = np.array([x for _, x in flat], dtype=np.float64)
        block_rows = []
        # columns of the first bound: one column is the maximum over so many neighbouring parts
        self.wide = max(1, -(-len(parts) // COLUMNS))
        self.columns = np.zeros((size, max(1, -(-len(parts) // self.wide))), dtype=np.float32)
        for t in range(1, size):
            top: dict[int, float] = {}
            for p, x in posts[t]:
                top[p // BLOCK] = max(top.get(p // BLOCK, 0.0), x)
                self.columns[t, p // self.wide] = max(self.columns[t, p // self.wide], x)
            block_rows.append(sorted(top.items()))
        self.block_start = np.concatenate([[0, 0], np.cumsum([len(r) for r in block_rows])]).astype(np.int64)
        self.block_id = np.array([b for r in block_rows for b, _ in r], dtype=np.int64)
        self.block_max = np.array([x for r in block_rows for _, x in r], dtype=np.float64)
        self.item_ids = [np.array([vocab[w] for w in words], dtype=np.int64) for _, words, _ in self.items]

    def _gather(self, start, terms):
        n = start[terms + 1] - start[terms]
        return np.repeat(start[terms] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    def retrieve(self, ids: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of every item with a part of score ``threshold`` or more for a passage's word numbers."""
        terms = np.unique(ids[ids > 0])
        if not len(terms):
            return []
        at = self._gather(self.block_start, terms)
        bound = np.bincount(self.block_id[at], self.block_max[at], minlength=self.n_parts // BLOCK + 1)
        alive = bound >= self.threshold - 1e-9
        if not alive.any():
            return []
        at = self._gather(self.start, terms)
        at = at[alive[self.post_part[at] // BLOCK]]
        score = np.bincount(self.post_part[at], self.post_impact[at], minlength=self.n_parts)
        found: dict[int, float] = {}
        for p in np.nonzero(score >= self.threshold - 1e-9)[0]:
            n = int(self.part_item[p])
            found[n] = max(found.get(n, 0.0), float(score[p]))
        return sorted(found.items())

    def overlaps(self, ids: np.ndarray, item: int) -> tuple[float, float, bool]:
        """Shares of the item's question and answer that lie in runs shared with the passage; whether nearly the whole item does."""
        own, q = self.item_ids[item], self.items[item][2]
        n = min(RUN, len(own))
        grams = {tuple(x) for x in np.lib.stride_tricks.sliding_window_view(ids, n).tolist()} if len(ids) >= n else set()
        hit = np.zeros(len(own), dtype=bool)
        for k, gram in enumerate(np.lib.stride_tricks.sliding_window_view(own, n).tolist()):
            if tuple(gram) in grams:
                hit[k:k + n] = True
        least = min(len(own), max(RUN, math.ceil(len(own) * QUARTER)))
        answer = float(max(hit[q:].mean(), hit[-least:].mean()))
        whole = bool((~hit).sum() <= max(RUN, LEFT_OUT * len(own)) and hit.mean() >= self.overlap)
        return (float(hit[:q].mean()) if q else answer), answer, whole

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        """For each run of ``PART`` words, the most that its words give to any part of each column."""
        runs = np.sort(ids.reshape(-1, PART), axis=1)
        runs[:, 1:][runs[:, 1:] == runs[:, :-1]] = 0
        out, ones = np.empty((len(runs), self.columns.shape[1]), dtype=np.float32), np.ones((1, PART), dtype=np.float32)
        for at in range(0, len(runs), 256):
            out[at:at + 256] = (ones @ self.columns.take(runs[at:at + 256], axis=0))[:, 0]
        return out

    def search_text(self, text: str) -> list[dict]:
        """The items found in a text, each with its best passage."""
        get = self.vocab.get
        words = words_of(text)
        ids = np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words))
        if not len(ids) or not self.items:
            return []
        padded = np.zeros(-(-len(ids) // PART) * PART, dtype=np.int32)
        padded[:len(ids)] = ids
        bound = self.bounds(padded)
        if len(bound) > 1:
            bound = bound[:-1] + bound[1:]
        best: dict[int, dict] = {}
        for at in np.nonzero(bound.max(axis=1) >= self.threshold - 1e-4)[0]:
            from_word = int(at) * PART
            for item, score in self.retrieve(ids[from_word:from_word + 2 * PART]):
                wide = len(self.item_ids[item])
                question, answer, whole = self.overlaps(ids[max(0, from_word - wide):from_word + 2 * PART + wide], item)
                i = self.items[item][0]
                if question >= self.overlap and (answer >= self.overlap or whole) and (i not in best or score > best[i]["score"]):
                    best[i] = {"item_id": i, "passage": from_word, "score": score,
                               "question_overlap": question, "answer_overlap": answer}
        return [best[i] for i in sorted(best)]


def _indexes(items: DataFrame, threshold: float, overlap: float) -> list[ItemIndex]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    passes = max(1, math.ceil(rows.count() / MAX_ITEMS))
    return [ItemIndex(sorted((r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).distinct().collect()), threshold, overlap)
            for n in range(passes)]


def _searcher(index: ItemIndex):
    @F.pandas_udf(FOUND)
    def search(text: pd.Series) -> pd.Series:
        return text.fillna("").map(index.search_text)
    return search


def with_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5) -> DataFrame:
    """(doc, leaks): every row of ``docs`` as a struct and the items found in its whole text.

    ``docs`` needs a text column; null and empty texts have no leaks.
    ``items`` has (item_id, text); items without a word and null ids take no
    part.  The index is at most ``MAX_ITEMS`` items large; larger tables of
    items are searched in several indexes.  Empty tables give empty results.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    found = []
    for n, index in enumerate(_indexes(items, threshold, overlap)):
        rows = rows.withColumn(f"leaks{n}", _searcher(index)(F.col("doc.text")))
        found.append(F.col(f"leaks{n}"))
    return rows.select("doc", (F.concat(*found) if len(found) > 1 else found[0]).alias("leaks"))


def leak_report(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap): one row per document and item found in it."""
    return (with_leaks(docs.select("doc_id", "text"), items, threshold, overlap)
            .select(F.col("doc.doc_id").alias("doc_id"), F.explode("leaks").alias("x")).select("doc_id", "x.*"))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    return with_leaks(docs, items, threshold, overlap).where(F.size("leaks") == 0).select("doc.*")
