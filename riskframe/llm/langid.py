"""Language identification by a byte convolutional network.

Windows of ``WINDOW`` bytes of the lower-case UTF-8 text go through filters of
several widths over byte embeddings, max pooling over the window and a softmax.
The network is trained in numpy on windows of a bounded sample of labelled
documents.  For scoring, embedding and filter are multiplied out to one table
per filter offset, and all windows of a text are scored in blocks; the text's
language is that of the largest mean log probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, held_out

#: bounds of the fit: documents, windows of each, training steps
EXAMPLES, WINDOWS_EACH, STEPS, BATCH = 3_000, 3, 300, 64
WINDOW, WIDTHS, FILTERS, EMBEDDING = 128, (2, 3, 4), 16, 8
RATE = 0.01


def window_bytes(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes of the whole text, the last one filled up with 0."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(-(-len(raw) // WINDOW) * WINDOW, dtype=np.uint8)
    out[:len(raw)] = raw
    return out.reshape(-1, WINDOW)


class ByteNet:
    """The trained network: languages, one (offset, byte, filter) table per width, and the softmax layer."""

    def __init__(self, langs: list[str], windows: np.ndarray, y: np.ndarray):
        self.langs = langs
        rng = np.random.default_rng(11)
        p = {"e": rng.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            p[f"f{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            p[f"b{w}"] = np.zeros(FILTERS)
        p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs)))
        p["c"] = np.zeros(len(langs))
        p = {k: v.astype(np.float32) for k, v in p.items()}
        if len(langs) > 1 and len(y):
            count = np.bincount(y, minlength=len(langs))
            chance = 1.0 / np.maximum(count, 1)[y]  # every language equally often
            chance = chance / chance.sum()
            m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
            for step in range(1, STEPS + 1):
                pick = rng.choice(len(y), BATCH, p=chance)
                for k, g in self._gradient(p, windows[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    rate = RATE * (1 - 0.9 * step / STEPS)
                    p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)
        self.tables = {w: np.stack([p["e"] @ p[f"f{w}"][i * EMBEDDING:(i + 1) * EMBEDDING] for i in range(w)]) for w in WIDTHS}
        self.bias = {w: p[f"b{w}"] for w in WIDTHS}
        self.out, self.shift = p["o"], p["c"]

    @staticmethod
    def _gradient(p: dict, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradient of the mean cross entropy."""
        n, e = len(x), p["e"][x]
        pooled, saved = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, i:WINDOW - w + 1 + i] for i in range(w)], axis=2)
            z = cols @ p[f"f{w}"] + p[f"b{w}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
            pooled.append(np.maximum(top, 0))
            saved.append((cols, at, top > 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ p["o"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"o": h.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = q @ p["o"].T
        for j, w in enumerate(WIDTHS):
            cols, at, on = saved[j]
            d = dh[:, j * FILTERS:(j + 1) * FILTERS] * on
            picked = np.take_along_axis(cols, at[:, :, None], axis=1)  # (n, FILTERS, w * EMBEDDING)
            g[f"f{w}"] = np.einsum("nf,nfd->df", d, picked)
            g[f"b{w}"] = d.sum(axis=0)
            de = d[:, :, None] * p[f"f{w}"].T[None]
            for i in range(w):
                byte = np.take_along_axis(x, at + i, axis=1)
                np.add.at(g["e"], byte.ravel(), de[:, :, i * EMBEDDING:(i + 1) * EMBEDDING].reshape(-1, EMBEDDING))
        return g

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), dtype=np.float32)
        for at in range(0, len(windows), 64):
            x = windows[at:at + 64].astype(np.intp)
            h = []
            for w in WIDTHS:
                z = self.tables[w][0].take(x[:, :WINDOW - w + 1], axis=0)
                for i in range(1, w):
                    z += self.tables[w][i].take(x[:, i:WINDOW - w + 1 + i], axis=0)
                h.append(np.maximum(z.max(axis=1) + self.bias[w], 0))
            z = np.concatenate(h, axis=1) @ self.out + self.shift
            z -= z.max(axis=1, keepdims=True)
            out[at:at + 64] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; a text without a letter is ``und`` with score 0."""
        found: list = [("und", 0.0)] * len(texts)
        if not self.langs:
            return found
        held, owner = [], []
        for n, text in enumerate(texts):
            if any(map(str.isalpha, text)):
                held.append(window_bytes(text))
                owner.append(n)
        if held:
            logs = self.log_probabilities(np.concatenate(held))
            start = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            mean = np.add.reduceat(logs.astype(np.float64), start, axis=0) / np.array([len(h) for h in held])[:, None]
            q = np.exp(mean - mean.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            for n, k, s in zip(owner, q.argmax(axis=1), q.max(axis=1)):
                found[n] = (self.langs[k], float(s))
        return found


def _samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"]):
            if any(map(str.isalpha, text)):
                windows = window_bytes(text)
                seed = zlib.crc32(str(doc_id).encode())
                for k in {(seed + k * len(windows) // WINDOWS_EACH) % len(windows) for k in range(WINDOWS_EACH)}:
                    rows.append((int(doc_id), int(k), lang, windows[k].tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "k", "lang", "window"])


def fit(docs: DataFrame, parts: int = 3, rest: int = 1) -> ByteNet:
    """Train on at most ``WINDOWS_EACH`` windows of at most ``EXAMPLES`` documents outside the held-out fold."""
    known = docs.select("doc_id", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), parts, rest))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    sample = (docs.select("doc_id", "lang", "text").where("lang is not null and text is not null")
              .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))
    rows = cut(sample.mapInPandas(_samples, "doc_id long, k int, lang string, window binary")).toPandas()
    rows = rows.sort_values(["doc_id", "k"])
    langs = sorted(rows["lang"].unique().tolist())
    number = {lang: i for i, lang in enumerate(langs)}
    windows = np.frombuffer(b"".join(map(bytes, rows["window"])), dtype=np.uint8).reshape(-1, WINDOW)
    return ByteNet(langs, windows.astype(np.intp), rows["lang"].map(number).to_numpy(dtype=np.int64))


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    ``lang_pred`` is a learned language, or ``und`` for a null text or one
    without a letter; without any labelled document all are ``und``.  Needs
    doc_id, text, lang; other columns are ignored; repeated rows are treated
    alike.  An empty table gives an empty result.
    """
    net = fit(docs)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(text: pd.Series) -> pd.DataFrame:
        texts, found = text.fillna("").tolist(), []
        at = 0
        while at < len(texts):  # blocks of about a megabyte of text
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
                size += len(texts[end])
                end += 1
            found += net.predict(texts[at:end])
            at = end
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    rows = docs.select("doc_id", "text").withColumn("x", predict("text"))
    return rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "x.lang_pred", "x.score")
