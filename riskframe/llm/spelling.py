"""Spelling variants: words of the corpus one edit apart, by a bit-sliced position index.

Words are counted in one pass over whole texts; those of at least five letters
and three occurrences are the vocabulary.  Each word is looked up in an index
that holds, for every position and letter, the set of index words with that
letter there, one bit a word.  Going through the letters of a word, three
sets move on together, each by a few word-parallel operations:

* ``zero``, the index words equal so far,
* ``one``, those with one error so far,

where an error shifts the position read in the index: index words of the same
length have the letter replaced (no shift), longer ones one letter more (read
one position on), shorter ones one letter less (read one position back).

Words one edit apart share their first two letters or their last three, since
an edit after the first letter but one leaves the beginning whole, and any
earlier one leaves at least three letters at the end.  So the vocabulary is
dealt into cells by these letters, at most 90^2 + 90^3 of them as there are 90
letters at most beside the upper-case ASCII ones; pairs that share both count
in the cell of the first letters only.  Small cells are packed, by a hash, into
indexes of a bounded number of letters, which keep a bit set of each cell; a
large cell is dealt into chunks, and each chunk of words is looked up in the
index of each chunk.  A task returns one row for a word: number and best of its
near words there, never the pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut

#: least letters of a word, least occurrences, and how much more frequent a word's form is
LETTERS, PLACES, TIMES = 5, 3, 2
#: a run loses a letter where this divides its checksum
MODULUS = 97
#: letters of a word that make its cells
FIRST, LAST = 2, 3
#: letters of an index (a chunk of a cell, or a pack of cells), on average
CHUNK = 1 << 16
#: words looked up at a time, positions of an index that are kept ready
BLOCK, READY = 256, 64
#: different words counted before a task hands them on
FLUSH = 200_000


def _alphabet() -> bytes:
    """Latin-1 bytes: letters as they are, ASCII upper case lowered, everything else a space."""
    letter = [65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 for c in range(256)]
    return bytes((c + 32 if 65 <= c <= 90 else c) if letter[c] else 32 for c in range(256))


_LETTERS = _alphabet()


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text in Latin-1; no character beyond U+00FF is a letter."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: Counter = Counter()

    def out() -> pd.DataFrame:
        frame = pd.DataFrame({"word": [w.decode("latin-1") for w in found], "n": list(found.values())}).astype({"n": "int64"})
        found.clear()
        return frame

    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            if text:
                start = zlib.crc32(f"{doc_id}:".encode() if doc_id is not None else b":")
                for run, n in Counter(runs(text)).items():
                    if len(run) >= LETTERS:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % MODULUS == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < LETTERS:
                                continue
                        found[run] += n
                if len(found) > FLUSH:
                    yield out()
    if found:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of at least five letters and three occurrences."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (rows.mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= PLACES))


class PositionIndex:
    """Words in order of preference, as a bit set for every position and letter, length, and cell."""

    def __init__(self, words: list[bytes], cells: list[str]):
        self.size, self.width = len(words), -(-len(words) // 64)
        self._letters = np.frombuffer(b"".join(words), np.uint8)
        self._length = np.fromiter(map(len, words), np.int64, len(words))
        self._start = np.cumsum(self._length) - self._length
        self._of_length = self._sets(self._length, np.arange(self.size))
        self._of_cell = self._sets(np.array(cells, dtype=object), np.arange(self.size))
        self._at = lru_cache(READY)(self._position)

    def _sets(self, kinds: np.ndarray, words: np.ndarray) -> dict:
        """A bit set of the words of each kind."""
        names, kind = np.unique(kinds, return_inverse=True)
        bits = np.zeros((len(names), self.width * 64), np.uint8)
        bits[kind, words] = 1
        return dict(zip(names.tolist(), np.packbits(bits, axis=1).view(np.uint64)))

    def _position(self, i: int) -> np.ndarray:
        """For each letter (256 rows) the words that have it at position ``i``."""
        there = np.nonzero(self._length > i)[0]
        out = np.zeros((256, self.width), np.uint64)
        for letter, bits in self._sets(self._letters[self._start[there] + i], there).items():
            out[letter] = bits
        return out

    def one_error(self, words: list[bytes], cells: list[str], apart: int) -> np.ndarray:
        """For each word the index words of its cell that are one edit away.

        ``words`` come in falling order of length.  With ``apart``, index
        words that share so many first letters are left out.
        """
        shape = (len(words), self.width)
        length = np.fromiter(map(len, words), np.int64, len(words))
        zero = np.full(shape, ~np.uint64(0))
        replaced, longer, shorter = (np.zeros(shape, np.uint64) for _ in range(3))
        begin = zero
        for i in range(length[0]):
            n = int(np.searchsorted(-length, -i, side="left"))  # the words that go on
            letter = np.fromiter((w[i] for w in words[:n]), np.int64, n)
            here, z = self._at(i)[letter], zero[:n]
            replaced[:n] = (replaced[:n] & here) | (z & ~here)
            # the index word has one letter more before this place
            longer[:n] = (longer[:n] | z) & self._at(i + 1)[letter]
            # the index word lacks this letter or an earlier one
            shorter[:n] = (shorter[:n] & self._at(i - 1)[letter]) | z if i else z
            z &= here
            if i + 1 == apart:
                begin = zero.copy()
        none = np.zeros(self.width, np.uint64)

        def of(by: int) -> np.ndarray:
            return np.array([self._of_length.get(n + by, none) for n in length.tolist()])
        # zero: the letter more stands at the end
        one = (replaced & of(0)) | ((longer | zero) & of(1)) | (shorter & of(-1))
        one &= np.array([self._of_cell.get(c, none) for c in cells])
        return one & ~begin if apart else one


def _looked_up(frame: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form_n, form) of the words that have near words of their cell in the index."""
    apart = FIRST if frame["side"].iloc[0] == "last" else 0
    rows = list(zip(frame["word"], frame["n"], frame["cell"], frame["role"]))
    # the most frequent first, then in code-point order: the first bit of a result is the best word
    known = sorted((r for r in rows if r[3] != "asked"), key=lambda r: (-r[1], r[0]))
    asked = sorted((r for r in rows if r[3] != "index"), key=lambda r: -len(r[0]))
    out = []
    if known and asked:
        index = PositionIndex([r[0].encode("latin-1") for r in known], [r[2] for r in known])
        for at in range(0, len(asked), BLOCK):
            block = asked[at:at + BLOCK]
            found = index.one_error([r[0].encode("latin-1") for r in block], [r[2] for r in block], apart)
            for k in np.nonzero(found.any(axis=1))[0].tolist():
                best = known[int(np.unpackbits(found[k].view(np.uint8)).argmax())]
                out.append((block[k][0], int(np.bitwise_count(found[k]).sum()), best[1], best[0]))
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"]).astype(
        {"word": object, "n_near": "int64", "form_n": "int64", "form": object})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): number and best of the words one edit away, for words that have any.

    ``words`` has (word, n), every word once, at least five letters.  The best
    has the largest n, of equal ones it is the first in code-point order.
    """
    sides = F.array(F.struct(F.lit("first").alias("side"), F.substring("word", 1, FIRST).alias("cell")),
                    F.struct(F.lit("last").alias("side"), F.expr(f"right(word, {LAST})").alias("cell")))
    dealt = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.cell")
    letters = dealt.agg(F.sum(F.length("word"))).first()[0] or 0
    large = (dealt.groupBy("side", "cell").agg(F.ceil(F.sum(F.length("word")) / CHUNK).cast("int").alias("chunks"))
             .where("chunks > 1"))
    # at most 90^2 + 90^3 cells, whatever the corpus
    dealt = dealt.join(F.broadcast(large), ["side", "cell"], "left")
    pack = F.pmod(F.xxhash64("side", "cell"), F.lit(-(-letters // CHUNK) or 1)).cast("string")
    dealt = (dealt.withColumn("pack", F.when(F.col("chunks").isNull(), pack).otherwise(F.concat(F.lit("cell "), "cell")))
             .withColumn("chunks", F.coalesce("chunks", F.lit(1))))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)

    def role(i, j, name):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(name).alias("role"))
    tasks = F.when(F.col("chunks") == 1, F.array(role(F.lit(0), F.lit(0), "both"))).otherwise(
        F.concat(F.transform(every, lambda j: role(F.col("c"), j, "index")), F.transform(every, lambda i: role(i, F.col("c"), "asked"))))
    rows = dealt.withColumn("t", F.explode(tasks)).select("side", "pack", "cell", "t.i", "t.j", "t.role", "word", "n")
    found = rows.groupBy("side", "pack", "i", "j").applyInPandas(_looked_up, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.form").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers are doubled until each ends at a word without form.

    A form occurs at least twice as often as its word, so there is no circle
    and a chain has at most 62 steps (six rounds).
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        over = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        more = now.join(over, "root", "left")
        if more.where("next IS NOT NULL").isEmpty():
            return now
        now = cut(more.select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    Needs doc_id and text; other columns are ignored.  Null and empty texts
    have no words; a null doc_id counts as an empty one in the checksum that
    deletes letters; repeated rows count each time.  Ties between near words
    go to the first in code-point order.  An empty table gives an empty result.
    """
    words = cut(vocabulary(docs))
    near = near_words(words)
    good = F.col("best_n") >= TIMES * F.col("n")
    named = cut(words.join(near, "word", "left")
                .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    roots = _roots(named.where("form IS NOT NULL"))
    return (named.join(roots, "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
