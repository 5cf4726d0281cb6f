"""SimHash components, shared-list negatives and spelling variants against brute force, with odd rows and forced blocks."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from conftest import SMALL
from harness import compare
from riskframe.llm import negatives, queries, simhash, spelling

ODD = "doc_id long, text string, fp long, w long, n long, root string, word string, is_hot boolean, pack string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def _odd(spark, texts):
    """Nulls in every column and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, None, 1, None, "r", "word", True, None) for i, t in texts], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- simhash -----------------------------------------------------------------------------------

def _slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(nodes, links):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        up[top(a)] = top(b)
    return {x: top(x) for x in nodes}


def _slow_components(rows):
    fp = [_slow_fingerprint(t) for _, t in rows]
    known = sorted(set(fp))
    near = [(a, b) for a, b in itertools.combinations(known, 2) if (a ^ b).bit_count() <= 2]
    root = _classes(known, near)
    ids = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            ids[root[f]] = min(i, ids.get(root[f], i))
    return Counter((i, f"{f:016x}", ids.get(root[f])) for (i, _), f in zip(rows, fp))


def test_simhash_matches_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, simhash.simhash_components(docs).collect())) == _slow_components(rows)


def test_simhash_of_odd_rows(spark):
    texts = [(1, ""), (2, None), (None, None), (None, "one two"), (3, "One\tTWO"), (3, "one two"), (4, "  \n"), (5, LONG), (6, LONG + " tail"),
             (7, "É one two three"), (8, "é one two three"), (9, "x"), (9, "x"), (None, "alone, with no id")]
    got = simhash.simhash_components(_odd(spark, texts))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == _slow_components(texts)
    assert simhash.simhash_components(_odd(spark, texts).where("doc_id < 0")).count() == 0


def test_simhash_blocks_of_shingles(monkeypatch):
    whole = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    assert simhash.fingerprint(LONG) == whole == _slow_fingerprint(LONG)


def test_links_of_crowded_fingerprints(spark):
    """Clusters of hundreds of fingerprints, also with the highest bit, are connected as all pairs connect them."""
    rng = random.Random(7)
    known = {0, (1 << 64) - 1, 1 << 63, 3 << 62, 1 << 62}
    for centre in [rng.getrandbits(64) for _ in range(8)] + [0]:
        for _ in range(80):
            x = centre
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            known.add(x)
    known = sorted(known)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in known], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found) and len(found) < 65 * len(known)
    want = _classes(known, [(a, b) for a, b in itertools.combinations(known, 2) if (a ^ b).bit_count() <= 2])
    got = _classes(known, found)
    pairs = {(got[x], want[x]) for x in known}
    assert len(pairs) == len(set(got.values())) == len(set(want.values()))


def test_counts_bound_the_distance(spark):
    rng = random.Random(3)
    known = [rng.getrandbits(64) for _ in range(200)] + [0, (1 << 64) - 1]
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in known], "fp long")
    v = {r["fp"] % (1 << 64): r["v"] % (1 << 64) for r in frame.select("fp", simhash.counts(frame["fp"]).alias("v")).collect()}
    for x in known:
        assert [v[x] >> 2 * k & 3 for k in range(32)] == [(x >> 2 * k & 3).bit_count() for k in range(32)]


# --- hard negatives ----------------------------------------------------------------------------

@pytest.fixture
def tiny(monkeypatch):
    for name, value in {"BLOCK": 64, "STEP": 8, "MEMBERS": 2, "GROUP": 3, "WALKERS": 2}.items():
        monkeypatch.setattr(negatives, name, value)


def test_negatives_match_sql(spark, duck):
    assert not compare(queries.op12_shared_list_negatives(spark, SMALL), duck, queries.SQL["op12_shared_list_negatives"])


def test_negatives_in_many_blocks_and_groups_match_sql(spark, duck, tiny):
    assert not compare(queries.op12_shared_list_negatives(spark, SMALL), duck, queries.SQL["op12_shared_list_negatives"])


def _slow_negatives(rows, every=100):
    fine = [(i, np.array([int(np.floor(256 * x)) for x in v] + [0] * (4 - len(v))), y) for i, v, y in rows
            if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, v, y) in enumerate(fine):
        if i % every:
            continue
        scored = [(-int(v @ u), j, z == y) for m, (j, u, z) in enumerate(fine) if m != n]
        for s, j, _ in sorted(x for x in scored if x[2])[:5]:
            fits = sorted((t, k) for t, k, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out.update((i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fits))
    return out


def test_negatives_with_ties_copies_and_bad_vectors(spark, tiny):
    rng = np.random.default_rng(5)
    rows = [(i * 10, [float(x) / 256 for x in v], int(y)) for i, (v, y) in enumerate(zip(rng.integers(-4, 5, (150, 4)), rng.integers(0, 3, 150)))]
    rows += [(100, rows[0][1], 1), (100, rows[0][1], 1), (110, rows[3][1], 2), (300, [0.0] * 4, 1), (400, [], 0), (500, [0.5], 1), (600, None, 1),
             (700, [None, 1.0, 0.0, 0.0], 1), (800, [float("nan")] * 4, 1), (900, [float("inf"), 0.0, 0.0, 0.0], 2), (1000, rows[1][1], None), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "vec_id long, embedding array<float>, label int, rank int, uid long, cluster string")
    got = negatives.hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == _slow_negatives(rows)
    assert negatives.hard_negatives(df.where("vec_id < 0")).count() == 0
    assert negatives.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0


def test_shared_list_bounds_hold_and_walks_stop():
    """On clustered vectors no member's score passes the bound, and a walk ends long before the list does."""
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(20, 16))
    points = np.floor(40 * (heads[rng.integers(0, 20, 6000)] + 0.1 * rng.normal(size=(6000, 16))))
    members = np.floor(40 * (heads[3] + 0.1 * rng.normal(size=(50, 16))))
    order, bound = negatives.shared_list(negatives._units(members)[0], *negatives._units(points))
    size = np.sqrt((members ** 2).sum(axis=1))
    assert ((members @ points[order].T) <= size[:, None] * bound[None, :] + 1e-6).all()
    tenth = np.sort(members @ points.T, axis=1)[:, -10]
    assert ((size[:, None] * bound[None, :]) >= tenth[:, None]).mean() < 0.2


# --- spelling ----------------------------------------------------------------------------------

def _slow_words(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _slow_variants(count):
    spelled = {}
    for w in count:  # words one edit apart are equal, or equal without one letter of either
        for k in range(len(w) + 1):
            spelled.setdefault(w[:k] + w[k + 1:], set()).add(w)
    near = {w: set() for w in count}
    for group in spelled.values():
        for a, b in itertools.permutations(group, 2):
            if _one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], count.get(form[w]), root)
    return out


def _got(frame):
    rows = frame.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_match_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert _got(spelling.spelling_variants(docs)) == _slow_variants(_slow_words(rows))


@pytest.mark.parametrize("chunk", [1 << 16, 300])
def test_near_words_of_close_words(spark, monkeypatch, chunk):
    """Edits at every place, ties, long words; with small chunks cells are split and looked up piece by piece."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    rng = random.Random(11)
    count = {}
    for base in ["abcde", "aaaaa", "aaaaaa", "élève", "×÷ÿÀz", "strasse", "x" * 90, "ab" * 40]:
        count[base] = rng.randint(3, 400)
        for _ in range(25):
            w = base
            for _ in range(rng.randint(1, 2)):
                k, c = rng.randrange(len(w) + 1), rng.choice("abÿex")
                w = rng.choice([w[:k] + c + w[k:], w[:k] + c + w[k + 1:], w[:k] + w[k + 1:]])
            if len(w) >= 5:
                count[w] = rng.choice([3, 6, 12, 200])
    frame = spark.createDataFrame(list(count.items()), "word string, n long")
    want = _slow_variants(count)
    got = {r["word"]: (r["n_near"], r["best_n"]) for r in spelling.near_words(frame).collect()}
    assert {w: n for w, (n, _) in got.items()} == {w: x[1] for w, x in want.items() if x[1]}
    assert all(got[w][1] == x[3] for w, x in want.items() if x[2] is not None)


def test_variants_of_odd_rows(spark):
    texts = [(1, ""), (2, None), (None, None), (None, "alpha alpha Alpha"), (3, "alphas alphas alphas 12alpha-ALPHA"), (3, "ÀLPHA àlpha àlpha àlpha"),
             (4, "betasłbetas betas"), (5, "gamma😀gamma gamma"), (6, "z" * 3000 + " " + ("z" * 3000 + " ") * 2), (7, LONG)]
    texts += [(10 + k, "alpha alpha alphas alphe") for k in range(200)]
    got = spelling.spelling_variants(_odd(spark, texts))
    assert _got(got) == _slow_variants(_slow_words(texts))
    assert spelling.spelling_variants(_odd(spark, texts).where("doc_id < 0")).count() == 0


def test_forms_end_at_roots(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(40)]
    roots = spelling._roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {(r["word"], r["root"]) for r in roots} == {(f"w{k}", "w40") for k in range(40)}
