"""Whitening, SimHash components and periodic runs against plain versions, and on awkward rows."""

import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
import brute
from conftest import SF001, SF01

from expstudy.llm import common, registry, runs, simhash, whitening

DOCS = "doc_id long, text string, f string, runs int, n int, label string"


# ---------------------------------------------------------------- periodic runs

def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out)


def brute_digest(doc_id, text):
    w = brute.words(text)
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    found = brute_runs(w)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            brute.sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            k = rng.choice([1, 2, 3, 5, 30])
            w = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
            while rng.random() < 0.6:
                p = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
                w += (p * 8)[:rng.randint(3 * len(p), 6 * len(p))] + [rng.randrange(k + 5) for _ in range(rng.randint(0, 3))]
            docs.append(w)
        codes = np.array([c for d in docs for c in d], np.int64)
        text = np.array([i for i, d in enumerate(docs) for _ in d], np.int64)
        begins = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        want = sorted((begins[i] + s, size, q) for i, d in enumerate(docs) for s, size, q in brute_runs(d))
        assert [tuple(r) for r in runs.find_runs(codes, text).tolist()] == want


def test_runs_query_matches_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF001, "documents").collect()]
    got = [tuple(r) for r in registry.op13_periodic_runs(spark, SF001).collect()]
    assert sorted(got) == sorted(brute_digest(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_of_long_periods():
    w = np.random.default_rng(0).integers(0, 50_000, 200_000)
    w = np.concatenate((w[:1000], w[1000 + np.arange(len(w) - 1000) % 40_000]))
    assert runs.find_runs(w, np.zeros(len(w), np.int64)).tolist() == [[1000, 199_000, 40_000]]


def test_runs_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a a a a a a b"), (None, None), (5, "x " * 7), (5, "x " * 7), (6, "x y " * 4 + "x"), (7, "x y x y x y x"),
            (8, "A a " * 9), (9, "\x0bq\x0c" * 6 + " é漢 " * 100_000)]
    docs = spark.createDataFrame([(*r, "c", 1, 2, "d") for r in rows], DOCS)
    got = sorted((tuple(r) for r in runs.run_digest(docs, runs.repeat_tails).collect()), key=str)
    want = [brute_digest(*r) for r in rows[:-1]]
    w = brute.words(rows[-1][1])
    assert sorted(want, key=str) == [r for r in got if r[0] != 9]
    nine = next(r for r in got if r[0] == 9)
    assert nine[1:5] == (2, 6, 100_000, 1) and nine[7] == brute.sha("q é漢") and len(w) == 100_006
    whole = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in whole[6].runs] == [(0, 9, 2)] and whole[6].collapsed == "x y" and whole[7].runs == []
    assert runs.run_digest(docs.where("false")).count() == 0 and runs.periodic_runs(docs.where("false")).count() == 0


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(text):
    w = brute.words((text or "").translate(brute.ASCII_LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """{position: least doc_id} of (doc_id, fingerprint) rows."""
    f = np.array([x for _, x in rows], np.uint64)
    up = list(range(len(f)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[:i]) <= 4).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(f))]


def test_fingerprints_match_plain_version(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 700)
    rng = random.Random(2)
    texts = [None, "", " ", "a", "A b", "a b c", "a b c d", " x\ty\n z é Ü w  v "]
    texts += ["".join(rng.choice("abAB é\n\t ") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    texts += [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(3000))]
    want = [brute_fingerprint(t) for t in texts]
    assert simhash.simhashes(pa.array(texts, pa.string())).tolist() == want
    assert simhash.simhashes(pa.array(texts, pa.string()).slice(5)).tolist() == want[5:]


@pytest.mark.parametrize("most", [simhash.MOST, 20])
def test_components_match_plain_version(spark, monkeypatch, most):
    """Also with small nodes, so that the trie's upper part is deep and uneven."""
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(20)] + [rng.getrandbits(64)] * 20  # one dense place
    rows = []
    for d in range(400):
        f = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        rows.append((d, f))
    rows += [(1000, rows[0][1]), (None, rows[1][1])]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    docs = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, f long")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs, most).collect()}
    assert got == {(d, f"{f:016x}"): c for (d, f), c in zip(rows, brute_components(rows), strict=True)}


@pytest.mark.parametrize("few, front", [(1 << 15, 1 << 16), (4, 50), (1, 7)])
def test_trie_pairs(monkeypatch, few, front):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "FRONT", front)
    rng = random.Random(few)
    for _ in range(12):
        base = [rng.getrandbits(64) for _ in range(rng.randint(1, 6))]
        x = set()
        for _ in range(rng.randint(1, 200)):
            v = rng.choice(base)
            for _ in range(rng.randint(0, 9)):
                v ^= 1 << rng.randrange(64)
            x.add(v)
        x = np.array(sorted(x), np.uint64)
        names = {r: i for i, r in reversed(list(enumerate(brute_components([(i, int(f)) for i, f in enumerate(x)]))))}
        assert simhash.near(x).label.tolist() == [names[c] for c in brute_components([(i, int(f)) for i, f in enumerate(x)])]
        half = len(x) // 2
        if half:
            forest = simhash.near(x[:half], x[half:])
            close = np.bitwise_count(x[:half, None] ^ x[None, half:]) <= 4
            i, j = np.nonzero(close)
            assert (forest.label[i] == forest.label[j + half]).all()
            assert len(np.unique(forest.label)) >= len(x) - close.sum()


def test_simhash_query_matches_plain_version(spark):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in common.table(spark, SF001, "documents").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op12_simhash_trie(spark, SF001).collect()}
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(docs, brute_components(docs), strict=True)}


def test_simhash_awkward_rows(spark):
    texts = [(3, None), (4, ""), (None, " "), (7, "a b c d e"), (7, "A B c d  e"), (None, "only one"), (None, "only one"), (9, "word " * 200_000)]
    docs = spark.createDataFrame([(*r, "c", 1, 2, "d") for r in texts], DOCS)
    rows = [(d, brute_fingerprint(t)) for d, t in texts]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows), strict=True)), key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


# ---------------------------------------------------------------- whitening

def check_whitening(rows, vectors):
    """``rows`` against numpy's eigenvectors; ``vectors`` are (vec_id, list)."""
    x = np.floor(256 * np.array([v for _, v in vectors], np.float64)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(4, x.shape[1])
    assert len(rows) == k * len(x)
    by = {}
    for r in rows:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    for j in range(k):
        own = by[j + 1]
        got = np.array([own[i][0].whitened for i, _ in vectors], float)
        want = (x - s / n) @ q[:, j] / np.sqrt(e[j])
        assert np.allclose(got * np.sign(got @ want), want, atol=1e-7 * np.abs(want).max())
        assert [own[i][0].deviation for i, _ in vectors] == ((n * x - s) ** 2).sum(axis=1).tolist()
        assert {r.n for rs in own.values() for r in rs} == {n}
        assert all(abs(r.explained / (e[j] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for rs in own.values() for r in rs)


def test_whitening_query(spark):
    vectors = [(r.vec_id, list(r.embedding)) for r in common.table(spark, SF01, "embeddings").collect()]
    check_whitening(registry.op11_chebyshev_whitening(spark, SF01).collect(), vectors)


def test_leading_pairs_of_hard_spectra():
    """Large gaps, repeated and clustered eigenvalues, and a rank below the block."""
    class V:
        def __init__(self, values, seed):
            q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
            self.d, self.v = len(values), (q * values) @ q.T

        def __call__(self, q):
            return self.v @ q

    for values in (np.r_[1e9, 1e4, 50, 3, np.linspace(1, 2.9, 76)], np.r_[[5.0] * 6, np.linspace(0.5, 4.9, 60)], np.r_[9.0, 3, 2, 1, np.zeros(70)],
                   np.linspace(1, 2, 90), np.r_[7.0, 7 - 1e-6, 6, 5.999, np.linspace(0.1, 5, 80)]):
        for seed in range(3):
            v = V(values, seed)
            theta, q = whitening.leading(v, 4)
            assert np.allclose(np.sort(theta)[::-1], np.sort(values)[::-1][:4], rtol=1e-10)
            assert np.linalg.norm(v.v @ q - q * theta) <= 1e-11 * values.max() and np.allclose(q.T @ q, np.eye(4), atol=1e-12)


VECTORS = "vec_id long, embedding array<float>, label int, component string, n int, x string, d string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, "x", "d") for r in rows], VECTORS)


def test_whitening_awkward_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(v)) for v in rng.standard_normal(6)]) for i in range(40)]
    big = [(50, [300.0, -0.0, 1e4, 0.5, -200.0, 3.0]), (51, [9e3, 1.0, 0.0, 0.0, 0.0, 0.0])]
    bad = [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (62, [float("nan")] * 6), (63, [float("inf")] + [0.0] * 5), (64, []), (65, [1.0, 2.0])]
    vectors = vectors_of(spark, [*good, *big, *bad, (70, good[0][1]), (None, good[1][1])])
    got = whitening.whiten(vectors, whitening.fit_whitening(vectors)).collect()
    assert {r.vec_id for r in got} == {*range(40), 50, 51, 70, None}
    check_whitening([r for r in got if r.vec_id is not None], [*good, *big, (70, good[0][1])])
    none = vectors.where("false")
    assert whitening.whiten(none, whitening.fit_whitening(none)).count() == 0
    lost = vectors_of(spark, bad[:4])
    assert whitening.whiten(lost, whitening.fit_whitening(lost)).count() == 0


def test_whitening_of_few_vectors(spark):
    same = vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    got = whitening.whiten(same, whitening.fit_whitening(same)).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, 0.0, 0.0)}
    line = vectors_of(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])
    got = {(r.vec_id, r.component): r for r in whitening.whiten(line, whitening.fit_whitening(line)).collect()}
    assert abs(abs(got[1, 1].whitened) - 1) < 1e-12 and got[1, 2].whitened is None and abs(got[1, 1].explained - 1) < 1e-12


def test_whitening_refuses_what_is_not_exact(spark):
    huge = vectors_of(spark, [(1, [1e30, 0.0]), (2, [1.0, 0.0])])
    with pytest.raises(Exception, match="64-bit"):
        whitening.whiten(huge, whitening.fit_whitening(huge)).collect()
