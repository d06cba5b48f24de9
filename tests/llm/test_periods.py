"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from duepath.llm import periods, queries
from duepath.llm import text as tx


def brute(words):
    """(start, length, smallest period) of every run, by comparing each word with the one q before."""
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def words_of(rng):
    kind, n = rng.random(), rng.randint(0, 150)
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(n)]
    if kind < 0.6:
        base = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        words = (base * n)[:n]
        for _ in range(rng.randint(0, 3) if words else 0):
            words[rng.randrange(len(words))] = "d"
        return words
    words = []
    while len(words) < n:
        words += ([rng.choice("ab") for _ in range(rng.randint(1, 6))] * rng.randint(1, 9) + ["c"] * rng.randint(0, 2)) * rng.randint(1, 4)
    return words


def test_runs_match_brute_force():
    rng, found = random.Random(5), 0
    for _ in range(400):
        docs = [words_of(rng) for _ in range(rng.randint(1, 4))]
        hashes = tx.mix(np.array([ord(w) for d in docs for w in d], np.uint64))
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = periods.runs(hashes, bounds)
        for k, d in enumerate(docs):
            expected = brute(d)
            found += len(expected)
            assert [tuple(r[1:]) for r in got.tolist() if r[0] == k] == expected
    assert found > 500


@pytest.mark.parametrize("n", [1, 2, 3, 64, 777])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    values = rng.permutation(n)
    matrix = periods.WaveletMatrix(values)
    low = rng.integers(0, n + 1, 200)
    high = np.maximum(low, rng.integers(0, n + 1, 200))
    x = rng.integers(0, n + 1, 200)
    got = matrix.successors(low, high, x, 3)
    for a, b, v, row in zip(low, high, x, got):
        expected = sorted(w for w in values[a:b] if w >= v)[:3]
        assert row.tolist() == expected + [-1] * (3 - len(expected))


def expected_row(doc_id, text):
    words = (text or "").encode()
    words = words.split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_matches_brute_force(spark, documents, tmp_path):
    rng = random.Random(11)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(words_of(rng))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\r\n"), (None, "a b " * 20), (3, "x " * 30), (3, "x " * 30), (204, "é ß " * 40), (205, "so what " * 3000)]
    documents(rows, extra="runs").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_internal_patterns"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected_row(*r) for r in rows), key=repr)


def test_collapsed_text_and_empty_table(spark, documents):
    rows = periods.find(documents([(1, "start " + "a b c " * 10 + "end")])).collect()
    assert rows[0].collapsed == "start a b c end" and [tuple(r) for r in rows[0].runs] == [(1, 30, 3)]
    assert periods.report(periods.find(documents([]))).count() == 0
