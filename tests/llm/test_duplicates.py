"""Exact and near duplicates against plain Python."""

import hashlib
import random
import re

import numpy as np
from duepath.llm import minmax, naming
from duepath.llm.components import smallest_reachable
from pyspark.sql import functions as F

AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (4, "ab"), (5, "a  b"), (5, "a  b"), (6, "a b"), (7, "x" * 50_000), (8, "x" * 49_999 + "y"), (9, "x " * 25_000 + "x" * 25_000), (10, "é" * 3000), (11, "é" * 3000 + "e")]


def exact(rows):
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, k))
    out = []
    for body, members in groups.items():
        first = min(members)
        for m in members:
            keep = None if first[1] else first[2]
            out.append((None if m[1] else m[2], keep, len(members), hashlib.sha256(body.encode()).hexdigest(), -m[0]))
    return sorted(out, key=repr)


def checked(df, rows):
    got = df.collect()
    texts = {}
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted((w[:4] for w in exact(rows)), key=repr)
    for r in got:
        texts.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(kept) == 1 for kept in texts.values())


def test_exact_awkward_rows(documents):
    checked(naming.exact_duplicates(documents(AWKWARD, "name")), AWKWARD)


def test_exact_many_levels_and_colliding_fingerprints(documents):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 7, 8, 9, 40, 41])))) for k in range(120)]
    checked(naming.exact_duplicates(documents(rows, "pos"), block_bytes=4, fingerprint=lambda c: F.pmod(F.xxhash64(c), F.lit(3))), rows)


def test_exact_empty_table_and_filter(documents):
    assert naming.exact_duplicates(documents([])).count() == 0
    kept = naming.without_copies(documents(AWKWARD, "key"))
    assert kept.columns == ["doc_id", "text", "lang", "key"] and kept.count() == len({w[3] for w in exact(AWKWARD)})
    assert kept.where("doc_id = 5").count() == 1


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(rows):
    sets = [sets_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids) if ids else None) for k in members]
    return sorted(out, key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_against_all_pairs(documents):
    rng = random.Random(5)
    rows = [(None, "One two three"), (901, "one TWO three"), (902, "one two three four"), (903, None), (904, ""), (905, " \n"), (906, "a b c d e"), (906, "a b c d e"), (None, "lone words of nobody here at all"), (907, "q " * 30_000)]
    for family in range(6):
        base = [f"t{rng.randrange(500)}" for _ in range(120)]
        shared = [f"p{family}-{k}" for k in range(70)]
        rows += [(family * 100 + k, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5]))) for k in range(25)]
        rows += [(family * 100 + 50 + k, " ".join(shared + [f"u{family}-{k}-{j}" for j in range(30)])) for k in range(20)]
    got = minmax.near_duplicates(documents(rows, "root")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_filter_keeps_one_of_each(documents):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (2, None), (2, None), (4, "other words"), (None, "nobody")]
    left = minmax.one_of_each(documents(rows, "body"))
    assert left.columns[-1] == "body"
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(1, "A b c d e f"), (2, None), (2, None), (4, "other words"), (None, "nobody")], key=repr)
    assert minmax.near_duplicates(documents([])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 105), (105, 103), (7, 7)]
    found = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 103: 100, 105: 100}


def test_values_of_one_permutation_are_in_different_bands():
    half, seen = minmax.BANDS * minmax.ROWS // 2, []
    for band in range(minmax.BANDS):
        places = [band + r * minmax.BANDS for r in range(minmax.ROWS)]
        used = [p if p < half else (p - half + minmax.SHIFT) % half for p in places]
        assert len(set(used)) == minmax.ROWS
        seen += used
    assert sorted(seen) == sorted([*range(half)] * 2)


def test_bands_of_small_sets_agree_as_often_as_stated():
    rng = np.random.default_rng(9)
    sets = np.sort(rng.integers(1, 1 << 63, (600, 4), dtype=np.uint64), 1)
    large = minmax.signatures(sets.ravel(), np.arange(601) * 4)
    small = minmax.signatures(sets[:, :3].ravel(), np.arange(601) * 3)
    # 0.75 ** 4 is 0.316; both values of a permutation in one band gave 0.25
    assert 0.295 < (large == small).mean() < 0.34
