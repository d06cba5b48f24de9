"""The conversation trie against a brute-force version."""

import hashlib
import re
import zlib

import pytest

from duepath.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, openings=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = own
    if openings:
        seqs = {}
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            seqs[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = {}
    for c, ts in seqs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(k[:-1] == m for k in below if k)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ended = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


CASES = {
    "empty": [],
    "one": [(7, 0, "user", "a b")],
    "null and tied turns": [(1, None, "u", "x y"), (1, 0, None, None), (1, 0, None, None), (2, None, "u", "x y"), (None, 0, "u", "lost"), (41, 5, "u", ""), (41, 2, "", "q r s")],
    "ends inside another": [(c, t, "u", f"turn {t} of many") for c in range(1, 6) for t in range(c)],
    "long copies": [(c, t, "ua"[t % 2], f"word {t}" if c < 9 or t < 57 else f"other {c}") for c in range(1, 14) for t in range(60)],
    "openings": [(c, t, "u", f"{c} says {t}") for c in range(0, 45) for t in range(c % 5 + 1)] + [(c, 0, "u", "same") for c in range(60, 80)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("openings", [True, False])
def test_matches_brute_force(spark, name, openings):
    rows = CASES[name]
    seqs = trie.sequences(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    got = trie.nodes(trie.with_shared_openings(seqs) if openings else seqs)
    assert rows_of(got) == brute(rows, openings)


def test_many_equal_conversations(spark, monkeypatch):
    """One sequence with most of the conversations; their ids are joined from many pieces."""
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(c, 0, "u", "hello there") for c in range(-40, 300)] + [(c, 1, "u", "more") for c in range(0, 300, 7)]
    seqs = trie.sequences(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert rows_of(trie.nodes(seqs)) == brute(rows, openings=False)


def test_query_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.QUERIES["op12_truncation_peeling"](spark, sf)) == brute(rows)
