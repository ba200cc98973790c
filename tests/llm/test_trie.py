"""Operator 12 against brute force: a trie of tuples, walked."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from notelake.llm import trie as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, h1 string, at string, saved long"


def _rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["hello", "hello  there\n", "", None, " a b c ", "one two three four", "x"]
    rows = []
    for c in rng.sample(range(0, 90), 55) + [-3, -20, 1_000_000_007]:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, rng.choice([t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts[: rng.choice([2, 7])]), "d", "h", "a", 1) for t in range(n)]
    same = [("user", "hi"), ("assistant", "well")]
    rows += [(c, t, *same[t % 2], None, None, None, None) for c in range(2000, 2100) for t in range(2)]
    return rows + [(7, 99, "user", "twice", None, None, None, None)] * 2 + [(None, 1, "user", "lost", None, None, None, None)]


def _brute(rows: list[tuple]) -> dict:
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -((-c) % 20))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}

    def walk(k: tuple) -> tuple[int, int]:
        leaves, saved = (0, 0) if kids[k] else (1, 0)
        saved += (len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for x in kids[k]:
            a, b = walk(x)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(map(str, sorted(c for c in members[k] if built[c] == k)))
        out[min(members[k]), len(k)] = (min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        walk(())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes(spark, seed):
    rows = _rows(seed)
    out = T.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out}
    assert len(got) == len(out) and got == _brute(rows)


def test_empty_table(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_siblings_across_ranges(spark):
    rows = [(g, i) for g in range(4) for i in range(0, 300, g + 1)]
    out = T.next_in_group(spark.createDataFrame(rows, "g long, i long").repartition(4), ["g"], "i").collect()
    assert {(r.g, r.i): r.next for r in out} == {(g, i): (i + g + 1 if i + g + 1 < 300 else None) for g, i in rows}


def test_ids_in_pieces(spark):
    ids = {(1, k, 2): list(range(k, 900, k + 1)) for k in range(5)}
    rows = [(*k, c) for k, v in ids.items() for c in v]
    out = T.joined_ids(spark.createDataFrame(rows, "depth long, h1 long, h2 long, conv_id long").repartition(4), limit=50).collect()
    assert {(r.depth, r.h1, r.h2): r.sha for r in out} == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}
