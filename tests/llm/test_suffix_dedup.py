"""Operator 13 against brute force: windows counted by their bytes."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from notelake.llm import bwt
from notelake.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, tie string, lo string, anchor int, marks string"


def _texts() -> list[tuple]:
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(80)
    texts = [None, "", "a", "x" * 400, "ab" * 150, base, base, base.upper(), text(900)]
    texts += [text(rng.randint(1, 40)) for _ in range(20)] + [base[rng.randint(0, 90) : rng.randint(150, 280)] + text(6) for _ in range(20)]
    for _ in range(10):
        i = rng.randrange(len(base))
        texts.append(base[:i] + "#" + base[i + 1 :])
    rows = [(i, t, "t", "l", 1, "m") for i, t in enumerate(texts)]
    return [*rows, (None, base[:120], "t", "l", 1, "m"), (None, base[:120], "t", "l", 1, "m"), (5, base, None, None, None, None), (7, "other " + base[20:90], None, None, None, None)]


def _brute(rows: list[tuple], window: int) -> list[tuple]:
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    count = collections.Counter(b[i : i + window] for _, b in raws for i in range(len(b) - window + 1))
    out = []
    for doc_id, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "gram", "hot"), [(24, 8, S.HOT_BYTES), (24, 8, 0), (40, 20, S.HOT_BYTES), (24, 8, 300)])
def test_removed_bytes(spark, window, gram, hot):
    rows = _texts()
    out = S.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5), window, gram, hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out), key=repr) == _brute(rows, window)


def test_batches_and_folds(spark, monkeypatch):
    """Groups that run across batches, and a fold after every row, give the same."""
    rows = _texts() * 3
    want = _brute(rows, 24)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = S.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA).coalesce(1), 24, 8).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out), key=repr) == want


def test_empty_table(spark):
    assert S.remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(25))
def test_merge_orders_all_rotations(seed):
    """Merged transforms give the order and the common prefixes that sorting all rotations gives."""
    rng = random.Random(seed)
    limit = rng.choice([8, 13, 40])
    letters = rng.choice([b"ab", b"abcd", b"a"])
    texts = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(rng.randint(1, 5))]
    made = [bwt.transform(np.frombuffer(t, np.uint8), limit) for t in texts]
    order, common = bwt.merge([t for t, _ in made], limit)
    start = np.cumsum([0, *map(len, texts)])
    shown = []
    for g in order.tolist():
        s = int(np.searchsorted(start, g, "right")) - 1
        at = int(made[s][1][g - start[s]])
        shown.append((texts[s][at:] + texts[s] * (limit // len(texts[s]) + 1))[:limit])
    assert shown == sorted(shown)
    for i in range(1, len(shown)):
        shared = next((k for k, (a, b) in enumerate(zip(shown[i - 1], shown[i])) if a != b), limit)
        assert (shared == limit) == (common[i] == limit) and common[i] <= shared
