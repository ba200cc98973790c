"""Operator 11 against brute force: every order of the filters applied row by row."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from notelake.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, part string, row string, fails string, quality int"
LABELS = "doc_id long, quality int, toxic int, part string"


def _rows() -> list[tuple]:
    rng = random.Random(11)
    texts = [None, "", " \n\t", "\x0b a \x0c", "A" * 30, "word " * 300, "a# b", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "é" * 98 + "AB", "é" * 97 + "AB"]
    for _ in range(60):
        n = rng.choice([3, 199, 200, 240])
        texts.append(rng.choice([" ", "\n "]).join(rng.choice(["w%d" % rng.randrange(400), "Xy", "q|"] if rng.random() < 0.2 else ["w%d" % rng.randrange(rng.choice([40, 400]))]) for _ in range(n)))
    texts += texts[5:20] + [texts[12]] * 5
    rows = [(i if i % 9 else None, t, rng.choice(["a", "b", None, ""]), "p", "r", "f", 1) for i, t in enumerate(texts)]
    return rows + [(4, texts[4], "a", None, None, None, None), (3, "other", "b", None, None, None, None)]


def _brute(rows: list[tuple], labels: list[tuple]) -> dict:
    least: dict = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    facts = []
    for doc_id, text, source, *_ in rows:
        text = text or ""
        ws = WORD.findall(text)
        small = least.get(text)
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": small is not None and (doc_id is None or doc_id > small),
        }
        facts.append((source or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[1][letter]]
                left = [f for f in left if not f[1][letter]]
                alone = sum(f[1][letter] and sum(f[1].values()) == 1 for f in own)
                out[part, order, step] = [len(left), len(gone), sum(f[1][letter] for f in own) - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    rows = _rows()
    labels = [(i, [1, 0, None][i % 3], [0, 1, None, 0][i % 4], "x") for i in range(0, 70, 2)] + [(6, 1, 1, "x"), (None, 1, 1, "x")]
    return rows, labels, spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS)


def test_all_orders(tables):
    rows, labels, docs, marks = tables
    out = A.audit(docs, marks).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert len(got) == len(out) and got == _brute(rows, labels)


def test_survivors_by_row(tables):
    """The id tables, joined row by row, leave what the audit counts."""
    rows, labels, docs, _ = tables
    want = _brute(rows, labels)
    found = A.facts(docs)
    failing = A.failing_ids(found)
    for order in ("ABCDE", "EDCBA", "CE", "D"):
        left = {r["part"]: r["count"] for r in A.survivors(found, failing, order).groupBy("part").count().collect()}
        for part in ("a", "b", ""):
            assert left.get(part, 0) == next(v[0] for k, v in want.items() if k[0] == part and set(k[1][: k[2]]) == set(order))


def test_empty_tables(spark, tables):
    assert A.audit(spark.createDataFrame([], SCHEMA), tables[3]).collect() == []
    assert len(A.audit(tables[2], spark.createDataFrame([], LABELS)).collect()) == 3 * 600
