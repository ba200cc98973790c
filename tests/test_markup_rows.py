"""Tokens, intervals, rules, spans, trees and joins against plain Python, with hostile pages and cycles."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notelake.operators import joins as J
from notelake.operators import rules as R
from notelake.operators import spans as S
from notelake.operators import tokens as T


def _intervals(kinds):
    """Close token of each open one, by a stack per tag; depth by closed intervals."""
    stacks, last = {}, {}
    for pos, (kind, tag) in enumerate(kinds):
        if kind == "open":
            stacks.setdefault(tag, []).append(pos)
        elif kind == "close" and stacks.get(tag):
            last[stacks[tag].pop()] = pos
    depth, ends, n = [], set(last.values()), 0
    for pos in range(len(kinds)):
        n -= pos in ends
        depth.append(n)
        n += pos in last
    return last, depth


def test_matched_tokens(spark):
    rng = random.Random(4)
    pages = []
    for i in range(60):
        parts = [rng.choice(["<b>", "</b>", "<i class='x'>", "</i>", "<br>", "text", "<div>", "</div>", "<p/>", "<!-- <b> -->"]) for _ in range(rng.randint(0, 40))]
        pages.append((i, "".join(parts)))
    rows = T.explode_tokens(spark.createDataFrame(pages, "k int, html string"), "k")
    got = {}
    for r in T.matched(rows, "k").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r)
    for own in got.values():
        last, depth = _intervals([(r.kind, r.tag) for r in own])
        assert [r.depth for r in own] == depth and {r.pos: r["last"] for r in own if r["last"] is not None} == last


@pytest.mark.parametrize("piece", ["<script ", "<!--", "<style>", "<a ", "<title>", "<div>"])
def test_unclosed_elements_are_linear(spark, piece):
    page = spark.createDataFrame([(1, piece * 16_000)], "k int, html string")
    T.visible_text(page, "k", ["title"]).collect()
    start = time.time()
    T.explode_tokens(page, "k").count()
    T.matched(T.tag_rows(page, "k").drop("tok"), "k").agg(F.max("depth")).collect()
    page.select(T.element_text(T.tokenize(F.col("html")), ["title"]), F.md5(T.without_first(F.col("html"), ["title"]))).collect()
    assert time.time() - start < 12


def test_visible_text_and_replacement(spark):
    page = spark.createDataFrame([(1, "a<title>b<title>c</title>d</title>e<!-- x -->f<title>g"), (2, "plain"), (3, None)], "k int, html string")
    assert {r.k: r.text for r in T.visible_text(page, "k", ["title"]).collect()} == {1: "aef", 2: "plain", 3: None}
    places = spark.createDataFrame([(1, 1, 7, "[x]"), (1, 3, 5, "[inner]"), (1, 8, 8, "[e]")], "k int, pos int, last int, new string")
    assert {r.k: r.html for r in T.replace_elements(page, "k", places).collect()} == {1: "a[x][e]<!-- x -->f<title>g", 2: "plain", 3: None}


def test_rules_are_sent_and_elements_are_not(spark):
    pages = spark.createDataFrame([(1, '<b class="x">gone</b>')], "k int, html string")
    done = R.apply_rules(pages, "k", R.rule_table(spark, [("b", "x", "remove", None, [], None)]))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert [r.html for r in done.collect()] == [""]


def test_rules(spark):
    rules = R.rule_table(
        spark,
        [
            ("b", "x", "remove", None, [], None), ("b", None, "rename", "<strong{rest}>", [], "</strong>"), ("div", "card", "replace", "<q>", [R.part("T:", "h1", None, "text"), R.part(" U:", "a", "u", "attr", "href"), R.part(" O:", "em", None, "inner", None, True)], "</q>"),
            (None, "w", "rename", "", [], ""), ("hr", None, "replace", "<br>", [], ""),
        ],
    )
    pages = {
        1: ('<b class="x">gone<b>too</b></b><b id="1" class="y">s<hr></b>', '<strong id="1">s<br></strong>'),
        2: ('<div class="card big"><h1>a<i>b</i></h1><a href="n">n</a><a class="u v" href="l">m</a></div><b>', "<q>T:ab U:l O:</q><strong>"),
        3: ('<div class="card"><h1>a</h1><a class="u">no link</a></div>z', "z"),
        4: ('<div class="card"><div class="card"><h1>in</h1></div><a class="u" href="k"></a><em>e<b>f</b></em></div>', "<q>T:in U:k O:e<b>f</b></q>"),
        5: ('<p class="w"><u class="w">k</u></p>', "k"),
        6: (None, None),
        7: ("", ""),
    }
    given = spark.createDataFrame([(5, 1, 3, "[given]")], "k int, pos int, last int, new string")
    df = spark.createDataFrame([(k, v[0]) for k, v in pages.items()], "k int, html string")
    assert {r.k: r.html for r in R.apply_rules(df, "k", rules).collect()} == {k: v[1] for k, v in pages.items()}
    assert {r.k: r.html for r in R.apply_rules(df, "k", rules, given=given).collect()}[5] == "[given]"


def _formatted(text, spans):
    """A plain reading of text with spans (start, end, format, ord, attribute)."""
    inline = {"bold": ("<strong>", "</strong>"), "italic": ("<em>", "</em>"), "underline": ("<u>", "</u>"), "strike": ("<s>", "</s>")}
    cuts = sorted({0, len(text)} | {x for s in spans for x in s[:2] if x is not None and 0 <= x <= len(text)})
    runs, fresh = [], True
    for a, b in zip(cuts, cuts[1:]):
        on = [s for s in spans if s[0] is not None and s[1] is not None and s[0] <= a and s[1] >= b]
        head = next((s[2] for s in sorted(on, key=lambda s: s[3]) if s[2].startswith("headline")), None)
        kind = {"headline1": "h1", "headline2": "h2", None: "p"}[head]
        for j, line in enumerate(text[a:b].split("\n")):
            fresh = fresh or j > 0
            if not line:
                continue
            for s in sorted(on, key=lambda s: (S.PRECEDENCE.index(s[2]), s[3]), reverse=True):
                if s[2] in inline:
                    line = inline[s[2]][0] + line + inline[s[2]][1]
                elif s[2] == "url" and s[4]:
                    line = f'<a href="{s[4]}">{line}</a>'
                elif s[2] == "bg_color" and s[4]:
                    line = f'<span style="background-color: {({"1": "red"}).get(s[4], s[4])}">{line}</span>'
            if fresh or runs[-1][0] != kind:
                runs.append([kind, ""])
            runs[-1][1] += line
            fresh = False
    return "".join(f"<{k}>{h}</{k}>" for k, h in runs) or "<p></p>"


def test_formatted_text(spark):
    rng = random.Random(8)
    texts, rows = [(0, None), (1, ""), (2, "\n\n"), (3, "Title\nbody text")], [(3, 0, 5, "headline1", 0, None), (3, 6, 10, "bold", 1, None)]
    for k in range(4, 60):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 30)))
        texts.append((k, text))
        for o in range(rng.randint(0, 7)):
            ends = sorted([rng.randint(-3, 33), rng.randint(-3, 33)], reverse=rng.random() < 0.1)
            rows.append((k, *(None if rng.random() < 0.05 else x for x in ends), rng.choice(S.PRECEDENCE), o, rng.choice([None, "", "1", "/u"])))
    spans = spark.createDataFrame(rows, "k int, start int, end int, format string, ord int, attribute string")
    got = {r.k: r.html for r in S.formatted(spark.createDataFrame(texts, "k int, text string"), spans, "k", colors={"1": "red"}).collect()}
    for k, text in texts:
        assert got[k] == _formatted(text or "", [r[1:] for r in rows if r[0] == k]), (k, text)
    assert got[3] == "<h1>Title</h1><p><strong>body</strong> text</p>"


def test_nested_lists(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([0, 0, 1, 2, 2, 5, None]), f"<li>{i}", "") for k in range(12) for i in range(rng.randint(1, 12))]
    got = {r.k: r.html for r in S.nested_list(spark.createDataFrame(rows, "k int, i int, indent int, item string, body string"), "k", "i", "indent", "<ul>", "</ul>").collect()}
    for k in got:
        own, stack, root = [r for r in rows if r[0] == k], [], []
        for _, _, indent, item, _ in own:
            while stack and stack[-1][0] >= (indent or 0):
                stack.pop()
            node = (item, [])
            (stack[-1][1] if stack else root).append(node)
            stack.append((indent or 0, node[1]))
        show = lambda nodes: "<ul>" + "".join(f"{i}{show(c) if c else ''}</li>" for i, c in nodes) + "</ul>"
        assert got[k] == show(root)


def test_hierarchy(spark):
    rows = [(str(i), str(i - 1) if i else None, f"t{i}") for i in range(1000)]
    rows += [("x", "y", "X"), ("y", "z", "Y"), ("z", "x", "Z"), ("tail", "y", "Tail"), ("self", "self", "Self"), ("lost", "missing", "Lost"), ("999", "998", "u"), (None, "1", "null")]
    got = {r.id: r.path for r in J.hierarchy(spark.createDataFrame(rows, "id string, parent_id string, title string")).collect()}
    assert got["999"] == [f"t{i}" for i in range(1000)] and got["0"] == ["t0"] and got["500"][0] == "t0" and len(got) == 1006
    assert got["x"] == ["Z", "Y", "X"] and got["tail"] == ["X", "Z", "Y", "Tail"] and got["self"] == ["Self"] and got["lost"] == ["Lost"]
    assert J.hierarchy(spark.createDataFrame([], "id string, parent_id string, title string")).collect() == []


@pytest.mark.parametrize("size", [7, 1000])
def test_hierarchy_in_ranges(spark, size):
    rng = random.Random(8)
    up = lambda i: None if rng.random() < 0.05 else max(0, i - rng.randint(1, 3)) if i < 60 else rng.randrange(95)
    rows = [(i, up(i), rng.choice([f"t{i}", "é", None])) for i in range(90)]
    of = {i: (p, t) for i, p, t in rows}
    want = {}
    for i in of:
        ids, x = [], i
        while x in of and x not in ids:
            ids.append(x)
            x = of[x][0]
        want[i] = [of[x][1] for x in reversed(ids)]
    got = J.hierarchy(spark.createDataFrame(rows, "id long, parent_id long, title string"), size).collect()
    assert len(got) == 90 and {r.id: r.path for r in got} == want


def test_hierarchy_writes_no_paths(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    held = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    before = held()
    rows = spark.range(16 * 512).select("id", F.when(F.col("id") % 512 > 0, F.col("id") - 1).alias("parent_id"), F.md5(F.col("id").cast("string")).alias("title"))
    deepest = J.hierarchy(rows).agg(F.max(F.size("path")), F.sum(F.size("path"))).first()
    assert deepest[0] == 512 and deepest[1] == 16 * 512 * 513 // 2
    assert held() - before < 100 * 16 * 512


@pytest.mark.parametrize("limit", [J.SHORT_BYTES, 0])
def test_contains_short_and_long_passages(spark, monkeypatch, limit):
    monkeypatch.setattr(J, "SHORT_BYTES", limit)
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["a", "th", "the", "of", "né", "xyz"]) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(90, None), (91, "")]
    passages = [(0, "a"), (1, "th"), (2, "the"), (3, "of a"), (4, "the of né"), (5, "he of th"), (6, ""), (7, None), (8, "a"), (9, "né")]
    want = sorted((i, p) for i, t in texts for p, s in passages if s and s in (t or ""))
    got = J.contains_join(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(passages, "p int, text string"), "i", "p").collect()
    assert sorted((r.i, r.p) for r in got) == want
