"""The queries without SQL against brute force, on the smallest tables."""

import hashlib
import random

from notelake.plans import whole
from tests.test_markdown import CASES

SF = "/root/testdata/sf0.001"


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def test_package_holds_every_document(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        note = f'{{"title":"{r.lang}","source":"{r.source}"}}'
        want[f"{_md5(note)}/note.json"] = len(note.encode())
        want[f"{_md5(note)}/attachments/{_md5(r.text)}"] = len(r.text.encode())
    got = whole.package_paths_all(spark, SF).collect()
    assert len(got) == len(want) and {r.path: r.size for r in got} == want


def test_segments_cover_whole_texts(spark):
    want, past = [], 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(r.text)
        spans = [(s := r.doc_id * 7919 * k % (n + 1), s + n // (k + 1) + 5 * k, f) for k, f in ((1, "bold"), (2, "italic"), (3, "url"))]
        past += sum(e > n for _, e, _ in spans)
        cuts = sorted({0, n} | {b for s, e, _ in spans for b in (s, e) if b <= n})
        want += [(r.doc_id, a, b, ",".join(f for s, e, f in spans if s <= a and e >= b)) for a, b in zip(cuts, cuts[1:])]
    got = [tuple(r) for r in whole.span_segments_all(spark, SF).select("doc_id", "start", "stop", "formats").collect()]
    assert sorted(got) == sorted(want)
    assert past and max(b for _, _, b, _ in got) > 50


def _written(rng: random.Random) -> tuple[str, str]:
    """Markdown of several blocks and its HTML, both written from the same words."""
    word = lambda: "".join(rng.choices("abcdeé0123,:", k=rng.randint(2, 7))) + "x"
    a, b, c, d = (word() for _ in range(4))
    n = rng.randint(1, 6)
    kinds = [
        (f"{'#' * n} {a} {b}", f"<h{n}>{a} {b}</h{n}>"),
        (f"- {a}\n- {b}\n  - **{c}**", f"<ul>\n<li>{a}</li>\n<li>{b}\n<ul>\n<li><strong>{c}</strong></li>\n</ul>\n</li>\n</ul>"),
        (f"1. {a}\n2. {b}", f"<ol>\n<li>{a}</li>\n<li>{b}</li>\n</ol>"),
        (f"| {a} | {b} |\n|---|---|\n| {c} | *{d}* |", f"<table><thead><tr><th>{a}</th><th>{b}</th></tr></thead><tbody><tr><td>{c}</td><td><em>{d}</em></td></tr></tbody></table>"),
        (f"> {a}\n> {b}", f"<blockquote>\n<p>{a} {b}</p>\n</blockquote>"),
        (f"{a} [{b}](/{n})\n~~{c}~~ & `{d}`", f'<p>{a} <a href="/{n}">{b}</a> <del>{c}</del> &amp; <code>{d}</code></p>'),
        (f"```\n{a} < {b}\n\n{c}\n```", f"<pre><code>{a} &lt; {b}<br/><br/>{c}<br/></code></pre>"),
        ("---", "<hr>"),
    ]
    blocks = rng.choices(kinds, k=rng.randint(1, 12))
    return "\n\n".join(m for m, _ in blocks), "\n".join(h for _, h in blocks)


def test_markdown_of_whole_documents(spark, tmp_path):
    rng = random.Random(3)
    texts = [*CASES, *(_written(rng) for _ in range(150))]
    spark.createDataFrame([(i, m) for i, (m, _) in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.html_md5 for r in whole.markdown_html(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    assert not [(m, h) for i, (m, h) in enumerate(texts) if got[i] != _md5(h)]
