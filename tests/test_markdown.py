"""Markdown strings in, HTML strings out."""

import pytest
from pyspark.sql import functions as F

from notelake.functions import markdown as M

# The markup that each construct becomes.
S = '<p data-spacing="single">'
OPEN, DONE = '<li class="checklist--item">', '<li class="checklist--item checked">'
MARK = '<span style="background-color: rgb(255, 255, 0);">'
CASES = [
    # embeds
    ("![[harbour map.png]]", '<p><a href="harbour map.png"></a></p>'),
    ("See ![[boat.gif|64]] and **rest**", '<p>See <a href="boat.gif" width="64"></a> and <strong>rest</strong></p>'),
    ("![[boat.gif|64x32]]", '<p><a href="boat.gif" width="64" height="32"></a></p>'),
    ("![[logbook.pdf#page=3]] ![[logbook.pdf|cover]]", '<p><a href="logbook.pdf"></a> <a href="logbook.pdf"></a></p>'),
    # comments
    ("Tides turn %%check this%% twice a day.", "<p>Tides turn twice a day.</p>"),
    ("before\n\n%%\nhidden\n\n- list\n%%\n\nafter", "<p>before</p>\n<p>after</p>"),
    # task lists
    ("- [x] hoist\n- [ ] reef", f'<ul class="checklist">\n{DONE}hoist</li>\n{OPEN}reef</li>\n</ul>'),
    ("- [ ] deck\n  - [x] bow\n- [ ] hull", f'<ul class="checklist">\n{OPEN}deck\n<ul class="checklist">\n{DONE}bow</li>\n</ul>\n</li>\n{OPEN}hull</li>\n</ul>'),
    # fences
    ("```sql\nselect 1\n\nwhere a<b\n```", '<pre class="language-sql"><code class="language-sql">select 1<br/><br/>where a&lt;b<br/></code></pre>'),
    ("```\nsalt & rope\n```", "<pre><code>salt &#38; rope<br/></code></pre>"),
    # inline marks
    ("run `ls -l` now", "<p>run <code>ls -l</code> now</p>"),
    ("area $a^2$", '<p>area <span class="math math-inline">a^2</span></p>'),
    ("$$\nv = s / t\n$$", '<div class="math math-display">v = s / t</div>'),
    ("CO~2~ and x^3^", "<p>CO<sub>2</sub> and x<sup>3</sup></p>"),
    ("a ==bright== star, ==odd", "<p>a ==bright== star, ==odd</p>"),
    ("a ==bright== star", f"<p>a {MARK}bright</span> star</p>"),
    ("*one* **two** ~~three~~ ~four~", "<p><em>one</em> <strong>two</strong> <del>three</del> <sub>four</sub></p>"),
    # paragraphs and breaks
    ("rain\nand wind\n\nsun", "<p>rain and wind</p>\n<p>sun</p>"),
    ("first  \nsecond\\\nthird\n\nlast", f"{S}first</p>\n{S}second</p>\n{S}third</p>\n<p>last</p>"),
    ("a  \nb\n\nc  \nd", f"{S}a</p>\n{S}b</p>\n{S}</p>\n{S}c</p>\n{S}d</p>"),
    # blocks
    ("## Log\n\n* am\n* pm\n\n> calm\n> seas\n\n1. up\n2. down", "<h2>Log</h2>\n<ul>\n<li>am</li>\n<li>pm</li>\n</ul>\n<blockquote>\n<p>calm seas</p>\n</blockquote>\n<ol>\n<li>up</li>\n<li>down</li>\n</ol>"),
    ("", ""),
]


def test_markdown(spark):
    rows = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "i int, text string").select("i", M.to_html(F.col("text")).alias("html"))
    got = {r.i: r.html for r in rows.collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


@pytest.mark.parametrize(
    ("text", "keys", "rest"),
    [
        ("---\ntitle: Night watch\ntags:\n  - sea\n  - #sky\npinned: true\n---\nbody\n---\n", {"title": "Night watch", "tags": "sea,#sky", "pinned": "true"}, "body\n---\n"),
        ("no front matter\n---\n", {}, "no front matter\n---\n"),
        ("---\na: 1\na: 2\n---\n", {"a": "2"}, ""),
    ],
)
def test_front_matter(spark, text, keys, rest):
    row = spark.createDataFrame([(text,)], "t string").select(M.front_matter(F.col("t")).alias("m"), M.without_front_matter(F.col("t")).alias("r")).first()
    assert row.m == keys and row.r == rest
