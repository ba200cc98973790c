"""Markdown to HTML by lines and blocks: the inline marks by patterns, the blocks by array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blocks(text: Column) -> Column:
    """array<string>: text between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n+"), lambda b: F.trim(b, F.lit("\n"))), lambda b: F.trim(b, F.lit(" \t\n")) != "")


def paragraphs(text: Column) -> Column:
    return F.array_join(F.transform(blocks(text), lambda b: F.concat(F.lit("<p>"), F.replace(b, F.lit("\n"), F.lit(" ")), F.lit("</p>"))), "")


def inline(text: Column) -> Column:
    """Inline marks; a run of code keeps its characters only as far as no mark stands in it."""
    out = F.regexp_replace(text, r"%%[^%]*%% ?", "")
    out = F.regexp_replace(out, r"!\[\[([^\]|#]+)[^\]|]*\|(\d+)x(\d+)\]\]", '<a href="$1" width="$2" height="$3"></a>')
    out = F.regexp_replace(out, r"!\[\[([^\]|#]+)[^\]|]*\|(\d+)\]\]", '<a href="$1" width="$2"></a>')
    out = F.regexp_replace(out, r"!\[\[([^\]|#]+)[^\]]*\]\]", '<a href="$1"></a>')
    out = F.regexp_replace(out, r"!\[([^\]]*)\]\(([^)\s]+)\)", '<img src="$2" alt="$1">')
    out = F.regexp_replace(out, r"\[([^\]]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>')
    out = F.regexp_replace(out, r"`([^`]+)`", "<code>$1</code>")
    out = F.regexp_replace(out, r"(?<![$\w])\$([^$\s](?:[^$]*[^$\s])?)\$(?!\w)", '<span class="math math-inline">$1</span>')
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?<![*\w])\*([^*\s][^*]*)\*", "<em>$1</em>")
    out = F.regexp_replace(out, r"(?<![\w_])_([^_\s](?:[^_]*[^_\s])?)_(?![\w_])", "<em>$1</em>")
    out = F.regexp_replace(out, r"~~([^~]+)~~", "<del>$1</del>")
    out = F.regexp_replace(out, r"(?<!~)~([^~\s]+)~(?!~)", "<sub>$1</sub>")
    out = F.regexp_replace(out, r"\^([^^\s]+)\^", "<sup>$1</sup>")
    even = F.size(F.split(out, "==")) % 2 == 1
    return F.when(even, F.regexp_replace(out, r"==([^=]+)==", '<span style="background-color: rgb(255, 255, 0);">$1</span>')).otherwise(out)


def nested_list(lines: Column, mark: str, open_list: Column, close_list: Column, open_item) -> Column:
    """Items of two blanks a level, folded into nested lists; an item goes at most one level deeper than the one before."""
    level = lambda x: F.floor(F.length(F.regexp_extract(x, r"^(\s*)", 1)) / 2).cast("int")
    up = F.concat(F.lit("\n"), close_list, F.lit("\n</li>"))

    def step(acc: Column, x: Column) -> Column:
        deep = F.least(level(x), acc["depth"] + 1)
        lead = (
            F.when(acc["depth"] < 0, F.concat(open_list, F.lit("\n")))
            .when(deep > acc["depth"], F.concat(F.lit("\n"), open_list, F.lit("\n")))
            .otherwise(F.concat(F.lit("</li>"), F.repeat(up, acc["depth"] - deep), F.lit("\n")))
        )
        return F.struct(F.greatest(deep, F.lit(0)).alias("depth"), F.concat(acc["html"], lead, open_item(x), inline(F.regexp_replace(x, mark, ""))).alias("html"))

    done = lambda acc: F.concat(acc["html"], F.lit("</li>"), F.repeat(up, acc["depth"]), F.lit("\n"), close_list)
    return F.aggregate(lines, F.struct(F.lit(-1).alias("depth"), F.lit("").alias("html")), step, done)


def _block(b: Column) -> Column:
    lines = F.split(b, "\n")
    first = F.get(lines, F.lit(0))
    every = lambda pattern: F.forall(lines, lambda x: x.rlike(pattern))
    grade = F.length(F.regexp_extract(first, "^(#+)", 1)).cast("string")
    heading = F.concat(F.lit("<h"), grade, F.lit(">"), inline(F.regexp_replace(first, r"^#+\s+", "")), F.lit("</h"), grade, F.lit(">"))
    plain = lambda x: F.lit("<li>")
    task = lambda x: F.concat(F.lit('<li class="checklist--item'), F.when(x.rlike(r"^\s*[-*] \[[xX]\]"), " checked").otherwise(""), F.lit('">'))
    hard = r"(?:  +|\\)\n"
    soft = lambda x: inline(F.replace(x, F.lit("\n"), F.lit(" ")))
    single = F.array_join(F.transform(F.split(b, hard), lambda x: F.concat(F.lit('<p data-spacing="single">'), soft(x), F.lit("</p>"))), "\n")
    cells = lambda x, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.concat(F.lit(f"<{tag}>"), inline(F.trim(c)), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    table = F.concat(F.lit("<table><thead>"), cells(first, "th"), F.lit("</thead><tbody>"), F.array_join(F.transform(F.slice(lines, 3, F.size(lines)), lambda x: cells(x, "td")), ""), F.lit("</tbody></table>"))
    return (
        F.when((F.size(lines) == 1) & first.rlike(r"^#{1,6}\s"), heading)
        .when((F.size(lines) == 1) & first.rlike(r"^(\*{3,}|-{3,}|_{3,})\s*$"), F.lit("<hr>"))
        .when(every(r"^\s*[-*] \[[ xX]\]"), nested_list(lines, r"^\s*[-*] \[[ xX]\]\s*", F.lit('<ul class="checklist">'), F.lit("</ul>"), task))
        .when(every(r"^\s*[-*+] "), nested_list(lines, r"^\s*[-*+] ", F.lit("<ul>"), F.lit("</ul>"), plain))
        .when(every(r"^\s*\d+[.)] "), nested_list(lines, r"^\s*\d+[.)] ", F.lit("<ol>"), F.lit("</ol>"), plain))
        .when(every("^>"), F.concat(F.lit("<blockquote>\n<p>"), inline(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^>\s?", "")), " ")), F.lit("</p>\n</blockquote>")))
        .when(b.rlike(r"(?s)\A\$\$\n.*\n\$\$\z"), F.concat(F.lit('<div class="math math-display">'), F.regexp_replace(F.regexp_replace(b, r"\A\$\$\n", ""), r"\n\$\$\z", ""), F.lit("</div>")))
        .when((F.size(lines) > 1) & F.get(lines, F.lit(1)).rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$") & first.contains("|"), table)
        .when(b.rlike(hard), single)
        .otherwise(F.concat(F.lit("<p>"), soft(b), F.lit("</p>")))
    )


def to_html(text: Column) -> Column:
    """Markdown to HTML, a block a line. Between two fences is code; raw tags in prose pass through."""
    plain = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?ms)^%%\n.*?\n%%$", "")
    parts = F.split(plain, r"(?m)^```")
    name = lambda p: F.regexp_extract(p, r"\A([\w+#-]+)", 1)
    of = lambda p: F.when(name(p) != "", F.concat(F.lit(' class="language-'), name(p), F.lit('"'))).otherwise("")
    coded = lambda p: F.replace(F.replace(F.replace(F.regexp_replace(p, r"\A[^\n]*\n", ""), F.lit("&"), F.lit("&#38;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br/>"))
    code = lambda p: F.array(F.concat(F.lit("<pre"), of(p), F.lit("><code"), of(p), F.lit(">"), coded(p), F.lit("</code></pre>")))
    escaped = lambda p: F.regexp_replace(F.regexp_replace(p, r"&(?!#?\w+;)", "&amp;"), r"<(?![a-zA-Z/!])", "&lt;")
    prose = lambda p: F.transform(blocks(escaped(p)), _block)
    html = F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, code(p)).otherwise(prose(p))))
    is_single = lambda x: F.coalesce(x.startswith('<p data-spacing="single">'), F.lit(False))
    gap = lambda x, i: F.when(is_single(x) & (i > 0) & is_single(F.get(html, i - 1)), F.concat(F.lit('<p data-spacing="single"></p>\n'), x)).otherwise(x)
    return F.array_join(F.transform(html, gap), "\n")


#: Front matter: a YAML block of flat keys at the very top.
FRONT_MATTER = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def front_matter(text: Column) -> Column:
    """map<string, string> of the keys; a block list is joined by commas. Empty without front matter."""
    head = F.regexp_replace(F.regexp_extract(text, FRONT_MATTER, 1), r"\r?\n\s*-\s+", ",")
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[\w -]+:"))
    value = lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), r"^,", ""), r"^[\"'\[](.*)[\"'\]]$", "$1")
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), value(x).alias("v")))
    seen = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(seen)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")
