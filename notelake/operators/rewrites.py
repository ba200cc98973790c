"""Rewrites of a note's markup that move elements, on token rows: windows over the tokens of a page, all by one partitioning.

Pages are shuffled once for each PLANNED rewrites, and each rewrite is a constant number of passes over their tokens, however
deep elements nest. What no rewrite touches is written as it was read. Elements that are not closed, stray close
tags and pairs that cross others are tokens like any other and no elements.

A rewrite takes token rows (ROW: key, pos, tok, kind, tag, first, last, own, depth) and gives them back with `out`, the
tokens that stand in each one's place, and may give a token several rows with a `part`, its order among them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.operators import tokens as T
from notelake.scratch import Rounds, staged

#: Elements that may stand in a paragraph, and those that are carried into one with the text beside them.
PHRASING = "a abbr b bdi bdo br cite code data dfn em i img input kbd label mark meter output picture q ruby s samp select small span strong sub sup textarea time u var wbr".split()
INLINE = [t for t in PHRASING if t not in "br img input meter output picture ruby select".split()]
#: Colours of highlights and of text by name.
HIGHLIGHTS = {"orange": "#FAE5CE", "red": "#F9DFDE", "yellow": "#FEF8B0", "green": "#DEFEBF", "blue": "#DBEBFB", "purple": "#EADDFC", "pink": "#FAE5F9", "gray": "#EAEAEA"}
TEXT_COLORS = {"orange": "#EA8D34", "red": "#E54739", "yellow": "#CDAE61", "green": "#5CA033", "blue": "#396FEF", "purple": "#805AF6", "pink": "#D362DB", "gray": "#757575"}

#: The key of pages among token rows, whatever its own name.
PAGE = "__page"

BLANK = r"(?U)\A\s*\z"
BLANK_TEXT = r"(?Ui)\A(?:\s|&nbsp;|&#160;|&#xa0;)*\z"

Rewrite = Callable[[DataFrame, str], DataFrame]


def _set(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _along(key: str, *more: str) -> W:
    return W.partitionBy(key, *more).orderBy("pos")


def _to_here(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, W.currentRow)


def _from_end(key: str, *more: str) -> W:
    """What comes after a token, the nearest last: frames that only grow."""
    return W.partitionBy(key, *more).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)


def _tokens(*tokens: Column | str) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in tokens])


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _opens() -> Column:
    return F.col("first").isNotNull() & (F.col("pos") == F.col("first"))


def _closes() -> Column:
    return F.col("first").isNotNull() & (F.col("pos") == F.col("last")) & (F.col("first") < F.col("last"))


def markup_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, tok) of all tokens, those of a page together."""
    return by_page(pages.select(key, F.posexplode(T.tokenize(F.col(html))).alias("pos", "tok")), key)


def by_page(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a page together, in as many tasks as the session shuffles to: tokens are few bytes for the work they take."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def placed(rows: DataFrame, key: str) -> DataFrame:
    """ROW: first, last and own (the open token) of the element that a token opens, closes or is; depth: elements around that.

    A close token without an open one goes, as a reader of HTML passes over it.
    """
    x = T.paired(rows.withColumns({"kind": T.kind_of(F.col("tok")), "tag": T.tag_of(F.col("tok"))}), key)
    x = x.where((F.col("kind") != "close") | F.col("first").isNotNull())
    of_element = W.partitionBy(key, "__e")
    x = x.withColumn("__e", F.coalesce("first", F.lit(-1)))
    even = F.col("first").isNotNull() & (F.min("depth").over(of_element) == F.max("depth").over(of_element))
    x = x.withColumns({"__even": even, "last": F.max("last").over(of_element), "own": F.max(F.when(F.col("kind") == "open", F.col("tok"))).over(of_element)})
    one = F.col("kind").isin("void", "raw")
    of = lambda c, own: F.when(F.col("__even"), F.col(c)).when(one, F.col(own))
    x = x.withColumns({"first": of("first", "pos"), "last": of("last", "pos"), "own": of("own", "tok")})
    step = F.when(F.col("__even") & _opens(), 1).when(F.col("__even"), -1).otherwise(0)
    depth = F.sum(step).over(_to_here(_along(key))) - F.when(F.col("__even") & _opens(), 1).otherwise(0)
    return x.withColumn("depth", depth).drop("__e", "__even")


def nearest(x: DataFrame, key: str, name: str, target: Column, outermost: bool = False) -> DataFrame:
    """x with the innermost (or outermost) element around each token for which target holds (W7): struct<first, last, tag, own, depth>.

    An element's own tokens have what is around it. The element after a token is the last one that began at its level.
    """
    pair = _set((F.col("first") < F.col("last")) & target)
    opens = pair & _opens()
    x = x.withColumn("__in", F.sum(F.when(opens, 1).when(pair, -1).otherwise(0)).over(_to_here(_along(key))))
    element = F.struct("first", "last", "tag", "own", "depth")
    if outermost:
        cur = F.last(F.when(opens & (F.col("__in") == 1), element), True).over(_to_here(_along(key)))
        inside = F.col("__in") - F.when(opens, 1).otherwise(0) > 0
        return x.withColumn("__cur", cur).withColumn(name, F.when(inside, F.col("__cur"))).drop("__in", "__cur")
    x = x.withColumn("__cur", F.last(F.when(opens, element), True).over(_to_here(_along(key, "__in"))))
    return x.withColumn(name, F.when(opens, F.lag("__cur").over(_along(key))).otherwise(F.col("__cur"))).drop("__in", "__cur")


def told(x: DataFrame, key: str, name: str, at: Column, value: Column) -> DataFrame:
    """x with the greatest value that tokens send to each token, by its position `at`; null where none does."""
    here = F.struct(F.col("pos").alias("to"), F.lit(None).cast("int").alias("v"))
    sent = F.struct(at.alias("to"), value.cast("int").alias("v"))
    both = x.withColumn("__sent", F.explode(F.when(at.isNotNull() & value.isNotNull(), F.array(here, sent)).otherwise(F.array(here))))
    both = both.withColumn("__to", F.col("__sent.to")).withColumn(name, F.max("__sent.v").over(W.partitionBy(key, "__to")))
    return both.where(F.col("__sent.v").isNull()).drop("__sent", "__to")


def without_attribute(tok: Column, name: str) -> Column:
    return F.regexp_replace(tok, rf"""(?is)\s+{name}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)""", "")


def with_attribute(tok: Column, name: str, value: Column) -> Column:
    """An open token with one attribute set, at its end."""
    return F.concat(F.regexp_replace(without_attribute(tok, name), r"\s*/?>?\z", ""), F.lit(f' {name}="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('">'))


def with_class(tok: Column, name: str) -> Column:
    have = F.coalesce(T.attribute(tok, "class"), F.lit(""))
    return F.when(have.contains(name), tok).otherwise(with_attribute(tok, "class", F.trim(F.concat(have, F.lit(f" {name}")))))


def alignment(own: Column) -> Column:
    """text-align of an element's own style; null where it has none."""
    return F.nullif(F.trim(F.regexp_extract(T.attribute(own, "style"), r"(?i)(?:^|;)\s*text-align\s*:([^;]*)", 1)), F.lit(""))


def _class_holds(own: Column, part: str) -> Column:
    return T.attribute(own, "class").contains(part)


def divs_to_paragraphs(x: DataFrame, key: str) -> DataFrame:
    """What may stand in a paragraph becomes one for each run between block elements, and the div around them goes.

    Runs are the children of a div between its blocks, numbered by a running sum of blocks; one that is blank goes where the
    div has a block. A paragraph keeps dir and style, with the nearest alignment around where it has none (W7).
    """
    x = nearest(nearest(x, key, "up", F.lit(True)), key, "aligned", alignment(F.col("own")).isNotNull())
    x = x.withColumns({"__block": F.col("first").isNotNull() & ~F.col("tag").isin(PHRASING), "__div": _set((F.col("tag") == "div") & (F.col("first") < F.col("last"))), "__in": _set(F.col("up.tag") == "div")})
    mine = _along(key, "up.first")
    x = x.withColumns({"__run": F.sum((F.col("__block") & _opens()).cast("int")).over(_to_here(mine)), "__mixed": F.max("__block").over(W.partitionBy(key, "up.first"))})
    of_run = W.partitionBy(key, "up.first", "__run", "__block")
    x = x.withColumns({"__blank": F.min((F.col("kind") == "text") & F.col("tok").rlike(BLANK)).over(of_run), "__a": F.min("pos").over(of_run), "__z": F.max("pos").over(of_run)})

    def paragraph(own: Column) -> Column:
        style, around = F.nullif(T.attribute(own, "style"), F.lit("")), F.when(alignment(own).isNull(), F.concat(F.lit("text-align: "), alignment(F.col("aligned.own"))))
        named = lambda name, v: F.coalesce(F.concat(F.lit(f' {name}="'), F.replace(v, F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit(""))
        return F.concat(F.lit("<p"), named("dir", F.nullif(T.attribute(own, "dir"), F.lit(""))), named("style", F.nullif(F.concat_ws("; ", style, around), F.lit(""))), F.lit(">"))

    run = F.col("__in") & ~F.col("__block")
    kept, gone = run & ~(F.col("__mixed") & F.col("__blank")), run & F.col("__mixed") & F.col("__blank")
    empty = F.when(_opens() & (F.col("last") == F.col("first") + 1), _tokens(paragraph(F.col("own")), "</p>")).otherwise(_nothing())
    before = F.when(kept & (F.col("pos") == F.col("__a")), _tokens(paragraph(F.col("up.own")))).otherwise(_nothing())
    after = F.when(kept & (F.col("pos") == F.col("__z")), _tokens("</p>")).otherwise(_nothing())
    return x.withColumn("out", F.concat(before, F.when(F.col("__div"), empty).when(gone, _nothing()).otherwise(_tokens(F.col("tok"))), after))


def breaks_to_paragraphs(x: DataFrame, key: str) -> DataFrame:
    """A paragraph is cut at its line breaks; outside of one a break makes a paragraph of the text before it.

    Elements that a cut goes through are closed and opened again. From the first break on after which nothing but breaks and
    blanks remains, a paragraph is emptied; a break at its very end goes.
    """
    x = nearest(nearest(x, key, "up", F.lit(True)), key, "para", F.col("tag") == "p")
    inside = F.col("para").isNotNull()
    x = x.withColumn("__br", (F.col("tag") == "br") & (F.col("kind") == "void"))
    br = F.col("__br")
    solid = F.when(((F.col("kind") == "text") & ~F.col("tok").rlike(BLANK_TEXT)) | (F.col("tag").isin(T.VOID) & (F.col("kind") == "void") & ~br), F.col("pos"))
    along, sib = _along(key), _along(key, "up.first")
    inline = F.when(F.col("first").isNotNull(), F.col("tag").isin(INLINE)).otherwise(True)
    x = x.withColumns({
        "__next": F.last(solid, True).over(_from_end(key)), "__prev": F.last(solid, True).over(along.rowsBetween(W.unboundedPreceding, -1)),
        "__start": F.coalesce(F.lag("pos").over(_along(key, "para.first", "__br")), F.col("para.first")), "__edge": ~inline,
    })
    rest_blank = (F.col("__next").isNull() | (F.col("__next") > F.col("para.last"))) & (F.col("__prev").isNull() | (F.col("__prev") <= F.col("__start")))
    none_before = F.coalesce(F.lag("__edge").over(sib), F.lit(True))
    x = x.withColumns({
        "__blank_from": F.min(F.when(inside & br & rest_blank, F.col("__start"))).over(W.partitionBy(key, "para.first")),
        "__bare": none_before, "__to_br": F.last(F.when(F.col("__edge"), br), True).over(_from_end(key, "up.first")),
    })
    x = x.withColumn("__after_bare", F.lag(br & ~inside & F.col("__bare")).over(sib))
    part = lambda tok, level=None, use=0: F.struct(tok.alias("tok"), (F.lit(None).cast("long") if level is None else level).alias("level"), F.lit(use).alias("use"))
    one = lambda c: part(F.lit(c) if isinstance(c, str) else c)
    none = F.array().cast("array<struct<tok:string,level:bigint,use:int>>")
    self = part(F.col("tok"), F.when(_opens() & (F.col("first") < F.col("last")), F.col("depth")))
    single = with_attribute(F.col("para.own"), "data-spacing", F.lit("single"))
    low, high = F.col("para.depth") + 1, F.col("depth") - 1
    around = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))
    no_tok = F.lit(None).cast("string")
    closed = F.transform(F.reverse(around), lambda d: part(no_tok, d, 1))
    again = F.when(F.col("pos") == F.col("__blank_from"), none).otherwise(F.transform(around, lambda d: part(no_tok, d, 2)))
    cut = F.concat(closed, F.array(one("</p>"), one(single)), again)
    fresh = one('<p data-spacing="single">')
    starts = ~inside & ~F.col("__edge") & F.col("__bare") & _set(F.col("__to_br"))
    parts = (
        F.when(inside & _set(F.col("pos") > F.col("__blank_from")), none).when(inside & br & (F.col("pos") + 1 == F.col("para.last")), none).when(inside & br, cut)
        .when(br & F.col("__bare"), F.array(fresh, one("</p>"))).when(br, F.array(one("</p>"))).when(starts, F.array(fresh, self))
        .when((F.col("tag") == "p") & _opens() & _set(F.col("__after_bare")), F.array(part(with_attribute(F.col("tok"), "data-spacing", F.lit("single")), F.col("depth")))).otherwise(F.array(self))
    )
    x = x.select(key, "pos", F.posexplode(parts).alias("part", "p")).select(key, "pos", "part", "p.*")
    held = F.last(F.when((F.col("use") == 0) & F.col("level").isNotNull(), F.col("tok")), True).over(_to_here(W.partitionBy(key, "level").orderBy("pos", "part")))
    x = x.withColumn("__held", held)
    return x.withColumn("out", _tokens(F.when(F.col("use") == 0, F.col("tok")).when(F.col("use") == 1, F.concat(F.lit("</"), T.tag_of(F.col("__held")), F.lit(">"))).otherwise(F.col("__held"))))


def checked_lists(x: DataFrame, key: str) -> DataFrame:
    """Items with data-checked are those of a checklist."""
    done = T.attribute(F.col("own"), "data-checked")
    item = _set((F.col("tag") == "li") & _opens()) & done.isNotNull()
    x = told(nearest(x, key, "up", F.lit(True)), key, "__list", F.when(item & (F.col("up.tag") == "ul"), F.col("up.first")), F.lit(1))
    name = F.concat(F.lit("checklist--item"), F.when(done == "true", F.lit(" checked")).otherwise(F.lit("")))
    new = F.when(item, with_attribute(without_attribute(F.col("tok"), "data-checked"), "class", name)).when(_opens() & F.col("__list").isNotNull(), with_attribute(F.col("tok"), "class", F.lit("checklist")))
    return x.withColumn("out", _tokens(F.coalesce(new, F.col("tok"))))


def colors(tok: Column) -> Column:
    """A span whose class names the colour of a highlight or of text has it in its style instead."""
    new = tok
    for prefix, rule, known in (("shine-highlight-", "background-color", HIGHLIGHTS), ("shine-text-", "color", TEXT_COLORS)):
        table = F.create_map(*[F.lit(v) for name, color in known.items() for v in (prefix + name, color)])
        color = table[F.trim(T.attribute(tok, "class"))]
        styled = with_attribute(without_attribute(tok, "class"), "style", F.concat(F.coalesce(T.attribute(tok, "style"), F.lit("")), F.lit(f"{rule}: "), color, F.lit(";")))
        new = F.when(color.isNotNull(), styled).otherwise(new)
    return F.when(tok.rlike(r"(?i)^<span\s"), new).otherwise(tok)


def collapsibles(x: DataFrame, key: str) -> DataFrame:
    """A section with a title and, after it, content that folds becomes a callout: the title's text and what is in the content.

    Of several titles with text and several contents of a section the first counts; a section without either is left alone,
    and so is one whose content comes first.
    """
    div = F.col("tag") == "div"
    named = lambda name: div & _class_holds(F.col("own"), name)
    section, title, content = named("shine-collapsible-section"), named("shine-section-title-inner"), named("shine-section-content-inner")
    x = nearest(nearest(x, key, "section", section), key, "title", title)
    within = lambda part: F.when(F.col(f"{part}.first") > F.col("section.first"), F.col("section.first"))
    text = (F.col("kind") == "text") & ~F.col("tok").rlike(BLANK_TEXT)
    # the least position is the greatest of the negative ones
    x = told(x, key, "__title", F.when(text, within("title")), -F.col("title.first"))
    x = told(x, key, "__content", F.when(_set(content) & _opens() & (F.col("first") < F.col("last")), F.col("section.first")), -F.col("first"))
    whole = _set(section) & _opens() & (F.col("__title") > F.col("__content"))
    x = x.withColumn("__whole", F.max(whole).over(W.partitionBy(key, "first")))
    # what is inside a section knows it, and by its open token where its parts begin
    x = x.withColumn("own", F.when(_set(whole), F.concat_ws(" ", F.lit("section"), -F.col("__title"), -F.col("__content"))).otherwise(F.col("own")))
    x = nearest(x, key, "fold", F.col("__whole"))
    at = lambda i: F.get(F.split("fold.own", " "), F.lit(i)).cast("int")
    x = x.withColumns({"__t": at(1), "__c": at(2)})
    mine = lambda p: F.col("first") == F.col(p)
    x = nearest(nearest(x, key, "in_title", mine("__t")), key, "in_content", mine("__c"))
    of = lambda part, p: _set(F.col(f"{part}.first") == F.col(p))
    heading = F.when(_opens(), _tokens("<h3>")).otherwise(_tokens("</h3>"))
    inside = (
        F.when(_set(mine("__t")), heading).when(of("in_title", "__t"), F.when(F.col("kind") == "text", _tokens(F.col("tok"))).otherwise(_nothing()))
        .when(of("in_content", "__c"), _tokens(F.col("tok"))).otherwise(_nothing())
    )
    opening = F.when(_opens(), _tokens('<div class="callout" data-callout-type="info">')).otherwise(_tokens(F.col("tok")))
    return x.withColumn("out", F.when(_set(F.col("__whole")), opening).when(F.col("fold").isNull(), _tokens(F.col("tok"))).otherwise(inside))


def code_languages(tok: Column) -> Column:
    """The language of a code block moves to its class."""
    language = F.nullif(T.attribute(tok, "data-code-language"), F.lit(""))
    new = with_attribute(without_attribute(tok, "data-code-language"), "class", F.concat(F.lit("language-"), language))
    return F.when(tok.rlike(r"(?i)^<pre\s") & language.isNotNull(), new).otherwise(tok)


def aligned_blocks(x: DataFrame, key: str) -> DataFrame:
    """The content of an aligned element that is no paragraph goes into one with its style."""
    style = T.attribute(F.col("own"), "style")
    hit = _set((F.col("tag") != "p") & (F.col("first") < F.col("last")) & style.contains("text-align:"))
    opening = F.concat(F.lit('<p style="'), F.replace(style, F.lit('"'), F.lit("&quot;")), F.lit('">'))
    return x.withColumn("out", F.when(hit & _opens(), _tokens(F.col("tok"), opening)).when(hit, _tokens("</p>", F.col("tok"))).otherwise(_tokens(F.col("tok"))))


def todo_items(x: DataFrame, key: str) -> DataFrame:
    """An en-todo marks the item and the list that it stands in, and goes."""
    todo = (F.col("tag") == "en-todo") & F.col("kind").isin("open", "void")
    x = nearest(nearest(x, key, "item", F.col("tag") == "li"), key, "list", F.col("tag") == "ul")
    done = T.attribute(F.col("tok"), "checked") == "true"
    x = told(x, key, "__done", F.when(todo & done, F.col("item.first")), F.lit(1))
    x = told(x, key, "__list", F.when(todo & F.col("item").isNotNull(), F.col("list.first")), F.lit(1))
    new = F.when(_opens() & F.col("__done").isNotNull(), with_class(F.col("tok"), "checked")).when(_opens() & F.col("__list").isNotNull(), with_class(F.col("tok"), "checklist")).otherwise(F.col("tok"))
    return x.withColumn("out", F.when(F.col("tag") == "en-todo", _nothing()).otherwise(_tokens(new)))


def code_blocks(x: DataFrame, key: str) -> DataFrame:
    """A code block, by name or style, becomes a pre with a line of text for each of its children; one inside another is a child."""
    style = F.regexp_replace(F.coalesce(T.attribute(F.col("own"), "style"), F.lit("")), r"\s", "")
    block = (F.col("tag") == "en-codeblock") | ((F.col("tag") == "div") & style.contains("-en-codeblock:true"))
    x = nearest(nearest(x, key, "up", F.lit(True)), key, "block", block, outermost=True)
    child = _set(F.col("up.first") == F.col("block.first")) & ~_closes()
    x = x.withColumn("__later", child & F.lag("pos").over(_along(key, "up.first")).isNotNull())
    ascii_ = F.array_join(F.transform(F.split("tok", ""), lambda c: F.when(F.ascii(c) > 127, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)), "")
    text = F.regexp_replace(F.replace(F.when(F.col("tok").rlike(r"[^\x00-\x7F]"), ascii_).otherwise(F.col("tok")), F.lit('"'), F.lit("&quot;")), r"\r?\n", "<br/>")
    line = F.when(F.col("__later"), _tokens("<br/>")).otherwise(_nothing())
    inside = F.concat(line, F.when(F.col("kind") == "text", _tokens(text)).otherwise(_nothing()))
    own = F.when(_opens(), _tokens("<pre>")).otherwise(_tokens("</pre>"))
    return x.withColumn("out", F.when(F.col("block").isNotNull(), inside).when(_set(block & (F.col("first") < F.col("last"))), own).otherwise(_tokens(F.col("tok"))))


def zoho_checklists(x: DataFrame, key: str) -> DataFrame:
    """An element of class checklist becomes a list of its checkbox elements; what stands between them goes."""
    words = F.split(F.coalesce(T.attribute(F.col("own"), "class"), F.lit("")), r"\s+")
    listed = F.array_contains(words, "checklist") & ~F.col("tag").isin("ul", "li")
    box = (F.col("tag") == "checkbox") & F.col("first").isNotNull()
    x = nearest(nearest(x, key, "list", listed, outermost=True), key, "box", F.col("tag") == "checkbox")
    done = F.lower(T.attribute(F.col("own"), "checked")).isin("true", "1", "checked")
    opening = F.when(done, F.lit('<li class="checked">')).otherwise(F.lit("<li>"))
    item = F.when(F.col("kind") == "void", _tokens(opening, "</li>")).when(_opens(), _tokens(opening)).otherwise(_tokens("</li>"))
    inside = F.when(box, item).when(_set(F.col("box.first") > F.col("list.first")), _tokens(F.col("tok"))).otherwise(_nothing())
    own = F.when(_opens(), _tokens('<ul class="checklist">')).otherwise(_tokens("</ul>"))
    return x.withColumn("out", F.when(F.col("list").isNotNull(), inside).when(_set(listed & (F.col("first") < F.col("last"))), own).otherwise(_tokens(F.col("tok"))))


REWRITES: dict[str, Rewrite] = {
    "div-to-p": divs_to_paragraphs,
    "br-to-p": breaks_to_paragraphs,
    "checked-lists": checked_lists,
    "collapsibles": collapsibles,
    "aligned-blocks": aligned_blocks,
    "en-todo": todo_items,
    "en-codeblock": code_blocks,
    "zn-checklists": zoho_checklists,
}
_CODE_BLOCK = r"\s*".join("en-codeblock")
#: What a page has to match for a rewrite to change anything in it but stray close tags, also after other rewrites of this
#: module: breaks come from code blocks as well, alignments only from alignments and for paragraphs. Others look at all pages.
NEEDS = {
    "div-to-p": "(?i)<div",
    "br-to-p": f"(?i)<br|{_CODE_BLOCK}",
    "checked-lists": "(?i)data-checked",
    "collapsibles": "shine-collapsible-section",
    "aligned-blocks": "(?i)text-align",
    "en-todo": "(?i)<en-todo",
    "en-codeblock": f"(?i){_CODE_BLOCK}",
    "zn-checklists": "checklist",
}
#: Those that look at one token at a time.
TOKEN_REWRITES: dict[str, Callable[[Column], Column]] = {"colors": colors, "code-languages": code_languages}
#: Rewrites of rows in one plan; after them the rows are written and read back, as longer plans take the driver too long.
PLANNED = 2


def register_rewrite(name: str, rule: Rewrite) -> None:
    """A rewrite of the caller's own (X3): ROW to ROW with `out`."""
    REWRITES[name] = rule
    # what it makes may be what another one looks for
    NEEDS.clear()


def without_strays(rows: DataFrame, key: str) -> DataFrame:
    """Rows without the close tokens that have no open one, as placed leaves them."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    of_tag = _along(key, "tag")
    x = rows.withColumns({"kind": T.kind_of(F.col("tok")), "tag": T.tag_of(F.col("tok"))}).withColumn("__sum", F.sum(step).over(_to_here(of_tag)))
    floor = F.least(F.lit(0), F.coalesce(F.min("__sum").over(of_tag.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return x.withColumn("__stray", (F.col("kind") == "close") & (F.col("__sum") < floor)).where(~F.col("__stray")).select(key, "pos", "tok")


def rewrite(pages: DataFrame, key: str, *names: str, html: str = "html") -> DataFrame:
    """(key, html): the pages after the named rewrites, in their order. key names a page; null and empty pages stay what they are.

    A page goes through the rewrites that it has something for (NEEDS). Where the last one isn't among them, its stray close
    tags go at the end.
    """
    rounds, planned = Rounds(pages.sparkSession, "markup"), 0
    by_rows = [name for name in dict.fromkeys(names) if name not in TOKEN_REWRITES]
    last = [name for name in names if name in by_rows][-1:]
    fits = {name: F.coalesce(F.col("html").rlike(NEEDS[name]), F.lit(False)) if name in NEEDS else F.col("html").isNotNull() for name in by_rows}
    pages = staged(pages.select(F.col(key).alias(PAGE), F.col(html).alias("html")).withColumns({f"__fits_{i}": fits[name] for i, name in enumerate(by_rows)}), "pages")
    fit = {name: F.col(f"__fits_{i}") for i, name in enumerate(by_rows)}
    total, *counts = pages.agg(F.count("html"), *[F.count_if(fit[name]) for name in by_rows]).first()
    count = dict(zip(by_rows, counts))
    rows = markup_rows(pages, PAGE)

    def apply(rows: DataFrame, name: str) -> DataFrame:
        x = REWRITES[name](placed(rows, PAGE), PAGE)
        part = F.col("part") if "part" in x.columns else F.lit(0)
        x = x.select(PAGE, "pos", part.alias("part"), F.posexplode("out").alias("i", "tok"))
        return x.select(PAGE, (F.row_number().over(W.partitionBy(PAGE).orderBy("pos", "part", "i")) - 1).alias("pos"), "tok")

    def among(rows: DataFrame, which: Column, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of which only some pages change."""
        rows, some = rounds.put(rows), pages.where(which).select(PAGE)
        rest = rows.join(some, PAGE, "left_anti")
        return change(by_page(rows.join(some, PAGE, "left_semi"), PAGE)).unionByName(rest.select(PAGE, "pos", "tok"))

    for name in names:
        if name in TOKEN_REWRITES:
            rows = rows.withColumn("tok", TOKEN_REWRITES[name](F.col("tok")))
        elif 0 < count[name] < total:
            rows = by_page(rounds.put(among(rows, fit[name], lambda r, name=name: apply(r, name))), PAGE)
            planned = 0
        elif count[name]:
            if planned and planned % PLANNED == 0:
                rows = by_page(rounds.put(rows), PAGE)
            planned += 1
            rows = apply(rows, name)
    for name in last:
        if not count[name]:
            rows = without_strays(rows, PAGE)
        elif count[name] < total:
            rows = among(rows, ~fit[name], lambda r: without_strays(r, PAGE))
    done = rows.groupBy(PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda r: r["tok"]), "").alias("__done"))
    return pages.join(staged(done, "markup"), PAGE, "left").select(F.col(PAGE).alias(key), F.when(F.col("html").isNotNull(), F.coalesce("__done", F.lit(""))).alias("html"))


def task_list(tasks: Column) -> Column:
    """The tasks of a group as a checklist. tasks: array<struct<title, done>>."""
    item = lambda t: F.concat(F.when(t["done"], F.lit('<li class="checked">')).otherwise(F.lit("<li>")), F.coalesce(t["title"], F.lit("")), F.lit("</li>"))
    return F.concat(F.lit('<ul class="checklist">'), F.array_join(F.transform(tasks, item), ""), F.lit("</ul>"))
