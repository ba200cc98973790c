"""Column expressions on paths, names, text, dates and colours. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- paths


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def extname(path: Column) -> Column:
    """'.ext' of the last part; '' for none and for dot-files."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def dirname(path: Column) -> Column:
    return F.when(path.rlike(r"[/\\]"), F.regexp_replace(path, r"[/\\]+[^/\\]*$", "")).otherwise(F.lit("."))


def normalize_path(path: Column) -> Column:
    """Resolve '.' and '..' and close up slashes; a leading slash stays."""
    parts = F.filter(F.split(path, r"[/\\]+"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def join_path(a: Column, b: Column) -> Column:
    return normalize_path(F.concat_ws("/", a, b))


def is_hidden(path: Column) -> Column:
    """The name or any folder begins with a dot."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") & ~s.isin(".", ".."))


def notebook_path(directory: Column) -> Column:
    """Folders below an archive's first one: the archive and that folder are no notebooks."""
    parts = F.split(directory, r"[/\\]")
    return F.filter(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), lambda s: s != "")


#: Names that Windows keeps for devices, with the first part of a name before a dot.
WINDOWS_RESERVED = r"^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"


def sanitize_filename(name: Column, replacement: str = "-") -> Column:
    out = F.regexp_replace(name, r"\s+", replacement)
    out = F.regexp_replace(out, r'[/?<>\\:*|"]', replacement)
    out = F.regexp_replace(out, r"^\.+$", replacement)
    out = F.when(F.lower(out).rlike(WINDOWS_RESERVED), F.lit(replacement)).otherwise(out)
    out = F.regexp_replace(out, r"[. ]+$", replacement)
    return F.lower(F.substring(out, 1, 254))


def append_extension(name: Column, ext: Column) -> Column:
    """name.ext where name has no extension of its own."""
    return F.when((extname(name) == "") & (ext != ""), F.concat(name, F.lit("."), ext)).otherwise(name)


# ---- text


def encode_entities(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    coded = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(F.ascii(c) > 127, F.concat(F.lit("&#x"), F.lower(F.hex(F.ascii(c).cast("long"))), F.lit(";"))).otherwise(c)), "")
    return F.when(out.rlike(r"[^\x00-\x7F]"), coded).otherwise(out)


def encode_line(line: Column) -> Column:
    """Entities, and no-break spaces for a leading space and for runs of spaces."""
    return F.regexp_replace(encode_entities(line), r"^ |(?<= ) | (?= )", "&nbsp;")


def text_to_html(text: Column) -> Column:
    paragraph = lambda x: F.concat(F.lit('<p data-spacing="single">'), encode_line(x), F.lit("</p>"))
    return F.array_join(F.transform(F.split(text, "\r\n|\n"), paragraph), "")


def hard_breaks(text: Column) -> Column:
    """A lone newline becomes a Markdown hard break."""
    return F.regexp_replace(text, r"(?<!\n)\n(?!\n)", "  \n")


def first_line_title(text: Column, default: str = "Untitled note") -> Column:
    return F.coalesce(F.nullif(F.trim(F.get(F.split(text, "\r\n|\n"), F.lit(0))), F.lit("")), F.lit(default))


def clean_tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(tag, r"^([^#]*)#", "$1"))


def checklist_html(items: Column) -> Column:
    """items: array<struct<text, checked>>."""
    item = lambda x: F.concat(F.when(x["checked"], F.lit('<li class="checklist--item checked">')).otherwise(F.lit('<li class="checklist--item">')), F.lit("<p>"), encode_entities(x["text"]), F.lit("</p></li>"))
    return F.concat(F.lit('<ul class="checklist">'), F.array_join(F.transform(items, item), ""), F.lit("</ul>"))


def bracket_checklist(text: Column) -> Column:
    """Lines '[V] x' and '[ ] x' as a list; other lines are dropped; none at all gives an empty paragraph."""
    lines = F.filter(F.split(text, "\r\n|\n"), lambda x: x.rlike(r"^\[[V ]\]"))
    item = lambda x: F.concat(F.when(x.startswith("[V]"), F.lit('<li class="simple-checklist--item checked">')).otherwise(F.lit('<li class="simple-checklist--item">')), F.regexp_replace(x, r"^\[[V ]\]\s*", ""), F.lit("</li>"))
    return F.when(F.size(lines) == 0, F.lit("<p></p>")).otherwise(F.concat(F.lit('<ul class="simple-checklist">'), F.array_join(F.transform(lines, item), ""), F.lit("</ul>")))


def decode_uri(text: Column) -> Column:
    """Percent decoding that leaves '+' alone; malformed input stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


# ---- styles and colours

KEPT_STYLES = ["background-color", "color", "text-align", "font-family", "font-size"]


def is_black(color: Column) -> Column:
    return F.lower(F.regexp_replace(color, r"\s", "")).isin("#000", "#000000", "#000000ff", "rgb(0,0,0)")


def filter_style(style: Column, kept: list[str] | None = None) -> Column:
    """The declarations that a note keeps, in order; black text is the default and goes."""
    pair = lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("k"), F.trim(F.regexp_replace(d, "^[^:]*:", "")).alias("v"))
    pairs = F.transform(F.filter(F.split(style, ";"), lambda d: d.contains(":")), pair)
    good = F.filter(pairs, lambda p: p["k"].isin(kept or KEPT_STYLES) & (p["v"] != "") & ~((p["k"] == "color") & is_black(p["v"])))
    return F.array_join(F.transform(good, lambda p: F.concat(p["k"], F.lit(": "), p["v"])), "; ")


#: Colours by name, as the driver's queries use them.
KEEP_COLORS = {"DEFAULT": "#ffffff", "RED": "#f28b82", "ORANGE": "#fbbc04", "YELLOW": "#fff475", "GREEN": "#ccff90", "TEAL": "#a7ffeb", "BLUE": "#aecbfa", "PURPLE": "#d7aefb", "PINK": "#fdcfe8", "BROWN": "#e6c9a8", "GRAY": "#e8eaed"}


def lookup(key: Column, table: dict) -> Column:
    """The table's value for key; null for others."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


# ---- dates and numbers


def iso_basic_millis(text: Column) -> Column:
    """yyyyMMddTHHmmssZ to epoch milliseconds; shorter or invalid text is null."""
    return F.when(F.length(text) >= 16, F.unix_millis(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssX"))))


def iso_millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def micros_to_millis(us: Column) -> Column:
    return F.floor(us / 1000)


def first_true(*columns: Column) -> Column:
    """The first that is neither null nor 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in columns])


def int_attribute(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?\d{1,9})", 1).try_cast("int")


def human_size(size: Column, decimals: int = 2) -> Column:
    unit = F.when(size > 0, F.least(F.floor(F.log2(size.cast("double")) / 10), F.lit(4))).otherwise(F.lit(0))
    name = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), (unit + 1).cast("int"))
    return F.concat(F.round(size / F.pow(F.lit(1024.0), unit), decimals).cast("string"), F.lit(" "), name)


def missing_dimension(given: Column, natural_given: Column, natural_other: Column) -> Column:
    """The other side at the natural ratio, rounded half up."""
    return F.floor(given * natural_other / natural_given + 0.5).cast("int")


def deterministic_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def id_seconds(note_id: Column) -> Column:
    return F.conv(F.substring(note_id, 1, 8), 16, 10).try_cast("long")


#: MIME types by extension that attachments meet; others are octet-stream.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp", "pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "md": "text/markdown", "json": "application/json", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "zip": "application/zip"}
#: First bytes, as hex, of the types that are recognised by content.
SIGNATURES = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "424D": "image/bmp", "25504446": "application/pdf", "504B0304": "application/zip", "49443303": "audio/mpeg", "00000100": "image/x-icon", "49492A00": "image/tiff"}


def mime_of(ext: Column, given: Column | None = None, content: Column | None = None) -> Column:
    found = F.lit(None).cast("string")
    if content is not None:
        head = F.hex(F.substring(content, 1, 8))
        for k, v in SIGNATURES.items():
            found = F.when(head.startswith(k), F.lit(v)).otherwise(found)
    return F.coalesce(found, F.nullif(given, F.lit("")) if given is not None else F.lit(None).cast("string"), lookup(F.lower(F.ltrim(ext)), MIME), F.lit("application/octet-stream"))


#: MIME types by extension of imported resources.
RESOURCE_MIME = {"jpg": "image/jpg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "ico": "image/vnd.microsoft.icon", "tiff": "image/tiff", "tif": "image/tiff", "svg": "image/svg+xml", "svgz": "image/svg+xml", "pdf": "application/pdf"}
#: Extensions of the recognised types.
SNIFFED_EXT = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "application/pdf": "pdf", "application/zip": "zip", "audio/mpeg": "mp3", "image/x-icon": "ico", "image/tiff": "tif", "image/webp": "webp", "audio/wav": "wav", "video/mp4": "mp4"}


def sniffed(content: Column) -> Column:
    """struct<mime, ext> by the first bytes; fields are null where they are not recognised."""
    head = F.hex(F.substring(content, 1, 12))
    found = F.lit(None).cast("string")
    for k, v in SIGNATURES.items():
        found = F.when(head.startswith(k), F.lit(v)).otherwise(found)
    riff = lambda kind: head.startswith("52494646") & (F.substring(head, 17, 8) == kind)
    found = F.when(riff("57454250"), "image/webp").when(riff("57415645"), "audio/wav").when(F.substring(head, 9, 8) == "66747970", "video/mp4").otherwise(found)
    return F.struct(found.alias("mime"), lookup(found, SNIFFED_EXT).alias("ext"))


def attachment_html(filename: Column, size: Column, hash_: Column, mime: Column, width: Column, height: Column, url: Column | None = None, title: Column | None = None) -> Column:
    """An image, the frame of a web clip, or a span that stands for the file; attributes in a fixed order, empty ones left out."""
    attr = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0"), F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"'))).otherwise(F.lit(""))
    attrs = F.concat(F.lit('class="attachment"'), attr("data-filename", filename), attr("data-size", size), attr("data-hash", hash_), attr("data-mime", mime), attr("width", width), attr("height", height))
    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    # fixed markup
    image = F.concat(F.lit("<img "), attrs, F.lit(' alt="'), text(filename), F.lit('" />'))
    clip = F.concat(F.lit('<iframe class="web-clip" '), attrs, F.lit(' src="'), text(url), F.lit('" title="'), text(title), F.lit('">&nbsp;</iframe>'))
    block = F.concat(F.lit("<span "), attrs, F.lit(' contenteditable="false" title="'), text(filename), F.lit('">\n      <em>&nbsp;</em>\n      <span class="filename">'), text(filename), F.lit("</span>\n    </span>"))
    return F.when(mime.startswith("image/"), image).when(mime.endswith(".web-clip"), clip).otherwise(block)


def data_url(url: Column) -> Column:
    """struct<mime, data> of a base64 image URL; null for others."""
    m = r"(?s)^data:(image/[^;,]+);base64,(.+)$"
    raw = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(url, m, 2), F.lit("+"), F.lit("%2B"))), F.lit("")), r"\s", "")
    return F.when(url.rlike(m), F.struct(F.regexp_extract(url, m, 1).alias("mime"), F.try_to_binary(raw, F.lit("base64")).alias("data")))


def web_clip_footer(url: Column, title: Column) -> Column:
    """What follows a web clip: where it comes from; nothing without an address and a title."""
    url, title = (F.nullif(c, F.lit("")) for c in (url, title))
    link = F.concat(F.lit('<hr></hr><p>Clipped from: <a href="'), F.coalesce(url, F.lit("")), F.lit('">'), F.coalesce(title, url), F.lit("</a></p>"))
    return F.when(url.isNotNull() | title.isNotNull(), link).otherwise(F.lit(""))


def is_evernote_link(url: Column) -> Column:
    """A link to a note of the same app: by its own scheme, or by the web address of a shared note."""
    parts = lambda rest: F.size(F.filter(F.split(rest, "/"), lambda x: x != ""))
    own, web = r"(?i)^evernote:///view/(.*)$", r"(?i)^https?://www\.evernote\.com/shard/([^?#]*).*$"
    return F.when(url.rlike(own), parts(F.regexp_extract(url, own, 1)) >= 4).when(url.rlike(web), parts(F.regexp_extract(url, web, 1)) >= 4).otherwise(False)


def styles(style: Column) -> Column:
    """map<property, value> of an inline style; of a repeated property the last value counts."""
    pairs = F.filter(F.transform(F.split(F.coalesce(style, F.lit("")), ";"), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))), F.trim(F.regexp_replace(x, "^[^:]*:", "")), x.contains(":").alias("ok"))), lambda x: x["ok"])
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda o: o["col1"] == p["col1"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["col1"], p["col2"])))


def element_type(style: Column) -> Column:
    """What an ENEX element stands for, by its style: a web clip, code, a task group or a rich link; null for others."""
    m = styles(style)
    on = lambda k: F.coalesce(m[k], F.lit("false")) == "true"
    return F.when(m["--en-clipped-content"].isNotNull(), "en-webclip").when(on("--en-codeblock") | on("-en-codeblock"), "en-codeblock").when(on("--en-task-group") | on("-en-task-group"), "en-task-group").when(on("--en-richlink"), "en-richlink")


def distinct_tags(tags: Column) -> Column:
    """Tags in the order of their first occurrence, without the leading '#' and empty ones (A3)."""
    return F.array_distinct(F.filter(F.transform(tags, clean_tag), lambda t: t != ""))


def xml_text(c: Column) -> Column:
    """Character data of XML: the five entities and decimal or hexadecimal references, each once."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)&#?\w+;|[^&]+|&"), F.lit(0))
    code = lambda t: F.when(t.rlike("^&#x[0-9a-fA-F]{1,6};$"), F.conv(F.regexp_extract(t, "^&#x([0-9a-fA-F]+);", 1), 16, 10)).when(t.rlike("^&#[0-9]{1,7};$"), F.regexp_extract(t, "^&#([0-9]+);", 1)).cast("int")
    utf8 = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    named = lambda t: lookup(t, {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"})
    return F.array_join(F.transform(parts, lambda t: F.coalesce(named(t), F.when(code(t).between(1, 0xD7FF) | code(t).between(0xE000, 0x10FFFF), utf8(code(t))), t)), "")


# ---- reminders

#: Codes of a repeating reminder.
REMINDER_MODES = {16: "day", 32: "week", 48: "week", 80: "month", 96: "month", 112: "year"}
#: Fixed value: the code of every working day, Monday to Friday.
WORKING_DAYS = 32


def reminder(code: Column, base: Column, date: Column) -> Column:
    """struct<date, mode, recurring_mode, selected_days>; null where there is no date. Days of the week or month; Sunday is 0.

    A code that is null, 0 or unknown is a reminder that comes once.
    """
    at = first_true(base, date)
    when = F.timestamp_millis(at)
    kind = lookup(code, REMINDER_MODES)
    days = F.when(code == WORKING_DAYS, F.array(*[F.lit(d) for d in range(1, 6)])).when(kind == "week", F.array(F.dayofweek(when) - 1)).when(kind == "month", F.array(F.dayofmonth(when)))
    return F.when(at.isNotNull(), F.struct(at.alias("date"), F.when(kind.isNotNull(), F.lit("repeat")).otherwise(F.lit("once")).alias("mode"), kind.alias("recurring_mode"), days.alias("selected_days")))
