"""The column functions under names of their own in SQL (X6): CREATE TEMPORARY FUNCTION ... RETURN, so they stay expressions that
the optimizer sees, and no code runs per row.

Bodies are SQL of the same definitions as in columns.py; a test holds each against its column.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from notelake.functions import columns as C


def _lookup(key: str, table: dict) -> str:
    quote = lambda x: "'" + str(x).replace("'", "\\'") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {quote(k) if isinstance(k, str) else k} THEN {quote(v)}" for k, v in table.items()) + " END"


#: name: (parameters, type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "path_basename": ("path STRING", "STRING", r"regexp_extract(path, r'([^/\\]*)[/\\]*$', 1)"),
    "path_extname": ("path STRING", "STRING", r"regexp_extract(path_basename(path), r'^.+(\.[^.]*)$', 1)"),
    "path_stem": ("path STRING", "STRING", r"regexp_replace(path_basename(path), r'^(.+)\.[^.]*$', '$1')"),
    "path_dirname": ("path STRING", "STRING", r"CASE WHEN path RLIKE r'[/\\]' THEN regexp_replace(path, r'[/\\]+[^/\\]*$', '') ELSE '.' END"),
    "path_hidden": ("path STRING", "BOOLEAN", "exists(split(path, '/'), s -> startswith(s, '.') AND s NOT IN ('.', '..'))"),
    "filename_sanitized": (
        "name STRING", "STRING",
        r"""lower(substring(regexp_replace(CASE WHEN lower(regexp_replace(regexp_replace(regexp_replace(name, r'\s+', '-'), r'[/?<>\\:*|"]', '-'), r'^\.+$', '-')) RLIKE r'"""
        + C.WINDOWS_RESERVED
        + r"""' THEN '-' ELSE regexp_replace(regexp_replace(regexp_replace(name, r'\s+', '-'), r'[/?<>\\:*|"]', '-'), r'^\.+$', '-') END, r'[. ]+$', '-'), 1, 254))""",
    ),
    "filename_extended": ("name STRING, ext STRING", "STRING", "CASE WHEN path_extname(name) = '' AND ext <> '' THEN concat(name, '.', ext) ELSE name END"),
    "markdown_hard_breaks": ("text STRING", "STRING", r"regexp_replace(text, r'(?<!\n)\n(?!\n)', '  \n')"),
    "first_line_title": ("text STRING", "STRING", r"coalesce(nullif(trim(get(split(text, r'\r\n|\n'), 0)), ''), 'Untitled note')"),
    "tag_cleaned": ("tag STRING", "STRING", "trim(regexp_replace(tag, '^([^#]*)#', '$1'))"),
    "uri_decoded": ("text STRING", "STRING", "coalesce(try_url_decode(replace(text, '+', '%2B')), text)"),
    "color_is_black": ("color STRING", "BOOLEAN", r"lower(regexp_replace(color, r'\s', '')) IN ('#000', '#000000', '#000000ff', 'rgb(0,0,0)')"),
    "iso_basic_millis": ("text STRING", "BIGINT", "CASE WHEN length(text) >= 16 THEN unix_millis(try_to_timestamp(text, \"yyyyMMdd'T'HHmmssX\")) END"),
    "iso_millis": ("text STRING", "BIGINT", "unix_millis(try_to_timestamp(text))"),
    "micros_to_millis": ("us BIGINT", "BIGINT", "floor(us / 1000)"),
    "int_attribute": ("text STRING", "INT", r"try_cast(regexp_extract(text, r'^\s*([+-]?\d{1,9})', 1) AS INT)"),
    "human_size": (
        "size BIGINT", "STRING",
        "concat(CAST(round(size / pow(1024.0D, CASE WHEN size > 0 THEN least(floor(log2(CAST(size AS DOUBLE)) / 10), 4) ELSE 0 END), 2) AS STRING), ' ', "
        "element_at(array('B', 'KB', 'MB', 'GB', 'TB'), CAST(CASE WHEN size > 0 THEN least(floor(log2(CAST(size AS DOUBLE)) / 10), 4) ELSE 0 END + 1 AS INT)))",
    ),
    "missing_dimension": ("given INT, natural_given INT, natural_other INT", "INT", "CAST(floor(given * natural_other / natural_given + 0.5) AS INT)"),
    "note_id_seconds": ("note_id STRING", "BIGINT", "try_cast(conv(substring(note_id, 1, 8), 16, 10) AS BIGINT)"),
    "mime_of_extension": ("ext STRING", "STRING", f"coalesce({_lookup('lower(ltrim(ext))', C.MIME)}, 'application/octet-stream')"),
    "reminder_mode": ("code INT", "STRING", _lookup("code", C.REMINDER_MODES)),
    "web_clip_footer": (
        "url STRING, title STRING", "STRING",
        "CASE WHEN nullif(url, '') IS NOT NULL OR nullif(title, '') IS NOT NULL THEN concat('<hr></hr><p>Clipped from: <a href=\"', coalesce(nullif(url, ''), ''), '\">', coalesce(nullif(title, ''), nullif(url, '')), '</a></p>') ELSE '' END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
