"""Each SQL function against its column."""

import pytest
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.functions import sql as Q

TEXTS = [None, "", "a", "a/b.c.txt", "\\x\\.hid", "/.git/x", "./a", "con.txt", "a  b?*.", "...", "#t a#b", "x#y ", "%41+%zz", "a%20b", " #0 00", "rgb(0, 0, 0)", "20200102T030405Z", "2020-01-02T03:04:05Z", "12px", "-7", "l1\nl2\n\nl3", "\r\nz", "PNG", "pdf", "5e0c1d2f00", "x.", "é" * 300]
COLUMNS = {
    "path_basename": C.basename, "path_extname": C.extname, "path_stem": C.stem, "path_dirname": C.dirname, "path_hidden": C.is_hidden, "filename_sanitized": C.sanitize_filename, "markdown_hard_breaks": C.hard_breaks,
    "first_line_title": C.first_line_title, "tag_cleaned": C.clean_tag, "uri_decoded": C.decode_uri, "color_is_black": C.is_black, "iso_basic_millis": C.iso_basic_millis, "iso_millis": C.iso_millis, "int_attribute": C.int_attribute,
    "note_id_seconds": C.id_seconds, "mime_of_extension": C.mime_of,
}
NUMBERS = {"micros_to_millis": C.micros_to_millis, "human_size": C.human_size, "reminder_mode": lambda c: C.lookup(c, C.REMINDER_MODES)}


@pytest.fixture(scope="module")
def table(spark):
    assert set(Q.register(spark)) == {*COLUMNS, *NUMBERS, "filename_extended", "missing_dimension", "web_clip_footer"}
    spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(TEXTS, [None, 0, 1, 16, 32, 48, 80, 96, 112, 999, 1024, 1536, 10**6, 10**10, 10**13, 5 * 10**14] + [7] * 20))], "i int, t string, n bigint").createOrReplaceTempView("texts")
    return spark.table("texts")


def test_each_equals_its_column(spark, table):
    made = [f"{n}(t) AS {n}" for n in COLUMNS] + [f"{n}({'CAST(n AS INT)' if n == 'reminder_mode' else 'n'}) AS {n}" for n in NUMBERS if n != "reminder_mode"] + ["reminder_mode(try_cast(n AS INT)) AS reminder_mode"]
    made += ["filename_extended(t, 'md') AS filename_extended", "missing_dimension(CAST(i AS INT), 3, 2) AS missing_dimension", "web_clip_footer(t, nullif(t, 'a')) AS web_clip_footer"]
    by_sql = spark.sql(f"SELECT i, {', '.join(made)} FROM texts").orderBy("i").collect()
    columns = {n: f(F.col("t")) for n, f in COLUMNS.items()} | {n: f(F.col("n").try_cast("int") if n == "reminder_mode" else F.col("n")) for n, f in NUMBERS.items()}
    columns |= {"filename_extended": C.append_extension(F.col("t"), F.lit("md")), "missing_dimension": C.missing_dimension(F.col("i"), F.lit(3), F.lit(2)), "web_clip_footer": C.web_clip_footer(F.col("t"), F.nullif("t", F.lit("a")))}
    by_column = table.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    for a, b in zip(by_sql, by_column, strict=True):
        for n in columns:
            assert a[n] == b[n], (n, TEXTS[a.i])
