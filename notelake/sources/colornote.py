"""ColorNote backups: encrypted files whose text holds notes, folders and settings as JSON objects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.operators import joins as J
from notelake.operators import spans as S
from notelake.scratch import staged
from notelake.sources.files import visible
from notelake.sources.notes import ImportResult, live_records, note_rows

#: Fixed values of the backup's format: what is hashed with a password, the bytes before the cipher text, the least size.
SALT, HEADER, LEAST = b"ColorNote Fixed Salt", 28, 44
#: Colours by index, and names of highlights that are no colour of CSS.
COLORS = {1: "red", 2: "orange", 3: "yellow", 4: "green", 5: "blue", 6: "purple", 7: "black", 8: "gray", 9: "white"}
HIGHLIGHTS = {"highlight_purple": "purple"}
#: Types of records.
FOLDER, CHECKLIST, ARCHIVE = 128, 16, 16
RECORD = "title string, note string, note_ext string, encrypted bigint, modified_date bigint, active_state bigint, space bigint, type bigint, folder_id bigint, color_index bigint, created_date bigint, reminder_repeat bigint, reminder_date bigint, reminder_base bigint"
FORMATS = "format_list array<struct<format: string, start: int, end: int, attribute: string>>"
#: Stands after a character of two code units, so that positions in code units are positions of characters.
FILLER = "\ufdd0"


def cipher(password: Column) -> tuple[Column, Column]:
    """(key, initial vector) of a password, each the MD5 of what comes before it, the password and the salt."""
    secret = F.concat(F.encode(password, "utf-8"), F.lit(SALT))
    key = F.unhex(F.md5(secret))
    return key, F.unhex(F.md5(F.concat(key, secret)))


def decrypted(content: Column, password: Column) -> Column:
    """The text of a backup; null where the password doesn't fit. Invalid UTF-8 becomes U+FFFD."""
    key, iv = cipher(password)
    data = F.try_aes_decrypt(F.concat(iv, F.substring(content, HEADER + 1, 2**31 - 1)), key, F.lit("CBC"), F.lit("PKCS"))
    return F.make_valid_utf8(data.cast("string"))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each JSON object of a text that is not inside another, with its number; what lies between is passed over."""
    read = json.JSONDecoder(parse_constant=_no_constant).raw_decode
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string()))], ["path", "ord", "json"])
    rows = []
    for batch in batches:
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            at, n = text.find("{"), 0
            while at >= 0:
                try:
                    end = read(text, at)[1]
                    rows.append((path, n, text[at:end]))
                    n += 1
                except (ValueError, RecursionError):  # no object begins here
                    end = at + 1
                at = text.find("{", end)
                if len(rows) == 1000:
                    yield pack(rows)
                    rows = []
    if rows:
        yield pack(rows)


def _given(c: str) -> Column:
    """Neither null nor 0."""
    return F.coalesce(F.col(c) != 0, F.lit(False))


def _bodies(notes: DataFrame) -> DataFrame:
    """(src_path, html) of notes: checklists (F15), formatted text (W1 to W3), plain text.

    Positions of formats count code units of UTF-16; a format that ends within a character takes all of it.
    """
    text = F.coalesce("note", F.lit(""))
    x = notes.withColumn("formats", F.from_json("note_ext", FORMATS)["format_list"])
    rich = (F.coalesce("type", F.lit(0)) != CHECKLIST) & (F.coalesce(F.size("formats"), F.lit(0)) > 0)
    plain = x.where(~rich).select("src_path", F.when(F.col("type") == CHECKLIST, C.bracket_checklist(text)).otherwise(C.text_to_html(text)).alias("html"))
    x = x.where(rich)
    filled = x.select("src_path", F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "$0" + FILLER).alias("text"))
    spans = x.select("src_path", F.posexplode("formats").alias("ord", "f")).select("src_path", "ord", "f.*")
    return plain.unionByName(S.formatted(filled, spans, "src_path", colors=HIGHLIGHTS).withColumn("html", F.replace("html", F.lit(FILLER), F.lit(""))))


def colornote(files: DataFrame, passwords: DataFrame | None = None) -> ImportResult:
    """Notes of backups (S14). passwords: (name, password), of files by their names; of more than one the least is tried.

    A file without a password, too small, or not to be decrypted is an error row. A record without a date of creation or
    change is one too, but stays a note. Settings, folders, encrypted, deleted and archived-away records are no notes (F4).
    A note's folder is the record of a folder with its id in the same file, the last of them (J9).
    """
    f = visible(files, ["backup", "db", "dat"]).select("path", "name", "content")
    if passwords is None:
        f = f.withColumn("password", F.lit(None).cast("string"))
    else:
        f = f.join(passwords.groupBy("name").agg(F.min("password").alias("password")), "name", "left")
    text = F.when(F.length("content") >= LEAST, decrypted(F.col("content"), F.col("password")))
    message = F.when(F.coalesce("password", F.lit("")) == "", "Password is required to decrypt backup file.").when(F.length("content") < LEAST, "Data is too small to be a valid backup.").when(F.col("text").isNull(), "Decryption failed. Incorrect password or corrupted file.")
    f = f.withColumn("text", text).select("path", "text", message.alias("message"))
    broken = f.where(F.col("message").isNotNull()).select(F.col("path").alias("src_path"), F.lit(None).cast("string").alias("note_title"), "message")

    x = f.where(F.col("message").isNull()).select("path", "text").mapInArrow(_objects, "path string, ord int, json string")
    x = staged(x.select("path", F.concat_ws("#", "path", "ord").alias("src_path"), "ord", F.from_json("json", RECORD).alias("r")).select("path", "src_path", "ord", "r.*"), "colornote")
    undated = x.where(~_given("created_date") | ~_given("modified_date")).select("src_path", F.col("title").alias("note_title"), F.lit("Invalid note. created_date & modified_date properties are required.").alias("message"))
    title = F.nullif("title", F.lit(""))
    folders = x.where(F.col("type") == FOLDER).select("path", F.from_json("note", "folder_id bigint")["folder_id"].alias("folder_id"), "ord", title.alias("folder")).where(_given("folder_id") & F.col("folder").isNotNull())
    notes = live_records(x)
    out = notes.join(J.last_wins(folders, ["path", "folder_id"], "ord").drop("ord"), ["path", "folder_id"], "left").join(_bodies(notes), "src_path")
    due = C.reminder(F.col("reminder_repeat"), F.col("reminder_base"), F.col("reminder_date"))
    due = F.when(due.isNotNull(), F.struct(F.coalesce(title, F.lit("Reminder")).alias("title"), F.col("note").alias("description"), *[due[k].alias(k) for k in ("date", "mode", "recurring_mode", "selected_days")]))
    out = note_rows(
        out, "colornote", src_path=F.col("src_path"), title=F.coalesce(title, F.lit("Untitled note")), html=F.col("html"), date_created=F.col("created_date"), date_edited=F.col("modified_date"),
        color=C.lookup(F.col("color_index"), COLORS), archived=F.when(F.col("space") == ARCHIVE, True), reminder=due, notebooks=F.when(F.col("folder").isNotNull(), F.array(F.array("folder"))),
    )
    return ImportResult(out, broken.unionByName(undated))
