"""ColorNote backups that the test encrypts, and the settings of an import."""

import hashlib
import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.sources import files, formats
from notelake.sources.settings import Settings

DAY = 86_400_000


def _sealed(spark, text: bytes, password: str) -> bytes:
    """A header of 28 bytes and the AES-CBC cipher text; key and vector as OpenSSL derives them with MD5."""
    secret = password.encode() + b"ColorNote Fixed Salt"
    key = hashlib.md5(secret).digest()
    iv = hashlib.md5(key + secret).digest()
    x = spark.createDataFrame([(bytearray(text), bytearray(key), bytearray(iv))], "t binary, k binary, v binary")
    return b"NOTE" * 7 + bytes(x.select(F.aes_encrypt("t", "k", F.lit("CBC"), F.lit("PKCS"), "v").alias("c")).first().c)[16:]


def _record(**fields):
    return {"title": "t", "note": "n", "encrypted": 0, "created_date": 1, "modified_date": 2, "active_state": 0, "space": 0, "type": 0, "folder_id": 0, "color_index": 0, "reminder_repeat": 0, "reminder_date": 0, "reminder_base": 0} | fields


def _import(spark, root, made: dict[str, bytes], passwords: dict[str, str], **settings):
    for name, data in made.items():
        (root / name).write_bytes(data)
    table = spark.createDataFrame(list(passwords.items()), "name string, password string")
    return formats.import_notes(files.scan(spark, str(root)), ["colornote"], Settings(options={"colornote": {"passwords": table}}, **settings))


def test_records_become_notes(spark, tmp_path):
    headline = json.dumps({"format_list": [{"format": "headline1", "start": 0, "end": 5}, {"format": "bold", "start": 6, "end": 8}, {"format": "italic", "start": 8, "end": 9}, {"format": "bg_color", "start": 8, "end": 9, "attribute": "highlight_purple"}]})
    records = [
        _record(title="Home", note='{"folder_id": 7}', type=128), _record(title="", note="a < b\nc", folder_id=7, color_index=9, space=16),
        _record(title="list", note="[V]  one \n[ ]\ttwo\r\nrest", type=16, color_index=12), _record(title="no list", note="rest", type=16),
        _record(title="rich", note="Title\n\U0001f600bc", note_ext=headline), _record(title="bad spans", note="x", note_ext="{"), _record(title="no spans", note="x", note_ext='{"format_list": []}'),
        _record(type=256), _record(encrypted=1), _record(active_state=16), _record(active_state=32), _record(encrypted=None),
        _record(title="undated", created_date=0), {"encrypted": 0, "created_date": 3, "modified_date": 4},
        _record(title="Away", note='{"folder_id": 7}', type=128),
    ]
    text = "\x01\x02{ [" + " }{ ".join(json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(records)) + ' {"open": '
    result = _import(spark, tmp_path, {"my.backup": _sealed(spark, text.encode() + b"\xff", "1234")}, {"my.backup": "1234"})
    got = {r.title: r for r in result.notes.collect()}
    assert sorted(r.title for r in result.notes.collect()) == ["Untitled note", "Untitled note", "bad spans", "list", "no list", "no spans", "rich", "undated"]
    plain = next(r for r in result.notes.collect() if r.notebooks)
    assert (plain.html, plain.notebooks, plain.color, plain.archived, plain.date_created, plain.date_edited) == ('<p data-spacing="single">a &lt; b</p><p data-spacing="single">c</p>', [["Away"]], "white", True, 1, 2)
    assert got["list"].html == '<ul class="simple-checklist"><li class="simple-checklist--item checked">one </li><li class="simple-checklist--item">two</li></ul>' and got["list"].color is None
    assert got["no list"].html == "<p></p>" and got["bad spans"].html == got["no spans"].html == '<p data-spacing="single">x</p>'
    # the face counts two, as in the export
    assert got["rich"].html == '<h1>Title</h1><p><strong>\U0001f600</strong><em><span style="background-color: purple">b</span></em>c</p>'
    assert [(r.note_title, r.message.split(".")[0]) for r in result.errors.collect()] == [("undated", "Invalid note")]
    assert {r.source for r in result.notes.collect()} == {"colornote"}


def test_reminders_by_code(spark, tmp_path):
    codes = [0, 16, 32, 48, 80, 96, 112, 5, -1]
    # 3 January 1970 is a Saturday
    records = [_record(title=str(c), note="d", reminder_repeat=c, reminder_date=2 * DAY) for c in codes] + [_record(title="none"), _record(title="base", reminder_base=-1, reminder_date=5)]
    result = _import(spark, tmp_path, {"r.db": _sealed(spark, json.dumps(records).encode(), "p")}, {"r.db": "p"})
    got = {r.title: r.reminder for r in result.notes.collect()}
    assert {c: (got[str(c)].mode, got[str(c)].recurring_mode, got[str(c)].selected_days) for c in codes} == {
        0: ("once", None, None), 16: ("repeat", "day", None), 32: ("repeat", "week", [1, 2, 3, 4, 5]), 48: ("repeat", "week", [6]), 80: ("repeat", "month", [3]), 96: ("repeat", "month", [3]),
        112: ("repeat", "year", None), 5: ("once", None, None), -1: ("once", None, None),
    }
    assert got["none"] is None and got["base"].date == -1 and (got["0"].title, got["0"].description, got["0"].date) == ("0", "d", 2 * DAY)
    null = spark.range(1).select(C.reminder(F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(7).cast("long")).alias("r")).first().r
    assert (null.date, null.mode) == (7, "once")


def test_files_that_do_not_open(spark, tmp_path):
    good = _sealed(spark, json.dumps(_record(title="kept")).encode(), "p")
    made = {"none.backup": good, "blank.backup": good, "cut.dat": good[:-1], "small.db": b"x" * 43, "good.backup": good, "bare.backup": _sealed(spark, b"no objects { here", "p"), "other.txt": b"x"}
    result = _import(spark, tmp_path, made, {n: "p" for n in ("cut.dat", "small.db", "good.backup", "bare.backup")} | {"blank.backup": ""})
    assert [r.title for r in result.notes.collect()] == ["kept"]
    assert {r.src_path.rsplit("/", 1)[-1]: r.message.split()[0] for r in result.errors.collect()} == {"none.backup": "Password", "blank.backup": "Password", "cut.dat": "Decryption", "small.db": "Data"}
    assert formats.import_notes(files.scan(spark, str(tmp_path)), ["colornote"]).errors.count() == 6


def test_counts_are_observed(spark, tmp_path):
    """The observation of a run holds the counts that its table has, by format, without a job of its own (K6)."""
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    (tmp_path / "c.md").write_text("# c\n\nd")
    (tmp_path / "d.json").write_text('{"activeNotes": [{"content": "no dates"}]}')
    settings = Settings(notes=Observation("notes"), errors=Observation("errors"))
    result = formats.import_notes(files.scan(spark, str(tmp_path)), ["txt", "md", "simplenote"], settings)
    result.notes.write.parquet(str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out")).groupBy("source").count().collect()
    assert settings.notes.get == {"rows": 3, "txt": 2, "md": 1, "simplenote": 0} and {r.source: r["count"] for r in written} == {"txt": 2, "md": 1}
    bad = result.errors.collect()  # an observation waits for the first action on its table
    assert settings.errors.get == {"rows": len(bad)} and len(bad) == 1
