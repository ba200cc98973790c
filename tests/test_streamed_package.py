"""Files of any format as a stream into one package table: several runs give what one batch gives."""

import io
import json
import zipfile

from notelake.sources import files
from notelake.streaming import incremental

FORMATS = ["txt", "keep", "evernote"]


def _zip(**entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in entries.items():
            z.writestr(zipfile.ZipInfo(name.replace("__", "."), (2020, 1, 2, 3, 4, 6)), content)
    return data.getvalue()


def test_runs_over_a_growing_folder(spark, tmp_path):
    root, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    (root / "later").mkdir(parents=True)
    note = json.dumps({"title": "K", "textContent": "k", "attachments": [{"filePath": "pic.png", "mimetype": "image/png"}]})
    enex = "<en-export><note><title>E</title><content><![CDATA[<en-note><div>a</div></en-note>]]></content></note></en-export>"

    def run(name=checkpoint):
        q = incremental.write_package(incremental.binary_files(spark, str(root), 2), FORMATS, target, name)
        assert q.awaitTermination(300)

    (root / "a.zip").write_bytes(_zip(n__json=note, pic__png=b"\x89PNG\r\n\x1a\n0", same__txt="same"))
    (root / "e.enex").write_text(enex)
    run()
    first = spark.read.parquet(target).count()
    (root / "later" / "b.zip").write_bytes(_zip(other__txt="other", same__txt="same"))
    (root / "later" / "f.enex").write_text(enex.replace(">E<", ">F<"))
    run()
    # the same files under another checkpoint: all batches again
    run(str(tmp_path / "ck2"))
    got = {r.path: bytes(r.data) for r in spark.read.parquet(target).collect()}
    assert spark.read.parquet(target).count() == len(got) > first
    kinds = [p.split("/", 1)[1].split("/")[0] for p in got]
    assert kinds.count("note.json") == 5 and kinds.count("attachments") == 1

    once = {r.path: bytes(r.data) for r in incremental.package_batch(files.scan(spark, str(root)), FORMATS).collect()}
    assert once == got
