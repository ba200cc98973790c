"""The incremental import over several runs."""

import os
import time

import pytest

from notelake.streaming import incremental

DAY = 86400


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(files: dict[str, tuple[str, float]], checkpoint: str = "ck") -> list[tuple[str, str]]:
        for name, (text, days) in files.items():
            path = tmp_path / "in" / name
            path.parent.mkdir(exist_ok=True)
            path.write_text(text)
            os.utime(path, (time.time() - days * DAY,) * 2)
        q = incremental.write(incremental.notes_once(incremental.text_files(spark, str(tmp_path / "in"), 2)), str(tmp_path / "out"), str(tmp_path / checkpoint))
        assert q.awaitTermination(120)
        return sorted((r.title, r.html.split(">")[1].split("<")[0]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return run


def test_old_files_that_arrive_late_are_imported(run):
    assert run({"new.txt": ("new", 0)}) == [("new", "new")]
    assert run({"old.txt": ("old", 30), "older.txt": ("older", 4000)}) == [("new", "new"), ("old", "old"), ("older", "older")]
    assert len(run({"last.txt": ("last", 0.5)})) == 4


def test_equal_notes_far_apart_come_once(run):
    assert run({"x/a.txt": ("same", 60), "y/a.txt": ("same", 30), "b.txt": ("same", 0)}) == [("a", "same"), ("b", "same")]
    assert run({"z/a.txt": ("same", 90), "a.txt": ("other", 0)}) == [("a", "other"), ("a", "same"), ("b", "same")]


def test_batches_run_again_add_nothing(run):
    files = {f"{i}/{i % 3}.txt": (f"text {i % 3}", i) for i in range(5)}
    assert len(run(files)) == len(run({}, "another checkpoint")) == 3
