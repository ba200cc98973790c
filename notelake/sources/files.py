"""Files and archive entries as rows: scans, expansion, filters."""

from __future__ import annotations

import datetime
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import columns as C

ZIPS, TARS = ("zip", "znote", "textpack"), ("jex",)
FILE = "path string, archive_name string, archive_path string, entry_ord int, size long, modified_at long, content binary, error string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """FILE rows of a folder, with name, stem, ext and dir."""
    return file_rows(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def file_rows(f: DataFrame) -> DataFrame:
    """FILE rows of a binaryFile source, batch or stream."""
    none = F.lit(None).cast("string")
    return described(f.select("path", none.alias("archive_name"), none.alias("archive_path"), F.lit(0).alias("entry_ord"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), "content", none.alias("error")))


def described(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.withColumns({"name": C.basename(p), "stem": C.stem(p), "ext": F.lower(F.ltrim(F.replace(C.extname(p), F.lit("."), F.lit("")))), "dir": C.dirname(p)})


def _entries(name: str, data: bytes) -> Iterator[tuple[str, bytes, int | None]]:
    if name.rsplit(".", 1)[-1].lower() in TARS:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read(), int(m.mtime * 1000)
    else:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    at = datetime.datetime(*m.date_time, tzinfo=datetime.timezone.utc) if m.date_time[1] else None
                    yield m.filename, z.read(m), int(at.timestamp() * 1000) if at else None


def _open(path: str, data: bytes) -> Iterator[tuple]:
    base = path.rsplit("/", 1)[-1]
    try:
        for i, (name, content, modified) in enumerate(_entries(base, data)):
            inner = f"{base}/{name}"
            yield inner, base, path, i, len(content), modified, content, None
            if name.rsplit(".", 1)[-1].lower() in ZIPS + TARS:
                yield from _open(inner, content)
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, RuntimeError, ValueError, NotImplementedError, zlib.error) as e:
        yield path, base, path, -1, 0, None, None, f"broken archive: {e}"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FILE.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            for row in _open(path, data or b""):  # an entry at a time: memory holds one archive
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def expand(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with the entries of archives, errors). The archives' own rows stay; a broken one is an error row.

    Archives differ in size, so they are dealt out one by one before they are opened.
    """
    archives = files.where(F.col("ext").isin(*ZIPS, *TARS)).select("path", "content").repartition(F.col("path"))
    rows = described(archives.mapInArrow(_expand, FILE))
    good = files.unionByName(rows.where(F.col("error").isNull()))
    return good, rows.where(F.col("error").isNotNull()).select(F.col("path").alias("src_path"), F.col("error").alias("message"))


def visible(files: DataFrame, extensions: list[str], without: list[str] | None = None) -> DataFrame:
    """Files of the given extensions that are not hidden and whose path has none of the substrings."""
    out = files.where(F.col("ext").isin(*extensions) & ~C.is_hidden(F.element_at(F.split("path", "://?"), -1)))
    for part in without or []:
        out = out.where(~F.col("path").contains(part))
    return out
