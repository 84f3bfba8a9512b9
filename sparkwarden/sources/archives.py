"""Package archives: one row per text file, or one row per member for the manifest.

An archive is one row of bytes, so archives are spread over the cluster and each is unpacked by
one task, member by member; nothing of it is executed.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.operators.files import basename, content_type, path_suffix

MEMBERS = "archive string, path string, content string, size bigint, ord bigint, error string"
#: Rows, and characters or bytes, that a task gathers before it hands them on.
ROWS, HELD = 256, 4 << 20


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives below a folder as ``archive, content``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(F.col("path").alias("archive"), "content")
    )


def _safe(name: str) -> bool:
    return bool(name) and not name.startswith("/") and ".." not in name.split("/")


def _members(archive: str, data: bytes) -> Iterator[tuple[str, int, object]]:
    """Regular members as (name, size, reader); links and directories are passed over."""
    if archive.endswith((".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
            for member in tar:
                if member.isfile():
                    yield member.name, member.size, lambda n, m=member: tar.extractfile(m).read(n)
    elif archive.endswith((".whl", ".zip")):
        with zipfile.ZipFile(io.BytesIO(data)) as box:
            for info in box.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, lambda n, i=info: box.open(i).read(n)


def _files(archive: str, data: bytes, max_file: int, budget: int) -> Iterator[tuple]:
    total = 0
    for i, (name, size, read) in enumerate(_members(archive, data)):
        if size > max_file or not _safe(name):
            continue
        total += size
        if total > budget:
            return
        try:
            yield archive, name, read(-1).decode("utf-8", errors="replace"), size, i, None
        except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError):
            continue


def _heads(archive: str, data: bytes, max_members: int, budget: int) -> Iterator[tuple]:
    total = 0
    for i, (name, size, read) in enumerate((n, s, r) for n, s, r in _members(archive, data) if _safe(n)):
        if i >= max_members or total > budget:
            return
        try:
            head = read(V.MANIFEST_HEAD_BYTES)
        except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError):
            head = b""
        total += len(head)
        yield archive, name, head.decode("utf-8", errors="replace"), size, i, None


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most ROWS rows, each ended by the row that brings its texts and bytes to HELD."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str | bytes))
        if len(held) >= ROWS or size >= HELD:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _unpacked(archives: DataFrame, walk, *limits: int) -> DataFrame:
    types = {"string": pa.string(), "bigint": pa.int64()}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.split(" ") for c in MEMBERS.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):  # one archive at a time leaves Arrow
                archive = name.as_py()
                try:
                    yield from walk(archive, bytes(content.as_py()), *limits)
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
                    yield archive, None, None, None, None, f"Failed to extract {archive}: {e}"

    return archives.select("archive", "content").mapInArrow(lambda batches: batched(rows(batches), schema), MEMBERS)


def unpack_archives(
    archives: DataFrame, max_file: int = V.MAX_FILE_BYTES, budget: int = V.MAX_ARCHIVE_TOTAL_BYTES
) -> DataFrame:
    """All admitted members of ``archive, content``; a broken archive adds a row with its error."""
    return _unpacked(archives, _files, max_file, budget)


def archive_files(members: DataFrame) -> DataFrame:
    """Text files among unpacked members: known suffixes, and anything else that reads as code."""
    name = basename(F.col("path"))
    listed = path_suffix(name).isin(V.ARCHIVE_TEXT_SUFFIXES) | name.isin(V.ARCHIVE_TEXT_BASENAMES)
    kept = members.filter("error IS NULL").filter(listed | content_type(F.col("content")).isin(V.CODE_TYPES))
    return kept.select("archive", "path", "content", "size", "ord")


def archive_errors(members: DataFrame) -> DataFrame:
    return members.filter("error IS NOT NULL").select("archive", "error")


def archive_manifest(
    archives: DataFrame, max_members: int = V.MAX_MANIFEST_MEMBERS, budget: int = V.MAX_MANIFEST_BYTES
) -> DataFrame:
    """Every member with the head of its content, up to the limits of a manifest."""
    return _unpacked(archives, _heads, max_members, budget).filter("error IS NULL").drop("error")
