"""Checks on files before they are read (SRC-10..13). Header bytes come through the file system that Spark has for the path, so any store will do."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and the first bytes of each format.
EXTENSIONS = (".csv", ".txt", ".tsv", ".xls", ".xlsx", ".parquet", ".json", ".jsonl", ".ndjson", ".feather", ".arrow", ".gz")
SIGNATURES = {".xlsx": (b"PK\x03\x04",), ".xls": (b"\xd0\xcf\x11\xe0",), ".parquet": (b"PAR1",), ".feather": (b"ARROW1", b"FEA1"), ".arrow": (b"ARROW1",), ".gz": (b"\x1f\x8b",)}


class SourceError(ValueError):
    """A file that can't be taken."""


class UnsupportedType(SourceError):
    pass


class EmptyFile(SourceError):
    pass


def extension(path: str) -> str:
    low = path.lower().rstrip("/")
    found = next((e for e in EXTENSIONS if low.endswith(e)), None)
    if not found:
        raise UnsupportedType(f"unsupported extension: {path}")
    return found


def head_bytes(spark: SparkSession, path: str, n: int = 16384) -> bytes:
    """The first bytes of a file, or of the first data file of a folder, through its file system: no more of it is read, however large it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getFileStatus(at).isDirectory():
        files = sorted(f.getPath().toString() for f in fs.listStatus(at) if f.isFile() and f.getPath().getName()[0] not in "_.")
        if not files:
            return b""
        at = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def check_signature(spark: SparkSession, path: str) -> None:
    """SRC-11. Text is refused if it holds NUL bytes and isn't UTF-16."""
    kind, head = extension(path), head_bytes(spark, path, 64)
    if kind in SIGNATURES:
        if not any(head.startswith(s) for s in SIGNATURES[kind]):
            raise SourceError(f"{path} isn't a {kind} file")
    elif b"\0" in head and not head.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise SourceError(f"{path} isn't text")


def check_size(spark: SparkSession, paths: list[str], most: int = 50 << 20, files: int = 10) -> None:
    """SRC-12: bounds for uploads; a cluster's tables don't pass here."""
    if len(paths) > files:
        raise SourceError(f"more than {files} files")
    total = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0
    if total > most:
        raise SourceError(f"{total} bytes are over the limit of {most}")


def check_archive(content: bytes, most: int = 200 << 20, entries: int = 5000, ratio: float = 100.0) -> None:
    """SRC-10, for workbooks, which are zip archives: too many entries, paths that lead out, too large or too dense."""
    try:
        check_entries(zipfile.ZipFile(io.BytesIO(content)), most, entries, ratio)
    except zipfile.BadZipFile as e:
        raise SourceError("not a zip archive") from e


def check_entries(archive: zipfile.ZipFile, most: int = 200 << 20, entries: int = 5000, ratio: float = 100.0) -> None:
    """SRC-10 on an open archive: only its directory is read."""
    infos = archive.infolist()
    if len(infos) > entries:
        raise SourceError("Too many files in the archive")
    if any(i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/") for i in infos):
        raise SourceError("a path leads out of the archive")
    size, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    if size > most:
        raise SourceError("Decompressed size is over the limit")
    if size > 10 << 20 and packed and size / packed > ratio:
        raise SourceError("compression ratio is suspicious")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: path, length, sha256. Where Arrow can open the files, they are read in ranges and may be of any size; else they are rows of Spark, of 2 GB at most."""
    from plumbline.sources.large import SCHEMES, range_hashes, scheme

    if scheme(path) in SCHEMES:
        return range_hashes(spark, path)
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
