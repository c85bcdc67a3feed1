"""Readers by extension (SRC-01..09): text formats as strings, then sanitise(), so no bad cell fails a job."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections import Counter
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import total
from plumbline.operators.clean import sanitise
from plumbline.sources.guards import EmptyFile, SourceError, check_archive, check_signature, check_size, extension, head_bytes
from plumbline.sources.large import SCHEMES, arrow_files, scheme, worksheet

HEAD = 1 << 16  # bytes that are looked at
# Separators that are tried.
SEPARATORS = (",", ";", "\t", "|", ":")


def encoding(head: bytes, whole: bool = True) -> str:
    """SRC-03a by strict decoding: UTF-16 by its mark, UTF-8 if the sample decodes (up to a last character that is cut off, unless it is the whole file), else Latin-1."""
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    for cut in range(1 if whole else 4):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def sniff(head: bytes) -> tuple[str, str, int]:
    """SRC-03: (encoding, separator, lines before the header), from the first 30 lines; blank lines of the preamble count (SRC-03b)."""
    enc = encoding(head, len(head) < HEAD)
    every = head.decode(enc, "replace").lstrip("﻿").splitlines()[:30]
    lines = [x.strip() for x in every if x.strip()]
    if not lines:
        return enc, ",", 0
    best, score = ",", (0, 0)
    for sep in SEPARATORS:
        counts = Counter(x.count(sep) for x in lines[:10])
        common = max(counts, key=lambda n: (counts[n], n))
        if max(counts) > 0 and (common, counts[common]) > score:
            best, score = sep, (common, counts[common])
    counts = [x.count(best) for x in lines]
    skip = 0
    if len(lines) > 2 and max(counts) > 2:
        for c in counts[:10]:
            if c >= 0.5 * max(counts):
                break
            skip += 1
    seen, physical = 0, 0
    for x in every:
        if seen == skip and x.strip():
            break
        seen += bool(x.strip())
        physical += 1
    return enc, best, physical


def delimited(spark: SparkSession, path: str, sep: str | None = None, skip: int | None = None, charset: str | None = None, multiline: bool | None = None) -> DataFrame:
    """SRC-02, SRC-04, SRC-09: all columns as text; short lines are filled with nulls, long ones cut.

    Preamble and header are dropped from the start of each file: as many rows equal to them as they have, so a row further
    down that repeats one of them stays. multiline: quoted values may hold line breaks, and files aren't split; if None,
    a scan for lines with an odd number of quotes tells.
    """
    head = _plain_head(spark, path)
    if sep is None or skip is None or charset is None:
        found = sniff(head)
        charset, sep, skip = charset or found[0], found[1] if sep is None else sep, found[2] if skip is None else skip
    if multiline is None:
        multiline = charset == "UTF-16" or _quoted_breaks(spark, path)
    options = {"sep": sep, "encoding": charset, "mode": "PERMISSIVE", "escape": '"', "multiLine": multiline}
    first = _records(head.decode(charset, "replace").lstrip("\ufeff"), sep, skip + 1)
    if len(first) <= skip:
        raise EmptyFile(f"{path} has no header")
    names = first[skip]
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.options(**options).schema(schema).csv(path)
    # Of the rows that equal one of the first, those beyond as many as every file begins with stay.
    wanted = Counter(tuple((r + [None] * len(names))[: len(names)]) for r in first)
    files = len(rows.inputFiles())
    bare = [F.regexp_replace("_0", "^\ufeff", ""), *[F.col(f"_{i}") for i in range(1, len(names))]]
    same = {r: total([c.eqNullSafe(F.lit(v)) for c, v in zip(bare, r)]) == len(names) for r in wanted}
    hit = reduce(lambda x, y: x | y, same.values())
    out = rows.where(~hit)
    counts = rows.agg(*[F.count_if(c) for c in same.values()]).first()
    if extra := [r for (r, n), k in zip(wanted.items(), counts) for _ in range(max(0, k - n * files))]:
        out = out.union(spark.createDataFrame(extra, schema))
    return out.toDF(*_distinct([(n or "").strip() for n in names]))


def _records(text: str, sep: str, k: int) -> list[list]:
    """The first k records of a text, blank lines left out, empty values null."""
    found = csv.reader(io.StringIO(text), delimiter=sep)
    return [[v or None for v in r] for r in itertools.islice((r for r in found if r), k)]


def _quoted_breaks(spark: SparkSession, path: str) -> bool:
    """A line with an odd number of quotes: a value goes on in the next one."""
    lines = spark.read.text(path)
    return bool(lines.where(F.length("value") % 2 != F.length(F.replace("value", F.lit('"'), F.lit(""))) % 2).head(1))


def _distinct(names: list[str]) -> list[str]:
    from plumbline.functions.names import unique_names

    return unique_names(names)


def _plain_head(spark: SparkSession, path: str) -> bytes:
    head = head_bytes(spark, path, HEAD)
    if head.startswith(b"\x1f\x8b"):
        import zlib

        return zlib.decompressobj(31).decompress(head)
    return head


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: the first sheet of an .xlsx file, read with the standard library; workbooks are small by their format."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    content = bytes(row[0])
    check_archive(content)
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{space['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space)]
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        if not sheet:
            raise SourceError("no sheet")
        table: list[dict[int, str]] = []
        for r in ElementTree.fromstring(z.read(sheet[0])).iter(f"{{{space['m']}}}row"):
            cells = {}
            for i, c in enumerate(r.findall("m:c", space)):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = i
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = c.find("m:v", space)
                text = "".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            table.append(cells)
    if not table:
        raise EmptyFile(path)
    width = max(max(r, default=0) for r in table) + 1
    names = _distinct([table[0].get(i) or "" for i in range(width)])
    return spark.createDataFrame([tuple(r.get(i) for i in range(width)) for r in table[1:]], ", ".join(f"`{n}` string" for n in names))


def arrow_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: Arrow IPC or Feather files, one task each."""
    import pyarrow as pa
    import pyarrow.feather as feather
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")
    head = head_bytes(spark, path, HEAD << 4)
    if head.startswith(b"ARROW1"):  # the schema is the first message behind the mark
        first = pa.ipc.read_schema(pa.BufferReader(head[8:]))
    else:
        first = feather.read_table(pa.BufferReader(bytes(files.first()[0]))).schema
    schema = from_arrow_schema(first)

    def rows(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                yield from feather.read_table(pa.BufferReader(content)).combine_chunks().to_batches(max_chunksize=10_000)

    return files.mapInArrow(rows, schema)


def _sheet(spark: SparkSession, path: str, sheet: str | int) -> DataFrame:
    """A sheet streamed by a task where Arrow can open the file; else the first one, by way of Spark and the driver."""
    if scheme(path) not in SCHEMES:
        return workbook(spark, path)
    df = worksheet(spark, path, sheet)
    if df is None:
        raise EmptyFile(path)
    return df


def _arrow(spark: SparkSession, path: str) -> DataFrame:
    """By record batches where Arrow can open the file and its format has an index; else whole files."""
    if scheme(path) in SCHEMES and head_bytes(spark, path, 6) == b"ARROW1":
        return arrow_files(spark, path)
    return arrow_file(spark, path)


def read(spark: SparkSession, path: str, clean: bool = True, most_bytes: int | None = None, sheet: str | int = 0) -> DataFrame:
    """SRC-01: by extension, sanitised; an empty table raises. The first bytes must be of that kind (SRC-11); most_bytes bounds an upload's size (SRC-12); sheet: that of a workbook, by name or number."""
    kind = extension(path)
    try:
        check_signature(spark, path)
        if most_bytes is not None:
            check_size(spark, [path], most_bytes)
        if kind in (".csv", ".txt"):
            df = delimited(spark, path)
        elif kind == ".tsv":
            df = delimited(spark, path, "\t", 0)
        elif kind == ".gz":
            df = delimited(spark, path, ",", 0, "UTF-8")
        elif kind == ".xlsx":
            df = _sheet(spark, path, sheet)
        elif kind == ".xls":
            raise SourceError("the old binary workbook format can't be read; save it as .xlsx")
        elif kind == ".parquet":
            df = spark.read.parquet(path)
        elif kind == ".json":
            df = spark.read.option("multiLine", True).json(path)
        elif kind in (".jsonl", ".ndjson"):
            df = spark.read.json(path)
        else:
            df = _arrow(spark, path)
    except SourceError:
        raise
    except Exception as e:
        raise SourceError(f"could not read {path}: {e}") from e
    if not df.take(1):
        raise EmptyFile(f"{path} is empty")
    return sanitise(df, sample=None) if clean else df
