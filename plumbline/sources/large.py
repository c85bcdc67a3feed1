"""Large files that Spark has no reader for, read in ranges by tasks: Arrow files by record batches, workbooks row by row, hashes of files of any size.

Files are opened through Arrow's file systems, so tasks fetch the bytes they need and nothing
passes through the driver but an Arrow footer, a workbook's directory and its first row.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.guards import SourceError, check_entries

SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
RANGE = 8 << 20  # bytes that are hashed at a time
TASK_BYTES = 64 << 20  # of a file that a task reads, about
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def scheme(path: str) -> str:
    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", path)
    return found[1].lower() if found else ""


def opened(path: str):
    """A random-access file of Arrow."""
    from pyarrow import fs

    kind = scheme(path)
    if kind in ("", "file"):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:(//)?(?=/)", "", path))
    system, at = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
    return system.open_input_file(at)


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and lengths of the files at a path or pattern, as Spark lists them."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    return sorted((r["path"], r["length"]) for r in rows)


# ---- Arrow files (SRC-08) -----------------------------------------------------------------------------------------------


class _Batches(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class ArrowFiles(DataSource):
    """Arrow IPC files (Feather 2): a partition holds the record batches of about `bytes` bytes. Option files: path and length, one a line."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def _paths(self) -> list[tuple[str, int]]:
        return [(p, int(n)) for p, n in (line.rsplit("\t", 1) for line in self.options["files"].split("\n"))]

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        with opened(self._paths()[0][0]) as f:
            return from_arrow_schema(_plain(pa.ipc.open_file(f).schema))

    def reader(self, schema):
        return _ArrowReader(self._paths(), schema, int(self.options.get("bytes", TASK_BYTES)))


def _plain(schema):
    """Dictionary columns as the values they stand for."""
    import pyarrow as pa

    return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type, f.nullable) for f in schema])


class _ArrowReader(DataSourceReader):
    def __init__(self, paths, schema, size):
        self.paths, self.fields, self.size = paths, schema, size

    def partitions(self):
        import pyarrow as pa

        out = []
        for path, length in self.paths:
            with opened(path) as f:
                n = pa.ipc.open_file(f).num_record_batches
            step = max(1, n * self.size // max(1, length))
            out += [_Batches(path, i, min(n, i + step)) for i in range(0, n, step)]
        return out or [_Batches("", 0, 0)]

    def read(self, partition) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        target = to_arrow_schema(self.fields)
        with opened(partition.path) as f:
            reader = pa.ipc.open_file(f)
            for i in range(partition.first, partition.end):
                table = pa.Table.from_batches([reader.get_batch(i)])
                yield from table.cast(_plain(table.schema)).select(target.names).cast(target).combine_chunks().to_batches(max_chunksize=10_000)


def arrow_files(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of Arrow IPC files, a task for every few record batches; a file may be of any size."""
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_files").option("files", "\n".join(f"{p}\t{n}" for p, n in files(spark, path))).option("bytes", str(task_bytes)).load()


# ---- workbooks (SRC-05) -------------------------------------------------------------------------------------------------


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts of the sheets, in the workbook's order."""
    names = set(z.namelist())
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = [(s.get("name", ""), rels.get(s.get(f"{_R}id"), "")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet")]
        found = [(n, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for n, t in found]
        if found := [(n, t) for n, t in found if t in names]:
            return found
    plain = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    return [(n.rpartition("/")[2][:-4], n) for n in plain]


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_M}si":
                out.append("".join(t.text or "" for t in e.iter(f"{_M}t")))
                e.clear()
    return out


def _column(reference: str | None, at: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return at
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[dict[int, str]]:
    """The rows of a sheet one by one: column number -> text. Cells are dropped as soon as they are read."""
    with z.open(part) as f:
        parents = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag != f"{_M}row":
                continue
            cells = {}
            for i, c in enumerate(e.findall(f"{_M}c")):
                v = c.find(f"{_M}v")
                text = "".join(t.text or "" for t in c.iter(f"{_M}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                cells[_column(c.get("r"), i)] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield cells
            if parents:
                parents[-1].remove(e)


def sheet_names(path: str) -> list[str]:
    with opened(path) as f, zipfile.ZipFile(f) as z:
        return [n for n, _ in _sheets(z)]


def worksheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame | None:
    """A sheet of an .xlsx file by name or number, all columns text, the first row as names; None without rows.

    The driver reads the archive's directory and the first row; a task streams the rows, once for the widest of them and once for their cells.
    """
    from plumbline.functions.names import unique_names

    with opened(path) as f, zipfile.ZipFile(f) as z:
        check_entries(z)
        found = _sheets(z)
        if not found:
            raise SourceError("no sheet")
        part = found[sheet][1] if isinstance(sheet, int) else dict(found).get(sheet)
        if part is None:
            raise SourceError(f"no sheet named {sheet}")
        head = next(sheet_rows(z, part, _shared(z)), None)
    if head is None:
        return None
    source = spark.createDataFrame([(path,)], "path string")

    def widths(batches):
        import pyarrow as pa

        for b in batches:
            for p in b.column(0).to_pylist():
                with opened(p) as f, zipfile.ZipFile(f) as z:
                    widest = max(max(r, default=0) for r in sheet_rows(z, part, _shared(z))) + 1
                yield pa.RecordBatch.from_arrays([pa.array([widest], pa.int32())], ["width"])

    width = source.mapInArrow(widths, "width int").first()[0]
    names = unique_names([head.get(i) or "" for i in range(width)])

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            for p in b.column(0).to_pylist():
                with opened(p) as f, zipfile.ZipFile(f) as z:
                    held = itertools.islice(sheet_rows(z, part, _shared(z)), 1, None)
                    while some := list(itertools.islice(held, 5000)):
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(i) for r in some], pa.string()) for i in range(width)], names)

    return source.mapInArrow(rows, ", ".join(f"`{n}` string" for n in names))


# ---- hashes (SRC-13) ----------------------------------------------------------------------------------------------------


def range_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files of any size: a task reads a file's ranges in order and holds one at a time."""
    import pyarrow as pa

    def hashed(batches):
        for b in batches:
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = hashlib.sha256()
                with opened(p) as f:
                    while some := f.read(RANGE):
                        h.update(some)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([n], pa.int64()), pa.array([h.hexdigest()])], ["path", "length", "sha256"])

    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, F.col("path")).mapInArrow(hashed, "path string, length long, sha256 string")
