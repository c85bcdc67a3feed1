"""Files read in ranges, and the tables behind charts."""

import hashlib
import io
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.catalog import QUERIES, SQL
from plumbline.operators import charts
from plumbline.plans import grouped
from plumbline.sources import guards, large
from plumbline.sources.read import read


def test_arrow_batches_are_read_by_many_tasks(spark, tmp_path):
    schema = pa.schema([("id", pa.int64()), ("kind", pa.dictionary(pa.int32(), pa.string())), ("v", pa.list_(pa.float64()))])
    for name, start in (("a", 0), ("b", 100)):
        with pa.OSFile(str(tmp_path / f"{name}.arrow"), "wb") as f, pa.ipc.new_file(f, schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)) as out:
            for k in range(start, start + 30):
                n = 500
                kinds = pa.DictionaryArray.from_arrays(pa.array([0, None] * (n // 2), pa.int32()), pa.array(["x"]))
                out.write_batch(pa.record_batch([pa.array(range(k * n, k * n + n), pa.int64()), kinds, pa.array([[float(i)] for i in range(n)])], schema=schema))
    df = large.arrow_files(spark, str(tmp_path / "*.arrow"), 40_000)
    assert df.rdd.getNumPartitions() == 20
    assert df.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count("kind"), F.sum(F.col("v")[0])).first() == (30_000, 30_000, 0, 64_999, 15_000, 60 * 499 * 250.0)
    assert read(spark, str(tmp_path / "a.arrow")).count() == 15_000


def test_hashes_of_files_beyond_a_row(spark, tmp_path):
    with open(tmp_path / "huge.bin", "wb") as f:
        f.write(b"head")
        f.truncate(2_300_000_000)
    (tmp_path / "small.bin").write_bytes(b"abc")
    got = {r["path"].rpartition("/")[2]: (r["length"], r["sha256"]) for r in guards.file_hashes(spark, str(tmp_path / "*.bin")).collect()}
    want, block = hashlib.sha256(b"head"), bytes(1 << 24)
    left = 2_300_000_000 - 4
    while left:
        want.update(block[: min(left, len(block))])
        left -= min(left, len(block))
    assert got == {"huge.bin": (2_300_000_000, want.hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest())}
    (tmp_path / "huge.bin").unlink()


def _workbook(sheets):
    out, space = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{9 - i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>sha</t><t>red</t></si></sst>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f"<row>{r}</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{9 - i}.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_sheets_are_streamed(spark, tmp_path):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    many = [cell("id") + cell("name")] + [f'<c><v>{i}</v></c><c t="s"><v>0</v></c>' for i in range(12_000)] + ['<c r="A1"><v>7</v></c><c r="D1"><v>9</v></c>', ""]
    path = str(tmp_path / "w.xlsx")
    (tmp_path / "w.xlsx").write_bytes(_workbook({"First": [cell("a"), cell("b")], "Many rows": many, "Empty": []}))
    assert large.sheet_names(path) == ["First", "Many rows", "Empty"]
    df = large.worksheet(spark, path, "Many rows")
    assert df.columns == ["id", "name", "column_3", "column_4"]
    assert df.agg(F.count("*"), F.count("name"), F.max("name"), F.count("column_4")).first() == (12_002, 12_000, "shared", 1)
    assert [r[0] for r in read(spark, path).collect()] == ["b"] and read(spark, path, sheet="Many rows").count() == 12_002
    assert large.worksheet(spark, path, 2) is None
    with pytest.raises(guards.SourceError):
        read(spark, path, sheet="No such")
    (tmp_path / "no.xlsx").write_bytes(b"PK\x03\x04 but no archive")
    with pytest.raises(guards.SourceError):
        read(spark, str(tmp_path / "no.xlsx"))


def test_group_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 3}", float(v)) for i, v in enumerate(rng.exponential(5, 4000))] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    for small in (10, 5000):
        got = {r["g"]["k0"]: (r["n"], r["quantiles"]) for r in grouped.group_quantiles(df, [F.col("g")], {"v": F.col("v")}, qs, small=small).collect()}
        for g in ("g0", "g1", "g2", "one"):
            v = sorted(x for k, x in rows if k == g)
            assert got[g] == (len(v), [v[int((len(v) - 1) * q + 0.5)] for q in qs])
        assert "none" not in got


def test_chart_tables_on_odd_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0), (None, 1.0), (2.0, None)], "x double, y double")
    assert [tuple(r) for r in charts.density(df, "x", "y", 4).collect()] == [(0, 0, 2, 1.0, 5.0)]
    assert charts.density(df.limit(0), "x", "y").count() == 0 and charts.boxes(df.limit(0), "x", "y").count() == 0
    events = spark.sql("select timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) as t, cast(id % 5 as double) as v from range(100)")
    line = charts.line(events, "t", "v", 10).orderBy("pixel").collect()
    assert [r["n"] for r in line] == [10] * 9 + [10] and line[0][2:4] == (0.0, 4.0) and (line[0]["first"], line[9]["last"]) == (0.0, 4.0)
    one = charts.line(events.limit(1), "t", "v", 10).collect()
    assert [(r["pixel"], r["n"]) for r in one] == [(0, 1)]
    holes = spark.createDataFrame([(i, None if i < 25 else "a") for i in range(100)] + [(None, None)], "i long, s string")
    got = {r["block"]: (r["n"], r["nulls"]) for r in charts.missing_map(holes, "i", blocks=4).collect()}
    assert got == {-1: (1, 1), 0: (25, 25), 1: (25, 0), 2: (25, 0), 3: (25, 0)}
    assert charts.shape(2.0, 1.0).startswith("right") and charts.shape(1.0, 2.0).startswith("left") and charts.shape(1.0, 1.0) == "roughly symmetric" and charts.shape(None, 1.0) is None


def test_line_means_do_not_depend_on_the_order_of_rows(spark):
    """Sums of doubles in the rows' order end in 0.25 here, and in other digits in other orders."""
    values = [1e15, 0.3, -1e15]
    for order in (values, values[::-1], [0.3, 1e15, -1e15]):
        x = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v double").selectExpr("timestamp'2024-01-01' as t", "v").coalesce(1)
        assert charts.line(x, "t", "v", 10).first()["mean"] == 0.3 / 3
    odd = spark.sql("select timestamp'2024-01-01' as t, cast(v as double) as v from values ('Infinity'), ('1') as x(v)")
    assert charts.line(odd, "t", "v", 10).first()["mean"] == float("inf")


def test_line_takes_points_just_before_a_pixel_to_the_one_before(spark):
    micros = [0, 5 * 10**10 - 1, 5 * 10**10, 10**13 - 5 * 10**10 - 1, 10**13]
    x = spark.createDataFrame([(m, float(i)) for i, m in enumerate(micros)], "m long, v double").select(F.timestamp_micros("m").alias("t"), "v")
    got = charts.line(x, "t", "v", 200).orderBy("pixel").collect()
    assert [(r["pixel"], r["n"]) for r in got] == [(0, 2), (1, 1), (198, 1), (199, 1)]


def test_line_query_agrees_with_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    # One row a microsecond before each pixel, values of more than 6 places.
    at = "case when i < 199 then (i + 1) * 5000000000 - 1 when i = 199 then 0 when i = 200 then 1000000000000 else i * 7919 * 104729 % 1000000000000 end"
    con.execute(f"copy (select i as event_id, make_timestamp(1700000000000000 + {at}) as ts, (i % 997) / 7.0 as value from range(20000) t(i)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = QUERIES["chart_line"](spark, str(tmp_path)).orderBy("pixel").collect()
    assert [tuple(r) for r in got] == con.execute(f"select * from ({SQL['chart_line']}) order by pixel").fetchall()
