import gzip
import io
import zipfile

import pyarrow as pa
import pyarrow.feather as feather
import pytest

from plumbline.sources import guards, write
from plumbline.sources.read import encoding, read, sniff


def save(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_messy_csv(spark, tmp_path):
    text = "Report of sales\nMade on Monday\n Product ID ; Price ;Discount; Status \nA1;$1,250.50;10%;N/A\nA2;500;15%;ok\nA3;-$75.25;0%;-\n"
    df = read(spark, save(tmp_path, "messy.csv", text))
    assert df.columns == ["product_id", "price", "discount", "status"]
    rows = df.orderBy("product_id").collect()
    assert [r.price for r in rows] == [1250.5, 500.0, -75.25]
    assert [r.discount for r in rows] == [10.0, 15.0, 0.0]
    assert [r.status for r in rows] == [None, "ok", None]


def test_latin1_and_semicolons(spark, tmp_path):
    df = read(spark, save(tmp_path, "l.csv", "city;temperature;note\nKöln;12.5;grün\nMünchen;9;süß\n".encode("latin-1")))
    assert {r.city for r in df.collect()} == {"Köln", "München"}
    assert dict(df.dtypes)["temperature"] == "double"


def test_ragged_lines(spark, tmp_path):
    df = read(spark, save(tmp_path, "r.csv", "a,b,c\n1,2\n1,2,3,4\n"))
    assert df.count() == 2 and df.where("c is null").count() == 1


def test_preamble_rows_and_headers_that_come_again_stay(spark, tmp_path):
    df = read(spark, save(tmp_path, "p.csv", "Report;x\nid;name;city;n\n1;a;b;3\nid;name;city;n\nReport;x\n2;c;d;4\n"), clean=False)
    assert sorted((r.id, r.name, r.city) for r in df.collect()) == [("1", "a", "b"), ("2", "c", "d"), ("Report", "x", None), ("id", "name", "city")]
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"part{i}.csv").write_text(f"made by hand\nid,name,city,n\n{i},x,y,1\nid,name,city,n\n")
    got = [r.id for r in read(spark, str(folder), clean=False).collect()]
    assert sorted(got) == ["0", "1", "2", "id", "id", "id"]


def test_quoted_line_breaks(spark, tmp_path):
    rows = "".join(f"{i},plain\n" for i in range(20_000))
    df = read(spark, save(tmp_path, "q.csv", "id,note\n" + rows + '90001,"x\ny"\n90002,"say ""hi"""\n'), clean=False)
    assert df.count() == 20_002
    assert [r.note for r in df.where("id in ('90001', '90002')").orderBy("id").collect()] == ["x\ny", 'say "hi"']


def test_heads_of_large_files(spark, tmp_path):
    path = tmp_path / "large.csv"
    with open(path, "wb") as f:
        f.write(b"a,b\n1,2\n")
        f.truncate(2_300_000_000)
    assert guards.head_bytes(spark, str(path), 8) == b"a,b\n1,2\n"
    with pytest.raises(guards.SourceError):
        read(spark, str(path), most_bytes=1 << 20)
    path.unlink()


def test_signature_is_checked_on_reading(spark, tmp_path):
    with pytest.raises(guards.SourceError):
        read(spark, save(tmp_path, "no.parquet", b"id,name\n1,2\n"))


def test_other_formats(spark, tmp_path):
    assert read(spark, save(tmp_path, "t.tsv", "a\tb\n1\tx\n2\ty\n")).count() == 2
    assert read(spark, save(tmp_path, "j.jsonl", '{"A b": 1}\n{"A b": 2}\n')).columns == ["a_b"]
    assert read(spark, save(tmp_path, "j.json", '[{"a": 1}, {"a": 2}]')).count() == 2
    assert read(spark, save(tmp_path, "g.csv.gz", gzip.compress(b"a,b\n1,2\n"))).count() == 1
    feather.write_feather(pa.table({"x": [1, 2, 3]}), str(tmp_path / "f.feather"))
    assert read(spark, str(tmp_path / "f.feather")).count() == 3
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert read(spark, str(tmp_path / "p.parquet")).count() == 3


def workbook_bytes():
    out = io.BytesIO()
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Name</t></si><si><t>Age</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>31</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    rows = read(spark, save(tmp_path, "w.xlsx", workbook_bytes())).collect()
    assert [(r.name, r.age) for r in rows] == [("Ann", 31.0)]


def test_refused(spark, tmp_path):
    with pytest.raises(guards.UnsupportedType):
        read(spark, "x.doc")
    with pytest.raises(guards.EmptyFile):
        read(spark, save(tmp_path, "e.csv", "a,b\n"))
    with pytest.raises(guards.SourceError):
        guards.check_signature(spark, save(tmp_path, "bad.parquet", b"nope"))
    with pytest.raises(guards.SourceError):
        guards.check_signature(spark, save(tmp_path, "nul.csv", b"a\0b"))
    guards.check_signature(spark, save(tmp_path, "good.csv", "a,b\n"))
    with pytest.raises(guards.SourceError):
        guards.check_size(spark, [save(tmp_path, "big.csv", "x" * 100)], most=10)


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives():
    guards.check_archive(archive([("a.xml", "x")]))
    for content, options, what in (
        (archive([(f"{i}", "") for i in range(5002)]), {}, "Too many files"),
        (archive([("a", "x" * (2 << 20))]), {"most": 1 << 20}, "Decompressed size"),
        (archive([("a", "\0" * (12 << 20))]), {"ratio": 20}, "compression ratio"),
        (archive([("../a", "x")]), {}, "out of the archive"),
    ):
        with pytest.raises(guards.SourceError, match=what):
            guards.check_archive(content, **options)


def test_sniff():
    assert sniff(b"a|b\n1|2\n")[1] == "|"
    assert sniff(b"") == ("UTF-8", ",", 0)
    assert sniff(b"title\n\nmade by\na,b,c,d\n1,2,3,4\n5,6,7,8\n")[2] == 3
    assert encoding("é".encode("latin-1")) == "ISO-8859-1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.5)], "a int, b double")
    write.write(df, str(tmp_path / "o"), "csv", one_file=True)
    assert read(spark, str(next((tmp_path / "o").glob("*.csv")))).count() == 2
    assert write.preview(df, order=["a"]) == ['{"a":1}', '{"a":2,"b":2.5}']
    assert guards.file_hashes(spark, save(tmp_path, "h.csv", "x")).first().sha256.startswith("2d711642")
