import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import ingestion
from tallyforge.sources import files, invoices, registry, sinks, workbooks
from tallyforge.streaming.ingest import ingest


def xlsx(formula_cached=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Override ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>')
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="Plan1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Data</t></si><si><r><t>Va</t></r><r><t>lor</t></r></si></sst>")
        cached = "<v>3</v>" if formula_cached else ""
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>1.5</v></c><c r="B3"><f>A3*2</f>{cached}</c></row></sheetData></worksheet>')
    return out.getvalue()


FILES = {
    "a.pdf": b"%PDF-1.4 x", "b.txt": b"\xef\xbb\xbf <x/>", "c.xlsx": xlsx(), "d.xls": bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "e.csv": "Data;Descrição;Valor\n01/01/2024;\"a,b\";1,00\n".encode("cp1252"),
    "f.pdf": b"just words", "g.csv": b"", "h.xlsx": b"PK\x03\x04broken",
}


@pytest.fixture()
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_detection_goes_by_content(spark, folder):
    found = {r.name: r for r in files.detected(files.described(files.discovered(spark, str(folder)))).collect()}
    assert {n: r.format for n, r in found.items()} == {"a.pdf": "pdf", "b.txt": "xml", "c.xlsx": "xlsx", "d.xls": "xls", "e.csv": "csv", "f.pdf": None, "g.csv": None, "h.xlsx": None}
    assert {n for n, r in found.items() if r.warning} == {"b.txt", "f.pdf", "h.xlsx"}
    assert found["g.csv"].issue == "file_empty" and found["f.pdf"].issue == "unknown_format"
    assert found["a.pdf"].extension == ".pdf" and found["a.pdf"].sha256.startswith(found["a.pdf"].short_hash)


def test_cells_of_all_readers(spark, folder):
    kept = files.detected(files.described(files.discovered(spark, str(folder))))
    got = registry.default_readers().cells(kept).join(kept.select(F.col("sha256").alias("doc"), "name"), "doc").collect()
    table = {(r.name, r.coordinate): (r.value, r.formula, r.calculated_value) for r in got}
    assert table[("c.xlsx", "C1")] == ("Valor", None, None) and table[("c.xlsx", "B3")] == (None, "=A3*2", "3")
    assert table[("e.csv", "B2")] == ("a,b", None, None) and table[("e.csv", "B1")][0] == "Descrição"
    assert [r.issue for r in got if r.name == "d.xls"] == ["xls_reader_unavailable"]


def test_missing_formula_caches_and_broken_files(spark):
    df = spark.createDataFrame([("x", xlsx(False)), ("y", b"no zip")], "sha256 string, content binary")
    got = workbooks.xlsx_cells(df).where("issue is not null").collect()
    assert {(r.doc, r.coordinate, r.issue) for r in got} == {("x", "B3", "formula_cache_missing"), ("y", None, "invalid_xlsx")}


def test_readers_register_once():
    r = registry.Readers()
    r.register("csv", workbooks.csv_cells)
    with pytest.raises(ValueError):
        r.register("csv", workbooks.csv_cells)
    for f in (None, "pdf"):
        with pytest.raises(ValueError):
            r.get(f)


def test_letters(spark):
    df = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 702, 703, 16384)], "n int")
    assert [r[0] for r in df.select(workbooks.letters(F.col("n"))).collect()] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]


def test_page_tables(spark):
    df = spark.createDataFrame([("d", 2, [[["a", ""], [None, "b"]]])], "doc string, page int, tables array<array<array<string>>>")
    assert {(r.sheet, r.row_number, r.column, r.value) for r in workbooks.table_cells(df).collect()} == {("page-2-table-0", 1, 1, "a"), ("page-2-table-0", 2, 2, "b")}


def invoice(version="1.01", root="NFSe", namespace="http://www.sped.fazenda.gov.br/nfse", gross="100.00", head=""):
    digits = "1234567" + "1" + "2" + "11222333000181" + "0000000000042" + "2401" + "123456789"
    total = sum(int(c) * (2 + i % 8) for i, c in enumerate(reversed(digits))) % 11
    key = digits + str(0 if total < 2 else 11 - total)
    return f"""<?xml version="1.0"?>{head}<{root} xmlns="{namespace}" versao="{version}"><infNFSe Id="NFS{key}"><nNFSe>42</nNFSe><ambGer>1</ambGer><emit><CNPJ>11222333000181</CNPJ><xNome>Emit</xNome></emit>
<valores><vBC>100.00</vBC><pAliqAplic>2.00</pAliqAplic><vISSQN>2.00</vISSQN><vLiq>98.00</vLiq></valores><DPS><infDPS><cLocEmi>1234567</cLocEmi><toma><CPF>52998224725</CPF></toma><valores><vServPrest><vServ>{gross}</vServ></vServPrest></valores></infDPS></DPS></infNFSe></{root}>"""


def test_invoices(spark):
    rows = [("ok", invoice()), ("net", invoice(gross="50.00")), ("v", invoice(version="9")), ("root", invoice(root="X")), ("ns", invoice(namespace="urn:x")), ("dtd", invoice(head="<!DOCTYPE a>")), ("none", "nothing")]
    df = spark.createDataFrame(rows, "doc string, xml string")
    assert {r.doc: r.issue for r in invoices.gate(df).collect()} == {
        "ok": None, "net": None, "v": "unsupported_nfse_version", "root": "unsupported_xml_root", "ns": "unknown_xml_namespace", "dtd": "unsafe_xml", "none": "invalid_xml",
    }
    records = invoices.normalized(df)
    r = records.where("doc = 'ok'").first()
    assert (r.number, r.provider.tax_id, r.provider.tax_id_type, r.customer.tax_id, r.intermediary, float(r.amounts.net)) == ("42", "11222333000181", "CNPJ", "52998224725", None, 98.0)
    assert r.provenance["number"] == "/NFSe/infNFSe/nNFSe" and "dps_number" not in r.provenance
    assert {(x.doc, x.issue) for x in invoices.issues(records).collect()} == {("net", "inconsistent_totals")}


def locked(name, data=None):
    """A workbook one part of which asks for a password."""
    data = bytearray(data or xlsx())
    at = data.find(b"PK\x01\x02")
    while data[at + 46 : at + 46 + len(name)] != name.encode():
        at = data.find(b"PK\x01\x02", at + 1)
    data[at + 8] |= 1
    return bytes(data)


def test_a_poisoned_file_is_a_row_and_stops_no_other(spark, tmp_path):
    far = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx())) as old, zipfile.ZipFile(far, "w") as new:
        for part in old.namelist():
            new.writestr(part, old.read(part).replace(b'<row r="3">', b'<row r="99999999999">'))
    bodies = {"good.xlsx": xlsx(), "locked.xlsx": locked("xl/workbook.xml"), "sealed.xlsx": locked("[Content_Types].xml"), "far.xlsx": far.getvalue(), "good.xml": invoice().encode(), "cut.xml": invoice()[:-20].encode(), "entity.xml": invoice().replace("Emit<", "&no;<").encode()}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = ingestion.ingest(spark, str(tmp_path))
    names = {r.sha256: r.name for r in got.files.collect()}
    issues = {(names[r.doc], r.severity, r.code) for r in got.issues.collect()}
    assert {(n, c) for n, s, c in issues if s == "error" and c in ("unexpected_processing_error", "invalid_xlsx", "invalid_xml")} >= {
        ("locked.xlsx", "unexpected_processing_error"), ("sealed.xlsx", "unexpected_processing_error"), ("cut.xml", "invalid_xml"), ("entity.xml", "invalid_xml"),
    }
    assert any(n == "far.xlsx" and s == "error" for n, s, _ in issues)
    assert [names[r.doc] for r in got.invoices.collect()] == ["good.xml"] and not any(n == "good.xml" for n, *_ in issues)
    assert "good.xlsx" not in {n for n, _, c in issues if c in ("unexpected_processing_error", "invalid_xlsx")}


def test_timings_do_not_count():
    assert sinks.without_timings({"a": 1, "x_duration_ms": 2, "b": [{"duration_ms": 1, "c": 2}]}) == {"a": 1, "b": [{"c": 2}]}


def test_ingestion_is_incremental(spark, folder, tmp_path_factory):
    target, checkpoint = str(tmp_path_factory.mktemp("t") / "out"), str(tmp_path_factory.mktemp("c"))
    ingest(spark, str(folder), target, checkpoint).awaitTermination()
    first = spark.read.parquet(target).count()
    (folder / "again.pdf").write_bytes(FILES["a.pdf"])
    (folder / "new.pdf").write_bytes(b"%PDF-1.7 new")
    ingest(spark, str(folder), target, checkpoint).awaitTermination()
    assert (first, spark.read.parquet(target).count()) == (len(FILES) - 1, len(FILES))  # the stream passes over the empty file


def test_windows_bytes_quoted_breaks_and_missing_paths(spark, tmp_path):
    data = "Data;Texto\n01/01/2024;\"a\nb\"\n02/01/2024;x – €\n".encode("cp1252")
    (tmp_path / "a.csv").write_bytes(data)
    got = files.described(files.discovered(spark, str(tmp_path)))
    cells = {r.coordinate: r.value for r in registry.default_readers().get("csv")(got).collect()}
    assert cells == {"A1": "Data", "B1": "Texto", "A2": "01/01/2024", "B2": "ab", "A3": "02/01/2024", "B3": "x – €"}
    gone = files.detected(files.described(files.discovered(spark, str(tmp_path / "none")))).collect()
    assert [r.issue for r in gone] == ["file_not_found"]
    (tmp_path / "b.csv").write_bytes(b"no table")
    issues = {r.issue for r in registry.default_readers().get("csv")(files.described(files.discovered(spark, str(tmp_path / "b.csv")))).collect()}
    assert issues == {"invalid_csv"}
