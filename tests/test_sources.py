import zipfile

import pytest
from pyspark.sql import functions as F

from tableloom.functions.scalars import table_name
from tableloom.sources import catalog, files


def test_csv_tokens_become_null_and_dates_stay_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,amount,day,note\n1,2.5,2024-01-31,ok\n2,NA,2024-02-29,N/A\n3,,2024-03-31,"a, ""b"""\n')
    df = files.read_csv(spark, str(tmp_path / "t.csv"), "id bigint, amount double, day string, note string")
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["amount"] == 2.5 and rows[2]["amount"] is None and rows[3]["amount"] is None
    assert rows[2]["note"] is None and rows[3]["note"] == 'a, "b"' and rows[1]["day"] == "2024-01-31"
    inferred = files.load(spark, str(tmp_path / "t.csv"), "csv")
    assert dict(inferred.dtypes)["day"] == "string"


def test_nan_becomes_null_on_load(spark, tmp_path):
    spark.sql("select 1 as id, double('NaN') as x union all select 2, 1.5").write.parquet(str(tmp_path / "p"))
    assert {r["id"]: r["x"] for r in files.load(spark, str(tmp_path / "p"), "parquet", nan_as_null=True).collect()} == {1: None, 2: 1.5}


def _workbook(path, rows):
    def cell(col, n, v):
        ref = f"{chr(65 + col)}{n}"
        return f'<c r="{ref}" t="s"><v>{strings.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'

    strings = sorted({v for r in rows for v in r if isinstance(v, str)})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{n}">' + "".join(cell(c, n, v) for c, v in enumerate(r) if v is not None) + "</row>" for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks_one_row_per_line_of_the_first_sheet(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["id", "name", "amount"], [1, "x", 2.5], [2, None, "NA"]])
    _workbook(tmp_path / "b.xlsx", [["name", "id"], ["y", 3]])
    df = files.load(spark, str(tmp_path), "xlsx", "id bigint, name string, amount double")
    assert sorted(map(tuple, df.collect())) == [(1, "x", 2.5), (2, None, None), (3, "y", None)]


def test_names_and_registry(spark, tmp_path):
    assert table_name("My-Table.v2.csv") == "my_table"
    assert catalog.joined_name("A-b.csv", "c") == "joined_a_b_c"
    tables = {"My-Table.v2.csv": spark.range(3), "empty.csv": spark.range(0)}
    for name, df in tables.items():
        files.write_table(df, str(tmp_path), name, catalog.PREFIXES["onboarding"])
    registry = catalog.register(tables)
    assert registry.where("table_name = 'onboarding_table_my_table'").first()["row_count"] == 3
    assert catalog.read_registered(spark, registry, str(tmp_path), "My-Table.v2.csv").count() == 3
    assert catalog.read_registered(spark, registry, str(tmp_path), "empty.csv") is None
    assert catalog.read_registered(spark, registry, str(tmp_path), "other.csv") is None
    assert catalog.duplicate_names(registry.unionByName(registry)).count() == 2


def test_append_and_replace(spark, tmp_path):
    path = files.write_table(spark.range(2), str(tmp_path), "log", mode="append")
    files.write_table(spark.range(2), str(tmp_path), "log", mode="append")
    assert spark.read.parquet(path).count() == 4
    files.write_table(spark.range(1), str(tmp_path), "log")
    assert spark.read.parquet(path).count() == 1


def test_latest_upsert_and_log(spark):
    log = catalog.log_step(spark, "r1", "join", 1, "a", F.lit("{}")).unionByName(catalog.log_step(spark, "r1", "join", 2, "b", F.lit(None).cast("string")))
    last = catalog.latest_per_key(log, ["run_id", "step"], ["seq"]).first()
    assert last["table_name"] == "b" and last["payload"] is None
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, catalog.upsert(base, delta, ["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]


def test_mapping_json_keeps_only_set_roles(spark):
    df = spark.createDataFrame([("t", "cust", None)], "table_name string, id string, target string")
    encoded = catalog.encode_mapping(df, ["id", "target"])
    assert encoded.first()["mappings"] == '{"id":"cust"}'
    assert catalog.decode_mapping(encoded).collect()[0][1:] == ("id", "cust")


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError):
        files.load(spark, "x", "orc")


def test_types_are_inferred_after_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount,flag,when,note,empty\n1,2.5,true,2024-01-31,NA,\n2,NA,,2024-02-01,x,NA\n3,4,false,,7,\n")
    df = files.load(spark, str(tmp_path / "a.csv"), "csv")
    assert dict(df.dtypes) == {"id": "int", "amount": "double", "flag": "boolean", "when": "string", "note": "string", "empty": "string"}
    assert [r["amount"] for r in df.orderBy("id").collect()] == [2.5, None, 4.0]


def test_workbook_dates_by_cell_style_and_types_without_a_schema(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, value, style=0: f'<c r="{ref}" s="{style}"><v>{value}</v></c>'
    text = lambda ref, value: f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    rows = [
        "".join(text(f"{c}1", n) for c, n in zip("ABCDE", ("id", "day", "moment", "amount", "ok"))),
        cell("A2", 1) + cell("B2", 45322, 1) + cell("C2", 45322.75, 2) + cell("D2", 2.5) + '<c r="E2" t="b"><v>1</v></c>',
        cell("A3", 2) + cell("B3", 59, 1) + cell("D3", 45322) + '<c r="E3" t="b"><v>0</v></c>']
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy\\ hh:mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData>' + "".join(f'<row r="{i + 1}">{r}</row>' for i, r in enumerate(rows)) + "</sheetData></worksheet>")
    df = files.load(spark, str(tmp_path), "xlsx")
    assert df.dtypes == [("id", "int"), ("day", "string"), ("moment", "string"), ("amount", "double"), ("ok", "boolean")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "2024-01-31", "2024-01-31 18:00:00", 2.5, True), (2, "1900-02-28", None, 45322.0, False)]
    known = files.load(spark, str(tmp_path), "xlsx", "id bigint, day date, moment timestamp_ntz")
    assert str(known.orderBy("id").first()["day"]) == "2024-01-31" and str(known.orderBy("id").first()["moment"]) == "2024-01-31 18:00:00"


def test_names_that_normalise_alike_are_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        catalog.register({"A-b.csv": df, "a_b.xlsx": df})
