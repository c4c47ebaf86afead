import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, profile
from tidemark.plans.requests import CleaningConfig
from tidemark.sources import tables


def test_kinds(spark):
    df = spark.createDataFrame([(4, 0.5, "oak", False, "2023-10-05", "T-11"), (8, 7.25, "elm", False, "2023-10-09", "T-12"), (4, 2.75, "oak", True, "2023-11-02", "T-13")], "rings long, girth double, species string, felled boolean, seen_date string, tree_id string")
    got = {r["column"]: r["classification"] for r in profile.profile_columns(df).collect()}
    assert got == {"rings": "numeric", "girth": "numeric", "species": "categorical", "felled": "boolean", "seen_date": "datetime", "tree_id": "identifier"}


def test_numbers(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 18, 7, 11, 9, 42)], "score double")
    r = profile.profile_numeric(df, ["score"]).first()
    assert (r["mean"], r["median"], r["p25"], r["p75"], r["is_integer"]) == (15.0, 10.0, 7.5, 16.25, True)


def test_categories(spark):
    df = spark.createDataFrame([("Turku",), ("Bergen",), ("Lund",), ("Bergen",)], "city string")
    r = profile.profile_categories(df, ["city"]).orderBy("rank").first()
    assert (r["value"], r["n"], r["pct"]) == ("Bergen", 2, 50.0)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, None), (4, 5)], "id long, value long")
    assert tuple(profile.duplicate_rows(df).first()) == (4, 1, 25.0)


def test_score_of_clean_data(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "2024-01-01"), (2, "b", 2.0, "2024-01-02"), (3, "c", 3.0, "2024-01-03")], "id long, name string, price double, order_date string")
    r = profile.quality_score(df).first()
    assert (r["score"], r["grade"]) == (100.0, "Excellent")


def test_names(spark):
    assert clean.normalize_name("Net % Weight [kg]") == "net_weight_kg" and clean.normalize_name("$$") == "unnamed_col"
    with pytest.raises(ValueError):
        clean.normalize_names(spark.createDataFrame([(1, 2)], "`Unit Price` long, unit_price long"))


def test_imputation(spark):
    df = spark.createDataFrame([(10.0, "Bergen"), (20.0, "Bergen"), (None, None), (60.0, "Turku")], "v double, c string")
    assert clean.impute_number(df, "v", "median").filter("v = 20").count() == 2
    assert clean.impute_number(df, "v", "mean").filter("v = 30").count() == 1
    assert clean.impute_category(df, "c", "mode").filter("c = 'Bergen'").count() == 3
    assert clean.impute_category(df, "c", "unknown").filter("c = 'Unknown'").count() == 1
    nulls = df.select(F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("c"))
    assert clean.impute_number(nulls, "v", "median").first()["v"] == 0.0 and clean.impute_category(nulls, "c", "mode").first()["c"] == "Unknown"


def test_spellings(spark):
    df = spark.createDataFrame([("nuts & bolts-m8",), (" Nuts & Bolts-M8 ",), ("NUTS & BOLTS-M8",), ("lund",), (None,)], "c string")
    assert sorted(str(r["c"]) for r in clean.normalize_categories(df, "c").collect()) == ["None", *["Nuts & Bolts-M8"] * 3, "lund"]


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("01/02/2024",), ("2024/03/04",), ("never",), (None,)], "d string")
    assert tuple(clean.cast_report(df, "d", "date").first()) == ("d", 3, 1)
    assert [r["d"] for r in clean.iso_dates(df, "d").collect()] == ["2024-01-01", "2024-01-02", "2024-03-04", None, None]


def test_outliers(spark):
    df = spark.createDataFrame([(10.0,)] * 19 + [(10000.0,)], "unit_price double")
    r = clean.outlier_report(df, "unit_price").first()
    assert r["outliers"] == 1 and r["upper"] == 10.0
    assert clean.cap_outliers(df, "unit_price").agg(F.max("unit_price")).first()[0] == 10.0
    assert clean.outlier_report(df.limit(5), "unit_price").first()["outliers"] == 0


def test_pipeline(spark):
    rows = [("O1", "C1", "electronics", "10", "2024-01-01"), ("O1", "C1", "electronics", "10", "2024-01-01"), ("O2", "C9999", "Electronics", None, "2024/01/02"), ("O3", None, "ELECTRONICS", "30", "2024-01-03"), ("O4", "C4", "electronics", "40", "2024-01-04")]
    df = spark.createDataFrame(rows, "`Order ID` string, `Customer ID` string, Category string, ` Quantity ` string, `Order Date` string")
    out, report = clean.clean(df, CleaningConfig())
    got = {r["order_id"]: r for r in out.collect()}
    assert out.columns == ["order_id", "customer_id", "category", "quantity", "order_date"] and len(got) == 4
    assert {r["category"] for r in got.values()} == {"Electronics"} and got["O2"]["quantity"] == 30.0 and got["O2"]["order_date"] == "2024-01-02"
    assert got["O3"]["customer_id"] is None and report.filter("step = 'references' and detail like '1 missing%'").count() == 1
    assert clean.preview(df).filter("missing = 1").count() == 2


def _workbook() -> bytes:
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Product ID</t></si><si><t>Price</t></si><si><t>pen</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>ok</t></is></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c></row><row><c r="A3" t="s"><v>2</v></c><c r="C3" t="b"><v>0</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,city,spend,day\n1,Lund,2.5,2024-01-01\n2,NA,,2024-01-02\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "city": "string", "spend": "double", "day": "string"} and df.filter("city is null").count() == 1
    (tmp_path / "l.csv").write_bytes("name\nCafé\n".encode("latin-1"))
    assert tables.read_csv(spark, str(tmp_path / "l.csv")).first()[0] == "Café"
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "e.csv"))
    (tmp_path / "w.xlsx").write_bytes(_workbook())
    sheet = tables.read_xlsx(spark, str(tmp_path / "w.xlsx"))
    assert sheet.columns == ["Product ID", "Price", "ok"] and [tuple(r) for r in sheet.collect()] == [("pen", 1.5, True), ("pen", None, False)]
    path = tables.write_clean(df, str(tmp_path / "out"), "org", "ds")
    assert spark.read.parquet(path).count() == 2
    tables.delete(spark, path)
    assert not (tmp_path / "out/org/ds/clean").exists()


def _dated_workbook() -> bytes:
    out = io.BytesIO()
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = '<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="inlineStr"><is><t>{name}</t></is></c></row><row><c r="A2" s="1"><v>45292</v></c></row><row><c r="A3" s="2"><v>45292.75</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="first" sheetId="2" r:id="b"/><sheet name="second" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet.format(ns=ns, name="listed second"))
        z.writestr("xl/worksheets/sheet2.xml", sheet.format(ns=ns, name="listed first"))
    return out.getvalue()


def test_workbooks_with_dates_and_listed_order(spark, tmp_path, monkeypatch):
    (tmp_path / "d.xlsx").write_bytes(_dated_workbook())
    sheet = tables.read_xlsx(spark, str(tmp_path / "d.xlsx"))
    assert sheet.columns == ["listed first"] and [r[0] for r in sheet.collect()] == ["2024-01-01", "2024-01-01 18:00:00"]
    assert tables.row_count(spark, str(tmp_path / "d.xlsx")) == 2
    monkeypatch.setattr(tables, "MAX_UPLOAD", 10)
    with pytest.raises(ValueError):
        tables.read_xlsx(spark, str(tmp_path / "d.xlsx"))


def test_quoted_line_ends_and_missing_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines, ""said"""\n2,x\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "q.csv")).collect()] == [(1, 'two\nlines, "said"'), (2, "x")]
    assert tables.row_count(spark, str(tmp_path / "q.csv")) == 2
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "none.csv"))


def test_ingest(spark, tmp_path):
    content = _dated_workbook()  # an archive has the time it was made
    got = tables.ingest(spark, content, str(tmp_path), "org", "ds", "my book.xlsx", "application/zip").first()
    assert (got["kind"], got["rows"]) == ("xlsx", 2) and (tmp_path / "org/ds/raw/my_book.xlsx").read_bytes() == content
    with pytest.raises(ValueError):
        tables.ingest(spark, b"PK broken", str(tmp_path), "org", "ds", "x.xlsx")


def test_uploads():
    assert tables.validate_upload(b"a,b\n1,2\n", "x.csv", "text/csv") == ("csv", 8)
    assert tables.validate_upload(_workbook(), "x.xlsx")[0] == "xlsx"
    for content, name in ((b"", "x.csv"), (b"a\x00", "x.csv"), (b"MZ", "x.exe"), (b"nope", "x.xlsx")):
        with pytest.raises(ValueError):
            tables.validate_upload(content, name)
    assert tables.sanitize_filename("../../etc/pass wd.csv") == "pass_wd.csv"
    with pytest.raises(ValueError):
        tables.contained("/data", "..", "x")


def test_raw_bytes_survive_cleaning_and_a_dataset_opens_as_what_it_is(spark, tmp_path):
    base, content = str(tmp_path / "base"), b"Order ID,City\n1,Lund\n1,Lund\n2,Turku\n"
    with pytest.raises(FileNotFoundError):
        tables.open_dataset(spark, base, "o", "d")
    tables.ingest(spark, content, base, "o", "d", "orders.csv")
    raw, cleaned = tables.open_dataset(spark, base, "o", "d")
    assert raw.count() == 3 and not cleaned
    named, _ = clean.normalize_names(raw)
    for fmt in ("parquet", "csv"):
        tables.write_clean(named.dropDuplicates(), base, "o", "d", fmt)
        opened, cleaned = tables.open_dataset(spark, base, "o", "d")
        assert cleaned and opened.columns == ["Order ID", "City"] and sorted(tuple(r) for r in opened.collect()) == [(1, "Lund"), (2, "Turku")]
    assert (tmp_path / "base/o/d/raw/orders.csv").read_bytes() == content


def test_resolve(spark):
    raw, cleaned = spark.createDataFrame([(1,)], "`Order ID` long"), spark.createDataFrame([(1,)], "order_id long")
    got, is_clean = tables.resolve(raw, cleaned, {"Order ID": "order_id"})
    assert got.columns == ["Order ID"] and is_clean and tables.resolve(raw, None, {}) == (raw, False)


def test_figures_of_a_cached_table_count_its_values_once(spark):
    df = spark.range(0, 3000, 1, 3).select((F.col("id") % 700).cast("double").alias("a"), (F.hash("id") / F.lit(7.0)).alias("b")).persist()
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    try:
        seen = df.mapInArrow(counted, df.schema)
        assert clean._fills(seen, ["a"], "median") == {"a": 324.5} and read.value == 3000
        assert clean._bounds(seen, ["a"]).keys() == {"a"} and read.value == 3 * 3000  # once to count rows
    finally:
        df.unpersist()
