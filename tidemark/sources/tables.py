"""Reading and writing tables: parquet, CSV, XLSX; checks of uploads; folders by organisation."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import NULL_TOKENS
from tidemark.operators.clean import normalize_name

#: Fixed values of the interface.
MAX_UPLOAD = 50 * 1024 * 1024
KINDS = {"csv": {"text/csv", "application/csv", "application/vnd.ms-excel", "text/plain", "application/octet-stream"}, "xlsx": {"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel", "application/zip", "application/octet-stream"}}
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of a CSV. One look at its lines tells the encoding, and whether quoted cells hold line ends: only then is a file read as a whole."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    look = spark.read.text(path).agg(F.max(~F.is_valid_utf8("value")).alias("latin"), F.max(quotes % 2 == 1).alias("open")).first()
    options = {"header": True, "multiLine": bool(look["open"]), "encoding": "ISO-8859-1" if look["latin"] else "UTF-8", "escape": '"', "mode": "PERMISSIVE"}
    return spark.read.options(**options).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header: null tokens become null, columns of numbers and booleans get their types, dates stay text.

    UTF-8, or Latin-1 where the file is no UTF-8. An empty file or one without rows is refused, and so
    is a path where nothing is.
    """
    try:
        return typed(_guarded(_csv(spark, path), path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"there is no table at {path}") from None
        raise


def _guarded(df: DataFrame, path: str) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} has no rows or no columns")
    return df


def typed(raw: DataFrame) -> DataFrame:
    """Text columns with null tokens taken out, each cast to the narrowest of long, double and boolean that holds all its values."""
    known = raw.select(*[F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    checks = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(raw.columns):
        v = F.col(f"`{c}`")
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(_NUMBER), 1)).alias(f"d{i}"),
            F.count(F.when(v.rlike("^[+-]?[0-9]{1,18}$"), 1)).alias(f"l{i}"),
            F.count(F.when(F.lower(v).isin("true", "false"), 1)).alias(f"b{i}"),
        ]
    one = known.agg(*checks).first()
    out = []
    for i, c in enumerate(raw.columns):
        n, v = one[f"n{i}"], F.col(f"`{c}`")
        to = None
        if n:
            # integers with nulls are read as floating point, as a data frame library would
            to = "long" if one[f"l{i}"] == n == one["rows"] else "double" if one[f"d{i}"] == n else "boolean" if one[f"b{i}"] == n else None
        out.append(v.cast(to).alias(c) if to else v)
    return known.select(*out)


#: Fixed values of the format: number formats that are dates, and the day that serial 0 stands for.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH = datetime(1899, 12, 30)
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _first_sheet(z: zipfile.ZipFile, names: set[str]) -> str:
    """The sheet that the workbook lists first; where it lists none, the file with the lowest number."""
    files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = targets.get(sheet.get(f"{_REL}id"), "")
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if name in names:
                return name
    if not files:
        raise ValueError("the workbook has no sheet")
    return files[0]


def _date_styles(z: zipfile.ZipFile, names: set[str]) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in names:
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", 0)): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_SHEET}numFmt")}
    dates = DATE_FORMATS | {k for k, code in own.items() if re.search("[dmyhs]", code, re.IGNORECASE)}
    cells = root.find(f"{_SHEET}cellXfs")
    return {k for k, xf in enumerate(cells if cells is not None else []) if int(xf.get("numFmtId", 0)) in dates}


def _moment(serial: str) -> str:
    when = EPOCH + timedelta(days=float(serial))
    return when.date().isoformat() if when == datetime(when.year, when.month, when.day) else when.isoformat(sep=" ", timespec="seconds")


def _column(reference: str | None, otherwise: int) -> int:
    letters = re.match("[A-Z]+", reference or "")
    if not letters:
        return otherwise
    at = 0
    for x in letters[0]:
        at = at * 26 + ord(x) - 64
    return at - 1


def _shared(z: zipfile.ZipFile, names: set[str]) -> list[str]:
    """Strings that cells refer to by number, read one after the other."""
    found: list[str] = []
    if "xl/sharedStrings.xml" in names:
        with z.open("xl/sharedStrings.xml") as f:
            for _, si in ElementTree.iterparse(f):
                if si.tag == f"{_SHEET}si":
                    found.append("".join(t.text or "" for t in si.iter(f"{_SHEET}t")))
                    si.clear()
    return found


def _cells(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text: shared and inline strings, numbers, dates as ISO text, booleans, texts of formulas. A row of the sheet is in memory at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared, dates = _shared(z, names), _date_styles(z, names)
        with z.open(_first_sheet(z, names)) as sheet:
            events = ElementTree.iterparse(sheet, ("start", "end"))
            holder = None
            for event, row in events:
                if event == "start":
                    holder = row if row.tag == f"{_SHEET}sheetData" else holder
                    continue
                if row.tag != f"{_SHEET}row":
                    continue
                cells: dict[int, str | None] = {}
                for k, c in enumerate(row.iter(f"{_SHEET}c")):
                    value, kind = c.find(f"{_SHEET}v"), c.get("t")
                    text = None if value is None else value.text
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                    elif kind == "b" and text is not None:
                        text = "true" if text == "1" else "false"
                    elif kind in (None, "n") and text is not None and int(c.get("s", 0)) in dates:
                        text = _moment(text)
                    cells[_column(c.get("r"), k)] = text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                if holder is not None:
                    holder.clear()  # rows that are done


def _sheet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns path, content of workbooks: their rows (path, at, cells), blank ones left out, some thousand at a time."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = (r for r in _cells(content.as_py()) if any(x is not None for x in r))
            at = 0
            while part := list(islice(rows, 5000)):
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], names=["path", "at", "cells"])
                at += len(part)


def _sheet(spark: SparkSession, path: str) -> DataFrame:
    try:
        files = spark.read.format("binaryFile").options(pathGlobFilter="*.xlsx").load(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if not files.filter(F.col("length") > MAX_UPLOAD).isEmpty():
        raise ValueError(f"{path} exceeds {MAX_UPLOAD} bytes")
    return files.select("path", "content").mapInArrow(_sheet_rows, "path string, at long, cells array<string>")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook (of at most MAX_UPLOAD bytes), parsed in a task; the first row has the names, dates become ISO text."""
    rows = _sheet(spark, path)
    head = rows.filter("at = 0").select("cells").first()
    if head is None:
        raise ValueError(f"{path} has no rows")
    names = [n or f"Unnamed: {i}" for i, n in enumerate(head["cells"])]
    body = rows.filter("at > 0").select(*[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return typed(_guarded(body, path))


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """The first sheets of all workbooks of a folder as one table, each parsed by a task of its own, rows as they come.

    The first row of each has its names; columns are matched by name, in the order in which they first come
    by path, and one that a workbook lacks is null there. Types are found over all workbooks.
    """
    rows = _sheet(spark, folder)
    heads = rows.filter("at = 0").select("path", "cells").orderBy("path").collect()  # a row for each workbook
    if not heads:
        raise FileNotFoundError(f"{folder} has no workbook with rows")
    names = list(dict.fromkeys(n or f"Unnamed: {i}" for h in heads for i, n in enumerate(h["cells"])))
    places = spark.createDataFrame([(h["path"], {n or f"Unnamed: {i}": i + 1 for i, n in enumerate(h["cells"])}) for h in heads], "path string, places map<string, int>")
    body = rows.filter("at > 0").join(F.broadcast(places), "path")
    return typed(_guarded(body.select(*[F.try_element_at("cells", F.col("places")[n]).alias(n) for n in names]), folder))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a CSV or the first sheet of a workbook, the header and blank lines not counted."""
    if path.lower().endswith(".xlsx"):
        return _sheet(spark, path).filter("at > 0").count()
    return _csv(spark, path).count()


def write_raw(spark: SparkSession, content: bytes, base: str, org: str, dataset: str, name: str) -> str:
    """An upload's bytes as they came, under {base}/{org}/{dataset}/raw, wherever Spark can write."""
    path = contained(base, org, dataset, "raw", sanitize_filename(name))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def ingest(spark: SparkSession, content: bytes, base: str, org: str, dataset: str, name: str, mime: str | None = None) -> DataFrame:
    """Check an upload, keep it as it came, and tell of it: path, kind, size_bytes, rows. What cannot be read is refused and not kept."""
    kind, size = validate_upload(content, name, mime)
    path = write_raw(spark, content, base, org, dataset, name)
    try:
        rows = row_count(spark, path)
    except Exception as e:
        delete(spark, path)
        raise ValueError(f"{name} cannot be read: {e}") from e
    return spark.createDataFrame([(path, kind, size, rows)], "path string, kind string, size_bytes long, rows long")


def sanitize_filename(name: str) -> str:
    base = re.sub(r"[^A-Za-z0-9._-]+", "_", PurePosixPath(name.replace("\\", "/")).name).lstrip(".")
    return base or "upload"


def contained(base: str, *parts: str) -> str:
    """base joined with parts; what would leave base is refused."""
    if any(p in ("", ".", "..") or "/" in p or "\\" in p for p in parts):
        raise ValueError(f"{parts} leaves {base}")
    return "/".join([base.rstrip("/"), *parts])


def validate_upload(content: bytes, name: str, mime: str | None = None) -> tuple[str, int]:
    """(kind, size) of a file that may be taken in; else an error that says why not."""
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending not in KINDS:
        raise ValueError(f"files of type {ending!r} are not taken")
    if mime and mime.split(";")[0].strip() not in KINDS[ending]:
        raise ValueError(f"{mime} does not fit .{ending}")
    if not content:
        raise ValueError("the file is empty")
    if len(content) > MAX_UPLOAD:
        raise ValueError(f"the file exceeds {MAX_UPLOAD} bytes")
    if ending == "csv":
        if b"\x00" in content:
            raise ValueError("a CSV holds no null bytes")
    else:
        if not content.startswith(b"PK"):
            raise ValueError("the file is no workbook")
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if "xl/workbook.xml" not in z.namelist():
                    raise ValueError("the file is no workbook")
        except zipfile.BadZipFile:
            raise ValueError("the workbook is damaged") from None
    return ending, len(content)


def write_clean(df: DataFrame, base: str, org: str, dataset: str, fmt: str = "parquet") -> str:
    """The cleaned table under {base}/{org}/{dataset}/clean, replacing an earlier one; the raw upload beside it stays."""
    path = contained(base, org, dataset, "clean")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    return path


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder, by name, none if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))) if fs.exists(at) else []


def open_dataset(spark: SparkSession, base: str, org: str, dataset: str) -> tuple[DataFrame, bool]:
    """A dataset from its folders: the cleaned table under the headers of the raw upload if it was cleaned (and whether so), else the upload."""
    raw_folder, clean_folder = contained(base, org, dataset, "raw"), contained(base, org, dataset, "clean")
    uploads = _files(spark, raw_folder)
    if not uploads:
        raise FileNotFoundError(f"{dataset} has no upload")
    path = f"{raw_folder}/{uploads[-1]}"
    raw = read_xlsx(spark, path) if path.lower().endswith(".xlsx") else read_csv(spark, path)
    parts = _files(spark, clean_folder)
    if not parts:
        return raw, False
    cleaned = read_csv(spark, clean_folder) if parts[0].endswith(".csv") else spark.read.parquet(clean_folder)
    return resolve(raw, cleaned, {c: normalize_name(c) for c in raw.columns})


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete artifacts wherever Spark can reach them; what is not there is no error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def resolve(raw: DataFrame, cleaned: DataFrame | None, normalized: dict[str, str]) -> tuple[DataFrame, bool]:
    """The cleaned table under the raw table's headers if there is one (and whether so). normalized: raw header to clean header."""
    if cleaned is None:
        return raw, False
    back = {b: a for a, b in normalized.items() if b in cleaned.columns and a not in cleaned.columns}
    return cleaned.withColumnsRenamed(back), True
