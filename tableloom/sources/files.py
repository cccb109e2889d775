"""Read raw tables and write results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableloom.functions.scalars import NA_TOKENS, nan_to_null, nullify_tokens, table_name


def load(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType | str | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    nan_as_null: bool | None = None,
) -> DataFrame:
    """One table from CSV, XLSX, JSON or Parquet. Missing-value tokens and NaN become null.

    A schema saves the inference pass over the files (CSV, JSON, XLSX), so give one for anything large. Parquet has
    nulls of its own and is read as it is, which lets filters reach the files; ask for `nan_as_null`
    where a writer stored NaN instead.
    """
    if fmt == "csv":
        return read_csv(spark, path, schema, na_tokens)
    if fmt == "xlsx":
        return read_workbooks(spark, path, schema, na_tokens)
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    raw = reader.format(fmt).load(path)
    clean = fmt != "parquet" if nan_as_null is None else nan_as_null
    return clean_missing(raw, na_tokens=()) if clean else raw


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header. Dates stay text unless the schema says otherwise, as in the uploads served here.

    Without a schema, types are those of what is left when the missing-value tokens are gone.

    `multi_line` accepts line breaks inside quotes, but then each file is read by one task.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is None:
        return typed(clean_missing(reader.csv(path), na_tokens))
    fields = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    # Read as text first: a token such as 'NA' in a number column is a missing value, not a bad row.
    text = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in fields])).csv(path)
    return text.select(
        *[nullify_tokens(F.col(f"`{f.name}`"), na_tokens).try_cast(f.dataType).alias(f.name) for f in fields]
    )


def typed(text: DataFrame) -> DataFrame:
    """Columns of text as int, bigint, double or boolean where every value is one; one pass decides for all columns."""
    kinds = ("int", "bigint", "double", "boolean")
    tests = [F.count(F.col(f"`{c}`").try_cast(k)) for c in text.columns for k in kinds]
    counts = iter(text.agg(*[F.count(F.col(f"`{c}`")) for c in text.columns], *tests).first() if text.columns else ())
    present = [next(counts) for _ in text.columns]
    cols = []
    for c, n in zip(text.columns, present):
        fits = [k for k in kinds if next(counts) == n]
        value = F.col(f"`{c}`")
        value = value.try_cast(fits[0]) if n and fits else value
        cols.append((nan_to_null(value) if n and fits[:1] == ["double"] else value).alias(c))
    return text.select(*cols)


def clean_missing(df: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """One kind of missing value: tokens in text and NaN in numbers become null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        elif isinstance(f.dataType, T.StringType) and na_tokens:
            c = nullify_tokens(c, na_tokens)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


# The numbers of the built-in formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(styles: bytes, main: str) -> set[int]:
    """Numbers of the cell styles that show a date or time."""
    root = ElementTree.fromstring(styles)
    own = {}
    for f in root.iter(f"{main}numFmt"):
        # What is quoted, escaped or in brackets is no part of the pattern.
        pattern = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        own[int(f.get("numFmtId"))] = bool(re.search("[ymdhs]", pattern)) and "general" not in pattern
    formats = [int(x.get("numFmtId", 0)) for x in next(root.iter(f"{main}cellXfs"), [])]
    return {i for i, n in enumerate(formats) if own.get(n, n in DATE_FORMATS)}


def _date_text(serial: str, since_1904: bool) -> str:
    """Days since the first day of the workbook's calendar as a date, with the time if there is one."""
    try:
        days = float(serial)
        # The older calendar has a 29 February 1900.
        start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)
        moment = start + timedelta(seconds=round(days * 86_400))
    except (ValueError, OverflowError):
        return serial
    return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _first_sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """Cells of the first sheet of a workbook, row by row, as column number -> text; dates by the style of their cell."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in root.iter(f"{main}si")]
        dated = _date_styles(book.read("xl/styles.xml"), main) if "xl/styles.xml" in names else set()
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        since_1904 = any(p.get("date1904") in ("1", "true") for p in workbook.iter(f"{main}workbookPr"))
        sheet = next(workbook.iter(f"{main}sheet"))
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(l.get("Target") for l in links if l.get("Id") == sheet.get(rel)).lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{main}row":
                    continue
                cells = {}
                for i, c in enumerate(row.iter(f"{main}c")):
                    at = _column_number(c.get("r")) if c.get("r") else i
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{main}t"))
                    else:
                        v = c.find(f"{main}v")
                        if v is not None and v.text is not None:
                            kind = c.get("t", "n")
                            text = shared[int(v.text)] if kind == "s" else v.text
                            if kind == "b":
                                text = "true" if text == "1" else "false"
                            elif kind == "n" and int(c.get("s", 0)) in dated:
                                text = _date_text(text, since_1904)
                            cells[at] = text
                yield cells
                row.clear()


def _header(files: DataFrame) -> list[str]:
    """Column names of the first workbook by path, in order."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                cells = next(_first_sheet_rows(content), {})
                yield pd.DataFrame({"path": [path], "names": [[text.strip() for _, text in sorted(cells.items())]]})

    first = files.mapInPandas(parse, "path string, names array<string>").agg(F.min_by("names", "path").alias("names")).first()
    return first["names"] or []


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str | None = None, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """First sheet of every workbook under `path`, one task per workbook; the format bounds a sheet's rows.

    Cells that show a date read as `yyyy-MM-dd`, with the time where there is one. Without a schema the columns are
    those of the first workbook by path, and types are those of their values; dates stay text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    if schema is None:
        fields = [T.StructField(n, T.StringType()) for n in _header(files)]
    else:
        fields = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    names = [f.name for f in fields]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = _first_sheet_rows(content)
                header = {text.strip(): at for at, text in next(rows, {}).items()}
                out = []
                for cells in rows:
                    out.append([cells.get(header.get(n, -1)) for n in names])
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names, dtype=object)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    cells = files.select("content").mapInPandas(parse, text)
    if schema is None:
        return typed(clean_missing(cells, na_tokens))
    return cells.select(*[nullify_tokens(F.col(f"`{f.name}`"), na_tokens).try_cast(f.dataType).alias(f.name) for f in fields])


def write_table(df: DataFrame, root: str, name: str, prefix: str = "", mode: str = "overwrite") -> str:
    """Store a table as Parquet under its normalised name; 'append' adds to it. Returns the path."""
    path = f"{root.rstrip('/')}/{prefix}{table_name(name)}"
    df.write.mode(mode).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header in every part file; quotes and line breaks in text survive a round trip."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def json_records(df: DataFrame) -> DataFrame:
    """Every row as one JSON record."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("record"))
