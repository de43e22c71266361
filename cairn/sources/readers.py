"""Loading tables by suffix, spec sheets, rules and coordinates."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.operators.clean import missing_to_null
from cairn.operators.curate import SpecRow, spec_rows

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _place(reference: str) -> int:
    """Column number of a cell reference like BC12, from 0."""
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


# Number formats of dates and times that need no text of their own.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    # What stands in quotes, brackets or behind a backslash is no part of a date.
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*]|\\.', "", f.get("formatCode", "")).casefold())}
    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def sheet_rows(data: bytes) -> Iterator[list]:
    """Cells of the first sheet of a workbook: numbers as float, dates and times as datetime, texts, booleans, None. Rows are read one at a time."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(book)
        late = "xl/workbook.xml" in names and any(x.get("date1904") in ("1", "true") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}workbookPr"))
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        with book.open(first) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _place(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif v is not None and v.text is not None:
                        out[at] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e", "d") else float(v.text)
                        if isinstance(out[at], float) and int(cell.get("s", 0)) in dates:
                            out[at] = _moment(out[at], late)
                row.clear()
                yield out


def _moment(serial: float, late: bool) -> datetime:
    """Day numbers count from the end of 1899 (the format has a 29 February 1900), or from 1904; to the nearest millisecond."""
    start = datetime(1904, 1, 1) if late else datetime(1899, 12, 30 + (serial < 60))
    return start + timedelta(milliseconds=round(serial * 86_400_000))


def workbook(spark: SparkSession, path: str) -> bytes:
    """A file's bytes through Spark's reader, so any store will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _headed(data: bytes) -> tuple[list[str], Iterator[list]]:
    """Names of the columns, from the first row, and the rows below. Blank names (as in merged cells) are _ and the place; of equal names later ones get .1, .2 ..."""
    rows = sheet_rows(data)
    names: list[str] = []
    for i, c in enumerate(next(rows, [])):
        name = str(c) if c is not None else f"_{i}"
        same, k = name, 0
        while name in names:
            k += 1
            name = f"{same}.{k}"
        names.append(name)
    return names, rows


#: What a column's cells are: bits that are summed by "or".
_WHOLE, _FRACTION, _TEXT, _YES_NO, _MOMENT = 1, 2, 4, 8, 16


def _bit(v) -> int:
    if v is None:
        return 0
    return _YES_NO if isinstance(v, bool) else (_WHOLE if v.is_integer() else _FRACTION) if isinstance(v, float) else _MOMENT if isinstance(v, datetime) else _TEXT


def _found_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, place, name, bits) of (path, content): the columns of each file."""
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names, rows = _headed(data)
            bits = [0] * len(names)
            for row in rows:
                for i, v in enumerate(row[: len(names)]):
                    bits[i] |= _bit(v)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string()), pa.array(bits, pa.int32())], names=["path", "place", "name", "bits"])


_KINDS = {0: "string", _WHOLE: "long", _FRACTION: "double", _WHOLE | _FRACTION: "double", _YES_NO: "boolean", _MOMENT: "timestamp_ntz"}


def _as_text(v) -> str | None:
    return None if v is None else f"{v:.17g}" if isinstance(v, float) and float(f"{v:g}") != v else f"{v:g}" if isinstance(v, float) else v.isoformat(" ") if isinstance(v, datetime) else str(v)


def _cells(names: list[str], kinds: list[str], size: int = 10_000):
    """Rows of (path, content) with these columns."""
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
    make = {"string": _as_text, "long": lambda v: None if v is None else int(v)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                found, rows = _headed(data)
                at = {n: i for i, n in enumerate(found)}
                while held := list(islice(rows, size)):
                    columns = []
                    for name, kind in zip(names, kinds):
                        i = at.get(name)
                        values = [r[i] if i is not None and i < len(r) else None for r in held]
                        columns.append(pa.array(list(map(make[kind], values)) if kind in make else values, types[kind]))
                    yield pa.RecordBatch.from_arrays(columns, names=[f"_{i}" for i in range(len(names))])

    return run


def load_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each workbook (a file, a folder or a pattern), with its header row; columns of several meet by name.

    A task reads a file row by row. One pass finds the columns and what their cells are, and only that comes to the driver;
    a column of whole numbers is long, of numbers double, of dates timestamp_ntz, of yes and no boolean, of anything else text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")
    n = max(1, files.select("path").count())
    files = files.repartition(n) if n > 1 else files
    bits: dict[str, int] = {}
    for r in files.mapInArrow(_found_columns, "path string, place int, name string, bits int").orderBy("path", "place").collect():
        bits[r["name"]] = bits.get(r["name"], 0) | r["bits"]
    if not bits:
        return spark.createDataFrame([], "")
    names, kinds = list(bits), [_KINDS.get(b, "string") for b in bits.values()]
    cells = files.mapInArrow(_cells(names, kinds), ", ".join(f"_{i} {k}" for i, k in enumerate(kinds)))
    return cells.toDF(*names)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by the path's suffix: .parquet and .pq, .csv (header, inferred types), .xlsx. Other suffixes: ValueError, also those of binary workbooks (.xls) and of SPSS (.sav)."""
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".xlsx"):
        return load_excel(spark, path)
    if path.endswith((".xls", ".sav")):
        raise ValueError(f"Unsupported file format: {path} (no reader of this binary format is at hand; save it as .xlsx, .csv or .parquet)")
    raise ValueError(f"Unsupported file format: {path}")


def load_clean(spark: SparkSession, path: str) -> DataFrame:
    return missing_to_null(load(spark, path))


def load_spec(spark: SparkSession, path: str) -> list[SpecRow]:
    """A variable specification from a headerless sheet or CSV."""
    if path.endswith(".csv"):
        return spec_rows([list(r) for r in spark.read.csv(path, header=False).collect()])
    return spec_rows(sheet_rows(workbook(spark, path)))


def load_rules(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_coordinates(spark: SparkSession, path: str, required: tuple[str, ...] = ("umap_dimension_1", "umap_dimension_2", "cluster")) -> DataFrame:
    """A coordinates CSV; ValueError lists required columns that it lacks."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"Missing required columns: {missing}")
    return df


