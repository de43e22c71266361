"""Workbooks in tasks, and experiments side by side."""

import io
import time
import zipfile
from datetime import datetime

import pytest

from cairn.plans import cli
from cairn.plans.jobs import run_jobs
from cairn.sources import readers

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = f'<styleSheet {_NS}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'


def book(rows, shared=(), late=False, merged=""):
    """A workbook of cells as XML: (attributes, inside) or None."""
    body = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" {c[0]}>{c[1]}</c>' for j, c in enumerate(r) if c) + "</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}><sheetData>{body}</sheetData>{merged}</worksheet>")
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f'<workbook {_NS}><workbookPr date1904="{int(late)}"/></workbook>')
    return out.getvalue()


def text(t):
    return 't="inlineStr"', f"<is><t>{t}</t></is>"


def value(v, more=""):
    return more, f"<v>{v}</v>"


ROWS = [
    [text("id"), text("group"), None, text("day"), text("id"), text("mixed"), text("yes"), text("text")],
    [value(1), value(2.5), value(7), value(45292.5, 's="1"'), value(1.0, 's="3"'), value(1.5), value(1, 't="b"'), value(0, 't="s"')],
    [value(2), value(3), None, value(59, 's="2"'), value(2.25, 's="3"'), text("x"), value(0, 't="b"'), value(1, 't="s"')],
    [value(3), None, value(8), None, None, value(45292, 's="2"'), None, text("")],
]


def test_types_dates_and_merged_headers(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book(ROWS, ["hello", "world"], merged='<mergeCells><mergeCell ref="B1:C1"/></mergeCells>'))
    df = readers.load(spark, str(tmp_path / "a.xlsx"))
    assert df.dtypes == [("id", "bigint"), ("group", "double"), ("_2", "bigint"), ("day", "timestamp_ntz"), ("id.1", "double"), ("mixed", "string"), ("yes", "boolean"), ("text", "string")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 2.5, 7, datetime(2024, 1, 1, 12), 1.0, "1.5", True, "hello"), (2, 3.0, None, datetime(1900, 2, 28), 2.25, "x", False, "world"), (3, None, 8, None, None, "2024-01-01 00:00:00", None, ""),
    ]


def test_several_files_meet_by_name(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xlsx").write_bytes(book([[text("id"), text("a")], [value(1), value(0)]], late=True))
    (tmp_path / "deep" / "b.xlsx").write_bytes(book([[text("b"), text("id")], *[[text(f"t{i}"), value(i + 0.5)] for i in range(30)]]))
    (tmp_path / "note.txt").write_text("no workbook")
    df = readers.load_excel(spark, str(tmp_path))
    assert df.dtypes == [("id", "double"), ("a", "bigint"), ("b", "string")] and df.count() == 31
    assert tuple(df.where("a is not null").first()) == (1.0, 0, None) and df.where("b = 't7'").first()["id"] == 7.5
    assert df.rdd.getNumPartitions() > 1
    (tmp_path / "empty.xlsx").write_bytes(book([]))
    assert readers.load_excel(spark, str(tmp_path / "empty.xlsx")).columns == []


def test_days_from_1904(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book([[text("d")], [value(0, 's="1"')], [value(365.25, 's="2"')]], late=True))
    assert [r[0] for r in readers.load(spark, str(tmp_path / "a.xlsx")).orderBy("d").collect()] == [datetime(1904, 1, 1), datetime(1904, 12, 31, 6)]


def test_jobs_overlap_and_fail_alone(spark):
    def work(i):
        if i == 2:
            raise ValueError("two")
        time.sleep(0.5)
        return spark.range(10 * (i + 1)).count()

    found = run_jobs(spark, {f"j{i}": lambda i=i: work(i) for i in range(5)}, 3)
    assert list(found) == [f"j{i}" for i in range(5)] and [o.value for o in found.values()] == [10, 20, None, 40, 50]
    assert str(found["j2"].error) == "two" and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert found["j1"].began < found["j0"].ended and found["j4"].began >= min(found[j].ended for j in ("j0", "j1", "j2"))
    one = run_jobs(spark, {k: lambda: time.sleep(0.05) for k in "abc"}, 1)
    assert one["b"].began >= one["a"].ended and one["c"].began >= one["b"].ended


def test_all_experiments(spark, tmp_path, monkeypatch, capsys):
    """Each gets the one stored cohort; one that fails is counted, and the others' tables are there."""
    plans = []

    def good(df, o):
        plans.append(df.inputFiles())
        return cli.EXPERIMENTS_RESULT({"t": df.groupBy("k").count()})

    def bad(df, o):
        raise ValueError("no such column")

    from cairn.plans import experiments

    monkeypatch.setattr(cli, "EXPERIMENTS_RESULT", experiments.Result, raising=False)
    monkeypatch.setattr(cli, "EXPERIMENTS", {"a": good, "b": bad, "c": good, "edas": bad})
    monkeypatch.setattr(cli, "parser", lambda: type("P", (), {"parse_args": staticmethod(lambda argv: type("O", (), {"data": argv[0], "experiment": "all", "output_dir": argv[1], "contrast_workers": 2})())})())
    spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, k string").write.parquet(str(tmp_path / "in.parquet"))
    assert cli.main([str(tmp_path / "in.parquet"), str(tmp_path / "out")], spark) == 1
    assert len(plans) == 2 and plans[0] == plans[1] and "in.parquet" not in plans[0][0]
    assert "b failed: no such column" in capsys.readouterr().err
    for n in "ac":
        assert spark.read.csv(f"{tmp_path}/out/{n}_t", header=True).count() == 2


@pytest.mark.parametrize("v", ["file.sav", "file.xls", "file.doc"])
def test_other_formats_are_errors(spark, v):
    with pytest.raises(ValueError, match="Unsupported"):
        readers.load(spark, v)
