"""The workbook sink: what is written is read back row for row, and a failure leaves nothing."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from scholium.plans import exports
from scholium.sources import workbooks, xlsx


def sheets(path):
    with zipfile.ZipFile(path) as z:
        return z.read("xl/workbook.xml").decode(), [n for n in z.namelist() if "worksheets/" in n]


def test_read_back_row_for_row(spark, tmp_path):
    rows = [(f"m{i % 3}", i, None if i % 5 == 0 else f"<t> & \"{i}\"\x01 é\n  x ", i / 4 if i % 2 else None, i % 2 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "who string, i int, title string, score double, good boolean").repartition(6)
    out = str(tmp_path / "books")
    workbooks.write(df, out, file=F.col("who"), order=["i"], columns=["i", "title", "score", "good"])
    assert sorted(os.listdir(out)) == ["m0.xlsx", "m1.xlsx", "m2.xlsx"]
    text = lambda v: None if v is None else str(int(v)) if isinstance(v, bool) else str(v).replace("\x01", "")
    for who in ("m0", "m1", "m2"):
        got = [r.cells for r in xlsx.read(spark, f"{out}/{who}.xlsx", skip=0).orderBy("row_item").collect()]
        wanted = [["i", "title", "score", "good"], *([text(v) for v in r[1:]] for r in rows if r[0] == who)]
        assert got == wanted
    workbooks.write(df.where("who = 'm1'"), out, file=F.col("who"), order=["i"], columns=["i"])
    assert os.listdir(out) == ["m1.xlsx"]  # overwritten as a whole
    workbooks.write(df.limit(0), out, file=F.col("who"), columns=["i"], mode="append")
    assert os.listdir(out) == ["m1.xlsx"]


def test_sheets_and_archives(spark, tmp_path):
    rows = [(g, f"Last{m}", "First", s, i) for g in ("g/1", "g2", None) for m in range(3) for s in ("Publications", "Citations", "a [very] long name of a sheet, of 40 chars") for i in range(2)]
    df = spark.createDataFrame(rows, "g string, last string, first string, s string, i int").repartition(5)
    out = str(tmp_path / "zips")
    exports.workbooks_by_member(df, out, group="g", last="last", first="first", sheet="s", order=["i"], columns=["i", "s"])
    assert sorted(os.listdir(out)) == ["_.zip", "g2.zip", "g_1.zip"]
    with zipfile.ZipFile(f"{out}/g_1.zip") as z:
        assert sorted(z.namelist()) == [f"Last{m}_F_AB.xlsx" for m in range(3)]
        index, parts = sheets(io.BytesIO(z.read("Last1_F_AB.xlsx")))
        assert len(parts) == 3 and 'name="Citations"' in index and 'name="a  very  long name of a sheet, "' in index


def test_full_sheets_go_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "MOST_ROWS", 4)
    book = workbooks._Workbook(str(tmp_path / "b.xlsx"), ["h"])
    for i in range(7):
        book.add("S", [i])
    book.close()
    index, parts = sheets(tmp_path / "b.xlsx")
    assert len(parts) == 3 and 'name="S (3)"' in index
    assert [list(xlsx.sheet_rows((tmp_path / "b.xlsx").read_bytes()))] == [[["h"], ["0"], ["1"], ["2"]]]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "books")
    df = spark.range(400).select((F.col("id") % 7).cast("string").alias("who"), "id").withColumn("bad", F.expr("IF(id = 399, raise_error('no'), id)"))
    with pytest.raises(Exception, match="no"):
        workbooks.write(df, out, file=F.col("who"), order=["id"], columns=["id", "bad"])
    assert not os.path.exists(out) or os.listdir(out) == []


def test_sheets_of_a_report(spark):
    pubs = spark.createDataFrame([("o", "p1", "One", ["a", "b"], "f", "7", "2020-01-02"), ("o", "p2", "Two", ["b"], "f", None, "bad"), ("o", "p3", "No score", ["a"], "f", None, "2020"), ("o", "p4", "No forum", ["a"], "none", None, "2020"), (None, "c1", "Citing", ["c", "a"], "f", "1", "2021-05-05"), (None, "c2", "Other", ["c"], "f", "2", "2022-05-05")], "owner string, id string, title string, author_ids array<string>, forum_id string, volume string, cover_date string")
    authors = spark.createDataFrame([("a", "Ann"), ("b", "Bob"), ("c", "Cid")], "id string, name string")
    forums = spark.createDataFrame([("f", "Forum")], "id string, name string")
    scores = spark.createDataFrame([("o", "p1", "CS", 8.0, 4.0), ("o", "p2", "CS", 2.0, 2.0), ("o", "p4", "CS", 1.0, 1.0)], "owner string, id string, category string, score double, author_score double")
    found = exports.publication_sheet(pubs, scores, authors, forums)
    assert found.columns == ["owner", "id", *exports.PUBLICATION_SHEET]
    assert sorted(tuple(r)[2:] for r in found.collect()) == [("One", "Ann, Bob", "Forum", "7", "2020", "No", "CS", 8.0, 4.0), ("Two", "Bob", "Forum", None, None, "No", "CS", 2.0, 2.0)]
    cites = spark.createDataFrame([("o", "p1", "c1"), ("o", "p1", "c2")], "owner string, cited string, citing string")
    points = spark.createDataFrame([("o", "p1", c, "CS", 8.0, 4.0) for c in ("c1", "c2")], "owner string, cited string, citing string, category string, score double, author_score double")
    every = exports.citation_sheet(pubs.drop("owner"), cites, points, authors, forums)
    assert every.columns == ["owner", "cited", "citing", *exports.CITATION_SHEET] and every.count() == 2
    others = exports.citation_sheet(pubs.drop("owner"), cites, points, authors, forums, own_authors=spark.createDataFrame([("o", "a")], "owner string, author_id string"))
    assert [tuple(r)[3:] for r in others.collect()] == [("One", "Other", "Cid", "Forum", "2", "2022", "No", "CS", 8.0, 4.0)]
