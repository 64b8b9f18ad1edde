"""Workbooks as a sink: each task streams its files, sheet by sheet, and they appear when all tasks are done.

The folder must be one that the driver and all executors mount. A task writes hidden files; the driver's commit gives them their
names, and a task or job that fails removes what it wrote.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of the format: rows of a sheet and characters of its name at most, namespaces.
MOST_ROWS, MOST_NAME = 1_048_576, 31
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _cell(i: int, row: int, value) -> str:
    at = f'r="{_column(i)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c {at}><v>{value!r}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(value)))}</t></is></c>'


class _Workbook:
    """One file, written from its first sheet to its last; a sheet that is full goes on in another."""

    def __init__(self, path: str, header: list[str]):
        self.zip, self.header, self.names = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED), header, []
        self.sheet, self.row, self.name = None, 0, None

    def _begin(self, name: str) -> None:
        self._end()
        plain = re.sub(r"[\[\]:*?/\\]", " ", name)[:MOST_NAME] or "Sheet"
        shown, k = plain, 2
        while shown.lower() in {n.lower() for n in self.names}:
            shown, k = f"{plain[: MOST_NAME - 5]} ({k})", k + 1
        self.names.append(shown)
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.name, self.row = name, 0
        self._put(self.header)

    def _put(self, values: list) -> None:
        self.row += 1
        self.sheet.write(f'<row r="{self.row}">{"".join(_cell(i, self.row, v) for i, v in enumerate(values))}</row>'.encode())

    def _end(self) -> None:
        if self.sheet:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()

    def add(self, sheet: str, values: list) -> None:
        if self.sheet is None or sheet != self.name or self.row == MOST_ROWS:
            self._begin(sheet)
        self._put(values)

    def close(self) -> None:
        self._end()
        n = range(1, len(self.names) + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, self.names, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
        }
        for name, body in parts.items():
            self.zip.writestr(name, _HEAD + body)
        self.zip.close()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceWriter):
    """Rows (archive, file, sheet, cells...), those of an archive and file next to each other."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.header, self.overwrite = path.removeprefix("file://"), names[3:], overwrite
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        made: list[tuple[str, str]] = []
        book = archive = at = None

        def hidden(name: str) -> str:
            made.append((os.path.join(self.path, f".{uuid.uuid4().hex}.part"), name))
            return made[-1][0]

        def finish() -> None:
            if book:
                book.close()
                if archive:  # a workbook of an archive goes into it, and has no name of its own
                    part, name = made.pop()
                    archive.write(part, name)
                    os.remove(part)

        try:
            for row in rows:
                own, file, sheet = row[0], row[1], row[2]
                if (own, file) != at:
                    finish()
                    if own is not None and (at is None or own != at[0]) or own is None and archive:
                        if archive:
                            archive.close()
                        archive = zipfile.ZipFile(hidden(f"{_named(own)}.zip"), "w", zipfile.ZIP_STORED) if own is not None else None
                    book, at = _Workbook(hidden(f"{_named(file)}.xlsx"), self.header), (own, file)
                book.add(sheet if sheet is not None else "Sheet", list(row[3:]))
            finish()
            if archive:
                archive.close()
        except BaseException:
            self.abort([_Written(made)])
            raise
        return _Written(made)

    def commit(self, messages: list) -> None:
        new = [x for m in messages if m for x in m.files]
        before = {f for f in os.listdir(self.path) if f.endswith((".xlsx", ".zip"))} if self.overwrite else set()
        for part, name in new:
            os.replace(part, os.path.join(self.path, name))
        for name in before - {name for _, name in new}:
            os.remove(os.path.join(self.path, name))

    def abort(self, messages: list) -> None:
        for part in (p for m in messages if m for p, _ in m.files):
            if os.path.exists(part):
                os.remove(part)


def _named(x) -> str:
    return re.sub(r"[^\w.-]+", "_", str(x)).strip(".") or "_"


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options["path"], schema.names, overwrite)


def write(df: DataFrame, path: str, *, file: Column, sheet: Column | None = None, order: list[str] = (), archive: Column | None = None, columns: list[str], mode: str = "overwrite") -> None:
    """A workbook for each value of file, with a sheet for each value of sheet (in its order) and a header of the columns; with
    archive, one ZIP of workbooks for each of its values. Overwrite also removes the folder's other workbooks, once all are written.

    A file is written by one task, row after row: memory does not grow with it. A row without file is in the workbook ``_``; a cell that
    is null is empty; a sheet of more rows than the format has goes on in a second one."""
    df.sparkSession.dataSource.register(WorkbookSource)
    own = [F.lit(None).cast("string") if archive is None else F.coalesce(archive.cast("string"), F.lit("_")), F.coalesce(file.cast("string"), F.lit("_")), F.lit("Sheet") if sheet is None else F.coalesce(sheet.cast("string"), F.lit("Sheet"))]
    kinds = dict(df.dtypes)
    plain = [F.col(c).cast("double") if kinds[c].startswith("decimal") else F.col(c) if kinds[c] in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string") else F.col(c).cast("string") for c in columns]
    rows = df.select(*(x.alias(f"_w{i}") for i, x in enumerate(own)), *(x.alias(c) for x, c in zip(plain, columns, strict=True)), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    dealt = rows.repartition("_w1" if archive is None else "_w0").sortWithinPartitions("_w0", "_w1", "_w2", *(f"_o{i}" for i in range(len(order))))
    dealt.select("_w0", "_w1", "_w2", *columns).write.format("workbooks").mode("overwrite" if mode == "overwrite" else "append").save(path)
