"""Rows of the first sheet of .xlsx workbooks, read in tasks: one workbook a row of binaryFile."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Tasks get what they run by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SCHEMA = "path string, row_item long, cells array<string>, error string"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Cells as text, by position; streamed, so a sheet is never whole in memory but for its shared strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == f"{_NS}si":
                    shared.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                    e.clear()
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for _, e in ElementTree.iterparse(z.open(sheets[0])):
            if e.tag != f"{_NS}row":
                continue
            row: list[str | None] = []
            for i, c in enumerate(e.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else i
                value = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                row += [None] * (at + 1 - len(row))
                row[at] = text
            e.clear()
            yield row


def read(spark: SparkSession, path: str, glob: str = "*.xlsx", skip: int = 1) -> DataFrame:
    """path, row_item (from 0 after the skipped header rows), cells, error. A workbook that can't be
    read is one row with its error; the others are not touched."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                out = []
                try:
                    for i, cells in enumerate(sheet_rows(content)):
                        if i >= skip:
                            out.append((name, i - skip, cells, None))
                        if len(out) == 1000:
                            yield pd.DataFrame(out, columns=["path", "row_item", "cells", "error"])
                            out = []
                except (zipfile.BadZipFile, ElementTree.ParseError, IndexError, KeyError, ValueError) as e:
                    out.append((name, -1, None, f"{type(e).__name__}: {e}"))
                if out:
                    yield pd.DataFrame(out, columns=["path", "row_item", "cells", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(rows, SCHEMA)
