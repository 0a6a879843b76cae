"""Readers of document collections, annotations and logs."""

from __future__ import annotations

import io
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def text_documents(spark: SparkSession, path: str, *, recursive: bool = False, after: str | None = None, least: int = 0) -> DataFrame:
    """(path, doc_id, text) of the text files of a folder: whole files, UTF-8, undecodable bytes replaced.

    recursive: all sub-folders, and JSON files and files without ending as well.  after: only files whose
    path sorts behind this one (to take up an interrupted run).  least: shorter texts are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not recursive:
        reader = reader.option("pathGlobFilter", "*.txt")
    df = reader.load(path).select("path", "content")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    if recursive:
        df = df.filter(name.rlike(r"(?i)\.(txt|json|jsonl)$") | ~name.contains("."))
    if after:
        df = df.filter(F.col("path") > after)
    text = decoded("content")
    return df.select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("doc_id"), text.alias("text")).filter(F.length("text") >= least)


def decoded(content: str) -> Column:
    """Bytes as UTF-8 text, with replacement characters for what is not."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines under a fixed schema; blank lines and lines that are no JSON are left out.

    A path that does not exist is an empty table.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if found is None or len(found) == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header as strings: quoted fields may hold line breaks, a byte-order mark is no part of a name."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The rows of the first sheet of an Excel workbook; empty cells are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")]
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    rows = []
    for row in sheet.iter(_S + "row"):
        cells: dict[int, str | None] = {}
        for c in row.iter(_S + "c"):
            at = 0
            for x in (x for x in c.get("r", "A1") if x.isalpha()):
                at = at * 26 + ord(x) - 64
            v = c.find(_S + "v")
            text = "".join(t.text or "" for t in c.iter(_S + "t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            cells[at - 1] = text
        rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def xlsx_sheets(files: DataFrame, columns: list[str]) -> DataFrame:
    """(path, the given columns as strings) of the first sheets of workbooks (path, content), by their first rows as headers.

    A workbook is read by the task that holds it.  A column that a sheet lacks is null, other columns are left out; a file
    that is no workbook gives no row.
    """
    schema = StructType([StructField(c, StringType()) for c in ("path", *columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    header, *body = sheet_rows(bytes(content or b"")) or [[]]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                place = {str(h or "").strip(): k for k, h in enumerate(header)}
                out += [(path, *[r[place[c]] if c in place and place[c] < len(r) else None for c in columns]) for r in body]
            got = list(zip(*out)) or [()] * (len(columns) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in got], names=["path", *columns])

    return files.select("path", "content").mapInArrow(run, schema)


def batch_after(df: DataFrame, key: str, state: DataFrame, most: int) -> DataFrame:
    """The next ``most`` rows in the order of key, behind the last one that ``state`` (column last, of batches done) knows."""
    last = state.agg(F.max("last").alias("_last"))
    return df.join(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col(key) > F.col("_last"))).drop("_last").orderBy(key).limit(most)


#: Fixed value: the first bytes of an OLE compound file.
OLE_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
MOST_BYTES, TIMEOUT_S = 10 * 1024 * 1024, 30
EXTRACTED = "path string, text string, char_count int, error_code int, partial boolean"


def extract_doc(content: bytes) -> tuple[str | None, int, bool]:
    """(text, error code or 0, partial) of a legacy Word file, by the installed converter.

    400 empty or no such file, 408 too slow, 413 too large, 422 no text, 500 converter failed, 503 no converter.
    """
    if not content:
        return None, 400, False
    if len(content) > MOST_BYTES:
        return None, 413, False
    if content[:8] != OLE_MAGIC:
        return None, 400, False
    tool = shutil.which("antiword")
    if not tool:
        return None, 503, False
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:  # the converter reads a file; it is gone with the task
        f.write(content)
        f.flush()
        try:
            done = subprocess.run([tool, "-m", "UTF-8.txt", f.name], capture_output=True, timeout=TIMEOUT_S, check=False)
        except subprocess.TimeoutExpired:
            return None, 408, False
    if done.returncode:
        return None, 400 if b"not a Word Document" in done.stderr else 500, False
    text = done.stdout.decode("utf-8", "replace").strip()
    return (text, 0, bool(done.stderr.strip())) if text else (None, 422, False)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extract_docx(content: bytes) -> tuple[str | None, int, bool]:
    """The same for an Office Open XML document: one line a paragraph."""
    if not content:
        return None, 400, False
    if len(content) > MOST_BYTES:
        return None, 413, False
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, 400, False
    text = "\n".join("".join("\n" if n.tag == _W + "br" else "\t" if n.tag == _W + "tab" else n.text or "" for n in p.iter() if n.tag in (_W + "t", _W + "br", _W + "tab")) for p in body.iter(_W + "p")).strip()
    return (text, 0, False) if text else (None, 422, False)


def office_documents(files: DataFrame) -> DataFrame:
    """Text of (path, content): legacy files by their magic bytes, the rest as Office Open XML; see ``extract_doc``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = bytes(content or b"")
                text, code, partial = extract_docx(content) if content[:2] == b"PK" and not (path or "").lower().endswith(".doc") else extract_doc(content)
                got.append((path, text, len(text) if text else 0, code, partial))
            columns = list(zip(*got)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in EXTRACTED.split(", ")])

    return files.select("path", "content").mapInArrow(run, EXTRACTED)
