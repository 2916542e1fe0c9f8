"""Word documents as a data source: ``spark.read.format("docx").load(folder)``, and as a sink of paragraphs.

A document is a zip of XML; its body is read in order, element by element, so a long one isn't held as a tree. A row is a paragraph or
a table's cell. Files that can't be read give one row with the error. Splits are files of about ``SPLIT`` bytes together, so small
files share a task; a file is never cut. Paths may be of any file system that Arrow opens; where only Spark's readers reach
a store, ``from_binary`` reads the same rows from ``binaryFile``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, ord int, kind string, table_no int, row_no int, col_no int, style string, text string, error string"
SPLIT = 32 << 20
# Fixed values of the format: its namespace, and what a package must have.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NS = W[1:-1]
TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def parts(content: bytes) -> Iterator[tuple]:
    """``(ord, kind, table_no, row_no, col_no, style, text)`` of a document's body in order; cells of nested tables belong to the cell around them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as f:
        ord_, table, row, col, depth = 0, -1, -1, -1, 0
        text: list[str] = []
        cell: list[str] = []
        style = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            tag = e.tag.removeprefix(W)
            if event == "start":
                if tag == "tbl":
                    depth += 1
                    if depth == 1:
                        table, row = table + 1, -1
                elif depth == 1 and tag == "tr":
                    row, col = row + 1, -1
                elif depth == 1 and tag == "tc":
                    col, cell = col + 1, []
                elif tag == "p":
                    text, style = [], None
                continue
            if tag == "t":
                text.append(e.text or "")
            elif tag == "tab":
                text.append("\t")
            elif tag in ("br", "cr"):
                text.append("\n")
            elif tag == "pStyle":
                style = e.get(f"{W}val")
            elif tag == "p":
                if depth:
                    cell.append("".join(text))
                else:
                    yield ord_, "paragraph", None, None, None, style, "".join(text)
                    ord_ += 1
                e.clear()
            elif tag == "tc" and depth == 1:
                yield ord_, "cell", table, row, col, None, "\n".join(cell)
                ord_ += 1
                e.clear()
            elif tag == "tbl":
                depth -= 1
                e.clear()


def rows_of(path: str, content: bytes) -> list[tuple]:
    """All rows of a file; of one that can't be read to its end a row with the error alone."""
    try:
        return [(path, *p, None) for p in parts(content)]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, RuntimeError, ValueError, EOFError) as e:
        return [(path, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out, size = [[]], 0
        for info in sorted((i for i in found if i.is_file and i.path.lower().endswith(".docx")), key=lambda i: i.path):
            if out[-1] and size + info.size > SPLIT:
                out, size = [*out, []], 0
            out[-1].append(info.path)
            size += info.size
        return [_Files(p) for p in out]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                yield from rows_of(path, f.read())


class DocxSource(DataSource):
    """``.docx`` files beneath the folder of option ``path``, recursively."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def load(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(DocxSource)
    return spark.read.format("docx").load(folder)


def from_binary(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows by Spark's own reader of files."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            out = pd.DataFrame([r for path, content in zip(pdf["path"], pdf["content"]) for r in rows_of(path, bytes(content))], columns=names)
            yield out.astype({c: "Int32" for c in ("ord", "table_no", "row_no", "col_no")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(of, SCHEMA)


def texts(rows: DataFrame) -> DataFrame:
    """Rows ``(path, text, error)``: the paragraphs of each file joined by line ends, as they are in order; cells are left out."""
    lines = F.array_sort(F.collect_list(F.when(F.col("kind") == "paragraph", F.struct("ord", "text"))))
    return rows.groupBy("path").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), F.max("error").alias("error"))


def package(paragraphs: list[str]) -> bytes:
    """A document of plain paragraphs. Characters that XML can't have become spaces."""
    ok = lambda s: "".join(c if c in "\t\n\r" or 0x20 <= ord(c) <= 0xD7FF or 0xE000 <= ord(c) <= 0xFFFD or ord(c) > 0xFFFF else " " for c in s)
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(ok(p))}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("_rels/.rels", RELATIONS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NS}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write(docs: DataFrame, folder: str) -> int:
    """A file ``<doc_id>.docx`` beneath ``folder`` for each of ``docs(doc_id, text)``, a paragraph a line; a null text has none. How many were written.

    Written aside and renamed, so a task that is done again leaves whole files.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                aside = f"{root}/.{doc_id}-{id(pdf)}.part"
                with system.open_output_stream(aside) as f:
                    f.write(package((text or "").split("\n") if text is not None else []))
                system.move(aside, f"{root}/{doc_id}.docx")
            yield pd.DataFrame({"n": [len(pdf)]})

    return docs.select("doc_id", "text").mapInPandas(of, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
