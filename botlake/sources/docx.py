"""Text of uploaded DOCX files."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_BYTES, MOST_CHARS = 50 << 20, 5_000_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(content: bytes) -> str:
    """Paragraphs, and rows with tab-joined cells, in document order; the paragraphs of a cell follow their row again."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError("too large when unpacked")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in root.iter():
        if e.tag == f"{_W}tr":
            out.append("\t".join(text(c) for c in e.iter(f"{_W}tc")))
        elif e.tag == f"{_W}p":
            out.append(text(e))
    return "\n".join(x for x in out if x.strip())[:MOST_CHARS]


def docx_text(files: DataFrame) -> DataFrame:
    """(path, title, text, error) of files (path, content), as spark.read.format("binaryFile") gives them; a file that isn't a readable DOCX has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                title, kind = os.path.splitext(os.path.basename(path))
                try:
                    if kind.lower() != ".docx":
                        raise ValueError(f"unsupported file type {kind or '(none)'}")
                    rows.append((path, title, docx_lines(content), None))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, title, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 4, names=["path", "title", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, title string, text string, error string")
