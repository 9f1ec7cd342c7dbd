"""Files to documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseworks.functions import text as t

MAX_CHARS = 2_000_000
MAX_PAGES = 50
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def txt(data: bytes) -> str:
    """UTF-8; bytes that are not are dropped."""
    return data.decode("utf-8", "ignore")


def docx(data: bytes) -> str:
    """Body paragraphs that have text, one a line; empty if the file cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        made = []
        for p in body.findall(f"{_W}p"):
            parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
            made.append("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))
        return "\n".join(x for x in made if x)
    except Exception:  # any damage makes the file unreadable, as for every kind of file
        return ""


def pdf(data: bytes, pages: int | None = None) -> str:
    """Text of all pages where a reader is installed; empty if not, or if the file cannot be read."""
    try:
        from pypdf import PdfReader

        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages[:pages])
    except Exception:
        return ""


def extract(name: str, data: bytes) -> str:
    """By the name's suffix; whatever is neither PDF nor DOCX is text."""
    low = name.lower()
    return (pdf(data) if low.endswith(".pdf") else docx(data) if low.endswith(".docx") else txt(data)).strip()


def extract_strict(name: str, data: bytes) -> str:
    """Known suffixes only, cleaned and capped, PDFs to their first pages."""
    low = name.lower()
    if low.endswith(".txt"):
        raw = txt(data)
    elif low.endswith(".docx"):
        raw = docx(data)
    elif low.endswith(".pdf"):
        raw = pdf(data, MAX_PAGES)
    else:
        raise ValueError("unsupported file type: use .txt, .docx or .pdf")
    spaced = re.sub(r"[ \t]+", " ", raw.replace("\0", " "))
    return re.sub(r"\n{3,}", "\n\n", spaced).strip()[:MAX_CHARS]


def scan(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``(doc_id, name, n_bytes, text, readable)`` of all files below ``path``; ids follow the order of paths.

    Decoding is the one step outside the JVM: files go to Python by Arrow batches, a few at a time.
    """
    read = extract_strict if strict else extract

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = b["path"].str.rsplit("/", n=1).str[-1]
            yield pd.DataFrame({"path": b["path"], "name": names, "n_bytes": b["length"], "text": [read(n, d) for n, d in zip(names, b["content"], strict=True)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    decoded = files.mapInPandas(decode, "path string, name string, n_bytes bigint, text string")
    # ids from the listing alone (paths, no content): a range-partitioned sort and one count per partition
    ids = spark.createDataFrame(files.select("path").sort("path").rdd.map(lambda r: r[0]).zipWithIndex(), "path string, doc_id bigint")
    docs = decoded.join(ids, "path").withColumn("text", t.normalize_ws(F.col("text")) if not strict else F.col("text"))
    return docs.select("doc_id", "name", "n_bytes", "text", (F.length("text") > 0).alias("readable"))
