"""Plain text and Markdown files: one section each, the text as it is (SRC1, SRC2, SRC14, SRC18)."""

from __future__ import annotations

import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".epub": "epub", ".txt": "txt", ".md": "markdown", ".markdown": "markdown"}


def infer_format(path: str) -> str:
    """By suffix, without regard to case; a ZIP that holds a digest's database is an archive whatever it is called."""
    found = SUFFIXES.get(PurePosixPath(path).suffix.lower())
    if found:
        return found
    if zipfile.is_zipfile(path):
        names = zipfile.ZipFile(path).namelist()
        if "database.db" in names:
            return "archive"
        if "META-INF/container.xml" in names:
            return "epub"
    raise ValueError(f"unknown format: {path}")


def stem(path: str) -> str | None:
    return PurePosixPath(path).stem.strip() or None


def metadata(path: str, kind: str) -> dict:
    return {"version": 1, "sourceFormat": kind, "title": stem(path), "authors": [], "language": None, "identifier": None, "publisher": None, "publishedAt": None, "description": None}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, title and text of every file; a file is one row."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select("path", F.nullif(F.trim(F.url_decode(name)), F.lit("")).alias("title"), "text")


def sections(path: str, text: str) -> list[dict]:
    """The one section of a text."""
    return [{"id": "root", "title": None, "children": [], "text": text}]
