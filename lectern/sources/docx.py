"""Word files as paragraphs, with the standard library only."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAS = "array<struct<idx:int,text:string,is_bold:boolean,has_image:boolean>>"


def paragraphs(content: bytes) -> list[dict]:
    """Non-empty paragraphs with hyperlink text; bold if all runs with text are, and whether they
    hold an image."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{W}p"):
        runs = [(r, "".join(t.text or "" for t in r.iter(f"{W}t"))) for r in p.iter(f"{W}r")]
        text = "".join(t for _, t in runs).strip()
        image = any(p.find(f".//{W}{tag}") is not None for tag in ("drawing", "pict"))
        if not text and not image:
            continue
        said = [r for r, t in runs if t.strip()]
        on = [b is not None and b.get(f"{W}val") not in ("0", "false") for b in (r.find(f"{W}rPr/{W}b") for r in said)]
        out.append({"idx": len(out), "text": text, "is_bold": bool(on) and all(on), "has_image": image})
    return out


def stem_of(name: str) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def word_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, stem) of the .docx and .doc files under a path, by their names alone; of files
    with one stem the .docx is taken."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(F.rlike(F.lower("path"), F.lit(r"\.docx?$")))
    names = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"))
    best = names.groupBy(stem_of("source_file").alias("stem")).agg(F.max_by("source_file", F.lower("source_file")).alias("source_file"))
    return best.select("source_file", "stem")


def read_docx(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """(source_file, paras, error) of the Word files under a path, or of those with these names
    (source_file); .doc files and broken ones have an error instead of paragraphs.

    The names are chosen first, from a scan without contents.
    """
    chosen = (word_files(spark, path) if names is None else names).select("source_file").distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), "content").join(chosen, "source_file", "left_semi")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for f, c in zip(pdf["source_file"], pdf["content"]):
                try:
                    if not f.lower().endswith(".docx"):
                        raise ValueError("legacy format")
                    rows.append((f, paragraphs(c), None))
                except Exception as e:  # one bad file must not stop the others
                    rows.append((f, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "paras", "error"])

    return files.mapInPandas(parse, f"source_file string, paras {PARAS}, error string")
