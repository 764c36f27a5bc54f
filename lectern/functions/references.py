"""References such as "1 John 3:16" in metadata and in questions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col
from lectern.functions.vocabulary import BOOK_ABBREVIATIONS, BOOKS

META = r"^\s*([1-3]?\s*[A-Za-z][A-Za-z\s]*?)\s+(\d+):(\d+)(?:-(\d+))?"
_names = sorted([*BOOKS, *BOOK_ABBREVIATIONS], key=lambda n: (-len(n), n))
IN_TEXT = rf"(?i)\b({'|'.join(map(re.escape, _names)).replace(chr(92) + ' ', ' ')})\.?\s+(\d+)(?::(\d+))?(?:-(\d+))?\b"


def canonical_book(name: Column) -> Column:
    """The canonical name of a lower-cased book or abbreviation; null for anything else."""
    table = F.create_map(*[F.lit(x) for k, v in {**BOOK_ABBREVIATIONS, **{b: b for b in BOOKS}}.items() for x in (k, v)])
    return F.try_element_at(table, name)


def parse_reference(c: Column | str) -> Column:
    """(book, chapter, verse_start, verse_end) of a metadata reference; null where it has no verse
    or no known book."""
    part = lambda i: F.regexp_extract(F.trim(col(c)), META, i)
    book = canonical_book(F.regexp_replace(F.lower(F.trim(part(1))), r"\s+", " "))
    start = part(3).try_cast("int")
    end = F.coalesce(part(4).try_cast("int"), start)
    return F.when(book.isNotNull() & start.isNotNull(), F.struct(book.alias("book"), part(2).try_cast("int").alias("chapter"), start.alias("verse_start"), end.alias("verse_end")))


def references_in(c: Column | str) -> Column:
    """Distinct (book, chapter, verse or null) in a question, in order of appearance."""
    groups = [F.regexp_extract_all(col(c), F.lit(IN_TEXT), F.lit(i)) for i in (1, 2, 3)]
    rows = F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "bcv")]), lambda r: F.struct(canonical_book(F.regexp_replace(F.lower(r["b"]), r"\s+", " ")).alias("book"), r["c"].try_cast("int").alias("chapter"), r["v"].try_cast("int").alias("verse")))
    return F.array_distinct(F.filter(rows, lambda r: r["book"].isNotNull()))
