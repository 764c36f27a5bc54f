"""Problem 6: mapping freely typed references to a canonical list of books.

The list, with its short forms and aliases, becomes a trie. A typed name is searched in it with a
Levenshtein automaton: the states of the automaton for one name are the rows of the edit-distance
table, and a branch of the trie is left as soon as a row has no entry within the limit. Swapped
neighbours count as one edit. The limit depends on the length of the name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bags import as_batches
from lectern.llm.common import one_per_key

#: Other usual names of entries: alias, canonical name. Fixed values.
ALIASES = [
    ("Song of Songs", "Song of Solomon"),
    ("Solomon's Song", "Song of Solomon"),
    ("Canticles", "Song of Solomon"),
    ("Canticle of Canticles", "Song of Solomon"),
    ("Qoheleth", "Ecclesiastes"),
    ("Lamentations of Jeremiah", "Lamentations"),
    ("Psalm", "Psalms"),
    ("Psa", "Psalms"),
    ("Phil", "Philippians"),
    ("Acts of the Apostles", "Acts"),
    ("Revelations", "Revelation"),
    ("Apocalypse", "Revelation"),
    ("Revelation of John", "Revelation"),
    ("Revelation to John", "Revelation"),
]
#: Words that may stand before a name.
LEAD = re.compile(r"^(?:(?:see|cf|compare|the|books?|gospel|epistle|letter|according|of|to|st|saint)\b[\s.:]*)+")
#: Chapter and verses at the end of a lower-cased reference.
TAIL = re.compile(r"[\s.,(\-]*(?:(?<![^\W\d_])ch(?:ap(?:ter)?)?[.\s]*)?\(?\s*(\d+)[\d\s:.,;\-–()vf&]*$")
NUMERAL = re.compile(r"^(?:([123])(?:st|nd|rd)?|([il1]{1,3})(?=[\s.\-])|(first|second|third)\b)[\s.\-]*(?=[^\W\d_])")
ORDINAL = {"first": "1", "second": "2", "third": "3"}
#: Digits that are read for letters inside a word. Fixed values.
LOOKALIKE = str.maketrans("01", "ol")
SLICE = 50_000


def limit(length: int) -> int:
    """Edits allowed for an entry of so many letters."""
    return 0 if length < 4 else 1 if length < 8 else 2


def parts(value: str) -> tuple[str, str, int | None]:
    """(numeral or '', letters of the name, chapter or None) of a typed reference."""
    s = value.lower().strip()
    tail = TAIL.search(s)
    chapter = int(tail[1][:9]) if tail else None
    s = LEAD.sub("", s[: tail.start()] if tail else s)
    number = ""
    if m := NUMERAL.match(s):
        number = m[1] or (str(len(m[2])) if m[2] else ORDINAL[m[3]])
        s = LEAD.sub("", s[m.end() :])
    return number, "".join(c for c in s.translate(LOOKALIKE) if c.isalpha()), chapter


@dataclass
class Node:
    below: dict[str, Node] = field(default_factory=dict)
    #: (entry, whether its full name ends here)
    ends: list[tuple[int, bool]] = field(default_factory=list)
    #: entries whose full name passes through here
    through: set[int] = field(default_factory=set)


class Trie:
    """Names by numeral and letters; ``names`` are (entry, name, full) with full for canonical ones."""

    def __init__(self, names: list[tuple[int, str, bool]]) -> None:
        self.roots: dict[str, Node] = {}
        self.longest = 0
        for entry, name, full in names:
            number, letters, _ = parts(name)
            self.longest = max(self.longest, len(letters))
            node = self.roots.setdefault(number, Node())
            for c in letters:
                node = node.below.setdefault(c, Node())
                if full:
                    node.through.add(entry)
            if (entry, full) not in node.ends:
                node.ends.append((entry, full))

    def within(self, number: str, name: str) -> dict[int, int]:
        """Entries with a name, short form or alias within the limit of its length, and their distance."""
        return {entry: d for entry, (d, _) in self.ranked(number, name).items()}

    def ranked(self, number: str, name: str) -> dict[int, tuple[int, bool]]:
        """Of every entry within the limit the distance and whether only a short form or alias has it."""
        root, found = self.roots.get(number), {}
        if not root or not name or len(name) > self.longest + 2:
            return {}
        most = limit(len(name) + 2)
        stack = [(root, 0, "", list(range(len(name) + 1)), None)]
        while stack:
            node, depth, last, row, before = stack.pop()
            d = row[-1]
            for entry, full in node.ends:
                if d <= limit(depth):
                    found[entry] = min((d, not full), found.get(entry, (d, True)))
            for c, child in node.below.items():
                new = [row[0] + 1]
                for j, x in enumerate(name):
                    cost = min(row[j + 1] + 1, new[j] + 1, row[j] + (x != c))
                    if before is not None and j and x == last and name[j - 1] == c:
                        cost = min(cost, before[j - 1] + 1)
                    new.append(cost)
                if min(new) <= most or min(row) < most:
                    stack.append((child, depth + 1, c, new, row))
        return found

    def beginning(self, number: str, name: str) -> set[int]:
        """Entries whose full name begins with ``name``."""
        node = self.roots.get(number)
        for c in name:
            node = node and node.below.get(c)
        return node.through if node else set()


def choose(trie: Trie, value: str, chapters: dict[int, int]) -> tuple[int, int]:
    """(entry, edits) of a typed reference, (0, -1) if it names none.

    Exact names come first, then an unambiguous beginning of four letters or more, then the
    nearest within the limit. Of entries that tie those tied by their full name come first, and are
    told apart by having the chapter; if that leaves several, the value names none.
    """
    number, name, chapter = parts(value)
    near = trie.ranked(number, name)
    best = min((d for d, _ in near.values()), default=-1)
    if best != 0 and len(name) >= 4 and len(only := trie.beginning(number, name)) == 1:
        return next(iter(only)), 0
    if best != 0 and name.endswith("ch"):  # "Amosch. 2": the mark of a chapter without a space
        other = trie.ranked(number, name[:-2])
        if other and (best < 0 or min(other.values())[0] < best):
            near, best = other, min(other.values())[0]
    ties = [e for e, (d, _) in near.items() if d == best]
    ties = [e for e in ties if not near[e][1]] or ties
    if len(ties) > 1 and chapter is not None:
        ties = [e for e in ties if chapter <= chapters.get(e, chapter)] or ties
    return (ties[0], best) if len(ties) == 1 else (0, -1)


def match_references(records: DataFrame, books: DataFrame, key: str = "chunk_id", refs: str = "scripture_refs", aliases: list[tuple[str, str]] = ALIASES) -> DataFrame:
    """(key, ref_pos, value, exact, book_id, edits): every non-null element of ``refs``.

    ref_pos counts from 0 with nulls; exact tells that the value is a book name, a space and
    chapter, chapter:verse or chapter:verse-verse in digits; book_id is 0 and edits -1 where the
    value names no book. Records without key are left out; rows of equal key count once; null and
    empty arrays give no row; empty and very long values name no book unless they hold a name.
    Other columns are ignored. ``books`` has book_id, book_name, short_form and n_chapters, each
    but the first nullable; it may be of any length: beyond SLICE entries the values are held
    against one slice after the other and the nearest is taken.

    The values never move: they are matched where the records are, each worker remembering the
    values it has seen, so a value that fills a third of the rows is matched once a worker.
    """
    rows = books.where(F.col("book_id").isNotNull() & F.col("book_name").isNotNull()).select("book_id", "book_name", "short_form", "n_chapters").orderBy("book_id")
    tries: list[tuple[Trie, dict[int, int], set[str]]] = []
    part: list = []

    def close() -> None:
        names = [(r[0], n, full) for r in part for n, full in ((r[1], True), (r[2], False)) if n]
        by_name = {r[1]: r[0] for r in part}
        names += [(by_name[n], a, False) for a, n in aliases if n in by_name]
        tries.append((Trie(names), {r[0]: r[3] for r in part if r[3] is not None}, set(by_name)))
        part.clear()

    for r in rows.toLocalIterator():
        part.append(tuple(r))
        if len(part) == SLICE:
            close()
    if part or not tries:
        close()

    src = records.select(F.col(key).alias("_k"), F.col(refs).alias("_r"))
    one = one_per_key(src, "_k", ["_r"]).select("_k", F.posexplode("_r").alias("pos", "value")).where("value is not null")
    kind = one.schema["_k"].dataType.simpleString()
    plain = re.compile(r"(.*) \d+(?::\d+(?:-\d+)?)?", re.ASCII | re.DOTALL)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        names: dict[tuple, tuple[int, int]] = {}
        for batch in as_batches(batches, 10_000):
            out = []
            for v in batch.column(2).to_pylist():
                got = known.get(v)
                if got is None:
                    if len(known) > 200_000:
                        known.clear()
                        names.clear()
                    m = plain.fullmatch(v)
                    exact = bool(m) and any(m[1] in t[2] for t in tries)
                    p = parts(v)
                    if (best := names.get(p)) is None:
                        found = [x for x in (choose(t, v, c) for t, c, _ in tries) if x[0]]
                        least = min((d for _, d in found), default=-1)
                        same = {e for e, d in found if d == least}
                        best = names[p] = (same.pop(), least) if len(same) == 1 else (0, -1)
                    got = known[v] = (exact, *best)
                out.append(got)
            exact, ids, edits = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2), pa.array(exact, pa.bool_()), pa.array(ids, pa.int64()), pa.array(edits, pa.int32())], [key, "ref_pos", "value", "exact", "book_id", "edits"])

    return one.mapInArrow(match, f"`{key}` {kind}, ref_pos long, value string, exact boolean, book_id long, edits int")
