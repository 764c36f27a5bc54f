"""Keyword extraction and embedding seams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from lectern.functions.text import col

STOP = frozenset("a an and are as at be because been but by can could did do does for from had has have he her his how i if in into is it its me more my no not of on or our out she so some that the their them then there these they this those through to up us was we were what when which while who whose will with without would you your".split())
LEAST_WORDS = 20
#: Terms of a chunk, and of a scripture or video chunk. Fixed values.
MANY, FEW = 5, 3


def levenshtein_ratio(a: str, b: str) -> float:
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return 1 - prev[-1] / max(len(a), len(b), 1)


def keywords(text: str | None, n: int = 5, same: float = 0.7) -> list[str]:
    """The n most telling words and pairs of a text, by the published YAKE features: casing,
    position, frequency, relatedness to context and spread over sentences; lower is better.

    Texts of fewer than LEAST_WORDS words have none. Of terms that resemble each other by more
    than ``same`` the better stays.
    """
    if not text or len(text.split()) < LEAST_WORDS:
        return []
    sents = [re.findall(r"[^\W\d_][\w'’-]*", s) for s in re.split(r"(?<=[.!?])\s+|\n+", text)]
    sents = [s for s in sents if s]
    tf, upper, where = Counter(), Counter(), defaultdict(set)
    left, right = defaultdict(Counter), defaultdict(Counter)
    for i, s in enumerate(sents):
        low = [w.lower() for w in s]
        for j, w in enumerate(low):
            tf[w] += 1
            where[w].add(i)
            upper[w] += j > 0 and s[j][0].isupper()
            if j:
                left[w][low[j - 1]] += 1
                right[low[j - 1]][w] += 1
    words = [w for w in tf if w not in STOP and len(w) > 2]
    if not words:
        return []
    freq = [tf[w] for w in words]
    mean = sum(freq) / len(freq)
    std = math.sqrt(sum((f - mean) ** 2 for f in freq) / len(freq))
    most = max(tf.values())
    score = {}
    for w in words:
        case = upper[w] / (1 + math.log(tf[w]))
        middle = sorted(where[w])[len(where[w]) // 2]
        position = math.log(math.log(3 + middle))
        related = 1 + (len(left[w]) / max(sum(left[w].values()), 1) + len(right[w]) / max(sum(right[w].values()), 1)) * tf[w] / most
        spread = len(where[w]) / len(sents)
        score[w] = related * position / (case + tf[w] / (mean + std) / related + spread / related)
    terms = {w: score[w] / (tf[w] * (1 + score[w])) for w in words}
    pairs = Counter((a.lower(), b.lower()) for s in sents for a, b in zip(s, s[1:]) if a.lower() in score and b.lower() in score)
    for (a, b), f in pairs.items():
        terms[f"{a} {b}"] = score[a] * score[b] / (f * (1 + score[a] + score[b]))
    out: list[str] = []
    for t in sorted(terms, key=lambda t: (terms[t], t)):
        if all(levenshtein_ratio(t, o) <= same for o in out):
            out.append(t)
            if len(out) == n:
                break
    return out


def topics(c: Column | str, n: Column | int = MANY) -> Column:
    """The ``n`` most telling terms of each text."""

    @F.pandas_udf(ArrayType(StringType()))
    def extract(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, most in parts:
            yield pd.Series([keywords(t, int(m)) for t, m in zip(texts, most)], dtype=object)

    return extract(col(c), F.lit(n) if isinstance(n, int) else n)


def hash_embedding(text: str | None, dim: int = 64) -> list[float]:
    """A unit vector of signed word hashes: the embedder where no model is at hand."""
    v = [0.0] * dim
    for w in re.findall(r"\w+", (text or "").lower()):
        h = xxhash.xxh3_64_intdigest(w)
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embed(c: Column | str, load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, prefix: str = "") -> Column:
    """Unit embeddings of a text column; ``load`` makes the model, once per worker. ``prefix`` goes
    before every text, as models want that tell questions from passages."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else lambda ts: [hash_embedding(t) for t in ts]
        for s in parts:
            v = np.array(model([prefix + t for t in s.fillna("")]), dtype=float).reshape(len(s), -1)
            yield pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    return run(col(c))
