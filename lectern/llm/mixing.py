"""Problem 8: mixing sources to target weights, with soft membership.

The domains are the sources with a target, and one for all others. A naive Bayes classifier,
learned from labelled rows, predicts for every document how probable each domain is; a row's own
label weighs most of its membership. Distributed projected gradient steps then fit a rate of use
for each document, between 0 and the cap of its source, so that the expected tokens per domain
match the targets (least squares). The state of the descent is one vector of steps per round: a
document's rate is replayed from them, so nothing per document is kept between rounds and a lost
executor costs only its own tasks.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bags import WORD, U, WordHashes, as_batches
from lectern.session import spread, written

#: Rank file of a public byte-level tokenizer and the pattern that splits text before its merges.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
#: Share of membership that a labelled row leaves to the classifier.
SOFT = 0.05
ROUNDS = 20


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str | None], e) -> np.ndarray:
    """Tokens of each text by the encoder ``e``; 0 for null. Lone surrogates count as the
    replacement character."""
    return np.array([len(e.encode_ordinary(t)) if t else 0 for t in texts], np.int64)


def _features(texts: list[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word, first word of each text and the end)."""
    flat: list[int] = []
    n = np.empty(len(texts), np.int64)
    get = known.__getitem__
    for i, t in enumerate(texts):
        ws = WORD.findall(t.lower()) if t else []
        n[i] = len(ws)
        flat.extend(map(get, ws))
    return (np.array(flat, dtype=U) & U(BUCKETS - 1)).astype(np.int64), np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])


def fit_domains(docs: DataFrame, sizes: np.ndarray, per_source: int) -> np.ndarray:
    """(domains, BUCKETS + 1) log-probabilities of word buckets; the last column holds log-priors.

    docs: (key, label, text), the label a domain's number or -1. Counts come from about
    ``per_source`` labelled rows of each domain (all where it has fewer), chosen by a hash of the
    key and summed in the cluster; priors from all rows, whose numbers are ``sizes``.
    """
    width = len(sizes)
    share = F.element_at(F.array(*[F.lit(min(1.0, per_source / max(int(n), 1))) for n in sizes]), F.col("label") + 1)
    pick = F.pmod(F.xxhash64("key", "label"), F.lit(1_000_000)) < share * 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = WordHashes(), np.zeros((width, BUCKETS), np.int64)
        for batch in as_batches(batches):
            h, start = _features(batch.column(1).to_pylist(), known)
            own = batch.column(0).to_numpy().astype(np.int64)
            total += np.bincount(np.repeat(own, np.diff(start)) * BUCKETS + h, minlength=total.size).reshape(total.shape)
        s, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[s, b])], ["s", "b", "n"])

    rows = docs.where("label >= 0").where(pick).select("label", "text").mapInArrow(count, "s int, b int, n long").groupBy("s", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.ones((width, BUCKETS))
    counts[rows["s"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)] += rows["n"].to_numpy(np.float64)
    prior = sizes + 1.0
    return np.hstack([np.log(counts / counts.sum(1, keepdims=True)), np.log(prior / prior.sum())[:, None]])


def _posteriors(h: np.ndarray, start: np.ndarray, model: np.ndarray) -> np.ndarray:
    """(texts, sources) posteriors; the evidence counts by the square root of the length, since
    neighbouring words are not independent."""
    n = np.diff(start)
    score = np.zeros((len(n), len(model)))
    some = n > 0
    if some.any():
        score[some] = np.add.reduceat(model.T[h].astype(np.float32), start[:-1][some], axis=0) / np.sqrt(n[some])[:, None]
    score += model[:, BUCKETS]
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def memberships(docs: DataFrame, model: np.ndarray, tokenizer: str) -> DataFrame:
    """(id, source, label, tokens, p): tokens and domain membership of every document.

    The tokenizer's file is read on the driver's machine and sent to the workers."""
    kind, name = docs.schema["key"].dataType.simpleString(), os.path.basename(tokenizer)
    docs.sparkSession.sparkContext.addFile(tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, e = WordHashes(), encoder(SparkFiles.get(name))
        for batch in as_batches(batches, 1000):
            texts = batch.column(3).to_pylist()
            p = _posteriors(*_features(texts, known), model)
            label = batch.column(2).to_numpy().astype(np.int64)
            has = np.flatnonzero(label >= 0)
            p[has] *= SOFT
            p[has, label[has]] += 1 - SOFT
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(model)), pa.array(p.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(token_counts(texts, e)), lists], ["id", "source", "label", "tokens", "p"])

    return docs.select("key", "source", "label", "text").mapInArrow(rows, f"id {kind}, source string, label int, tokens long, p array<float>")


def _replayed(p: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The documents' rates after the steps, each projected onto 0 .. cap."""
    rate = np.minimum(1.0, caps)
    for g in steps:
        rate = np.clip(rate - p @ g, 0, caps)
    return rate


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def fit_rates(rows: DataFrame, caps: np.ndarray, goal: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The steps of the projected descent on the squared misses of the expected domain tokens.

    The gradient is preconditioned by the domains' tokens, which makes a step exact where
    memberships are pure and no cap binds.
    """
    width = len(goal)

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used, own = np.zeros(width), np.zeros(width)
            for batch in batches:
                p, t = _matrix(batch, "p", width), batch.column("tokens").to_numpy().astype(np.float64)
                cap = caps[batch.column("label").to_numpy()]
                used += (_replayed(p, cap, steps) * t) @ p
                own += ((cap > 0) * t) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(used), pa.array(own)], ["k", "used", "own"])

        got = rows.select("label", "tokens", "p").mapInArrow(add, "k long, used double, own double").groupBy("k").agg(F.sum("used").alias("used"), F.sum("own").alias("own")).toPandas().sort_values("k")
        out = np.zeros((2, width))
        out[:, got["k"].to_numpy(np.int64)] = got[["used", "own"]].to_numpy().T
        return out[0], out[1]

    steps: list[np.ndarray] = []
    best = np.inf
    for _ in range(rounds):
        used, own = totals(steps)
        miss = used - goal
        error = float((miss**2).sum())
        if error > best * 0.9999:
            break
        best = error
        steps.append(np.where(own > 0, miss / np.maximum(own, 1.0), 0.0))
    return steps


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, per_source: int = 400, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (key, source, tokens, rate, uses) per document, and the report per target.

    The size to reach is the tokens of all documents whose source is a target. uses is the rate,
    rounded up with the probability of its fraction by a hash of the key, and at most the
    source's ``max_repeats``. The report has source, target_share, max_repeats, n_docs, tokens,
    goal_tokens (target_share * size), fitted_tokens (tokens times rates), short (the fitted rates
    leave the source below its goal), can_reach (max_repeats * tokens >= goal_tokens),
    used_tokens, reached_share and miss (used_tokens / goal_tokens - 1). As no rate exceeds
    its cap, every source that can't reach its goal is short.

    Null texts have no tokens; documents of null or unlisted source are given memberships but
    never used; rows of equal key count each. Of targets with equal source the greatest counts;
    null shares and repeats are 0. Listed sources without documents are reported. Other columns
    are ignored. Empty tables give an empty table or a report of zeros. The targets are part of
    the job's configuration: they are read to the driver, the documents' sources are not.
    """
    listed = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").fillna(0).collect()
    names = [r.source for r in listed]
    share = np.array([*(float(r.share) if r.share == r.share else 0.0 for r in listed), 0.0])
    caps = np.array([*(int(r.cap) for r in listed), 0, 0], np.float64)  # the last is that of label -1
    place: Column = F.array_position(F.array(*map(F.lit, names)), F.col(source)) if names else F.lit(0)
    label = F.when(F.col(source).isNull(), -1).otherwise(F.when(place > 0, place - 1).otherwise(len(names))).cast("int")
    base = spread(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), label.alias("label"), F.col(text).alias("text")))
    sizes = np.zeros(len(share))
    for r in base.where("label >= 0").groupBy("label").count().collect():
        sizes[r["label"]] = r["count"]
    rows = written(memberships(base, fit_domains(base, sizes, per_source), tokenizer))
    per = rows.where((F.col("label") >= 0) & (F.col("label") < len(names))).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
    size = float(per.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    steps = fit_rates(rows, caps, share * size, rounds)
    kind, width = docs.schema[key].dataType.simpleString(), len(share)

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cap = caps[batch.column("label").to_numpy()]
            rate = _replayed(_matrix(batch, "p", width), cap, steps)
            chance = batch.column("chance").to_numpy()
            uses = np.minimum(np.floor(rate) + (chance < rate - np.floor(rate)), cap).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), batch.column("tokens"), pa.array(rate), pa.array(uses)], [key, "source", "tokens", "rate", "uses"])

    chance = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)).alias("chance")
    used = rows.select("id", "source", "label", "tokens", "p", chance).mapInArrow(use, f"`{key}` {kind}, source string, tokens long, rate double, uses long")
    goals = docs.sparkSession.createDataFrame([(s, float(x), int(c), float(x) * size) for s, x, c in zip(names, share, caps)], "source string, target_share double, max_repeats long, goal_tokens double")
    sums = used.where("rate > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("rate")).alias("fitted"), F.sum(F.col("tokens") * F.col("uses")).alias("used"))
    report = goals.join(per, "source", "left").join(sums, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "goal_tokens",
        F.coalesce("fitted", F.lit(0.0)).alias("fitted_tokens"), F.coalesce("used", F.lit(0)).alias("used_tokens"),
    )
    all_used = report.agg(F.sum("used_tokens")).scalar()
    return used, report.withColumns({
        "short": F.col("fitted_tokens") < F.col("goal_tokens"),
        "can_reach": F.col("max_repeats") * F.col("tokens") >= F.col("goal_tokens"),
        "reached_share": F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), all_used), F.lit(0.0)),
        "miss": F.try_divide(F.col("used_tokens"), F.col("goal_tokens")) - 1,
    })
