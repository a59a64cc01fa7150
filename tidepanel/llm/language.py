"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import small_batches

#: Hash buckets of the n-grams, and their lengths.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The log-probability matrix is broadcast; more languages than this make it too large and are refused.
MOST_LANGUAGES = 500
UNKNOWN = "und"
#: Characters worked on at once: arrays of this length stay in the cache.
_CHUNK = 250_000


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for anything else."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _grams(codes: np.ndarray, first: np.ndarray, buckets: int, orders) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the n-grams of joined texts: letters with the gap before or after, none across texts.

    ``codes`` has 0 for every non-letter; ``first`` marks a separator before each text.
    """
    c = codes.astype(np.uint64)
    for n in orders:
        h = c[: len(c) - n + 1].copy()
        any_letter = codes[: len(c) - n + 1] > 0
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + c[k: len(c) - n + 1 + k]
            any_letter = any_letter | (codes[k: len(c) - n + 1 + k] > 0)
        h += np.uint64(n)
        h *= np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(any_letter)
        yield at, (h[at] >> np.uint64(40)).astype(np.int64) % buckets


def _joined(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (letter codes, owner): texts of a batch behind one another, two gaps between; owner is the row, or -1
    where no gram of the chunk starts: in a piece of a long text, the gap before it and the overlap with the next piece."""
    group, size, over = [], 0, max(ORDERS) - 1

    def build(group):
        parts = [t for _, t, _, _ in group]
        codes = _letters()[np.frombuffer("\x00\x00".join(["", *parts, ""]).encode("utf-32-le"), np.uint32)]
        lengths = np.array([len(t) + 2 for t in parts])
        owner = np.repeat(np.array([i for i, *_ in group]), lengths)
        for (_, _, first, last), end, length in zip(group, np.cumsum(lengths), lengths):
            if not first:
                owner[end - length:end - length + 2] = -1
            if not last:
                owner[end - length + 2 + _CHUNK:end] = -1
        return codes, np.concatenate([owner, owner[-1:].repeat(2)])

    for i, t in enumerate(texts):
        for k in range(0, len(t or ""), _CHUNK):       # long texts in overlapping pieces: the same grams
            last = k + _CHUNK >= len(t)
            group.append((i, t[k:] if last else t[k:k + _CHUNK + over], k == 0, last))
            size += len(group[-1][1])
            if size >= _CHUNK:
                yield build(group)
                group, size = [], 0
    if group:
        yield build(group)


@dataclass
class Model:
    """Log probabilities of the buckets (one row each) by language, and of the languages themselves."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and its posterior probability; ``und`` and 0 without letters or without languages."""
        n = len(texts)
        total = np.zeros((n, len(self.languages)))
        seen = np.zeros(n, bool)
        for codes, owner in _joined(texts):
            has = np.flatnonzero((codes > 0) & (owner >= 0))
            seen[owner[has]] = True
            for at, bucket in _grams(codes, None, len(self.weights), self.orders):
                own = owner[at] >= 0
                at, bucket = at[own], bucket[own]
                if len(at):
                    o = owner[at]
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(o)) + 1])
                    np.add.at(total, o[starts], np.add.reduceat(self.weights[bucket], starts, axis=0))
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        total += self.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, seen)], np.where(seen, share, 0.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, orders=ORDERS, smoothing: float = 0.5) -> Model:
    """Count n-grams of all labelled rows; rows with a null text or language teach nothing.

    Every task adds its rows up to one count per language and bucket before the shuffle; the driver gets one array
    of ``buckets`` counts per language, for MOST_LANGUAGES languages at most.
    """
    small_batches(labelled.sparkSession)
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for name, part in b.groupby("lang"):
                acc = sums.setdefault(name, np.zeros(buckets, np.int64))
                docs[name] = docs.get(name, 0) + len(part)
                for codes, owner in _joined(list(part["text"])):
                    for at, bucket in _grams(codes, None, buckets, orders):
                        acc += np.bincount(bucket[owner[at] >= 0], minlength=buckets)
        for name, acc in sums.items():
            at = np.flatnonzero(acc)
            yield pd.DataFrame({"lang": name, "bucket": np.append(at, -1), "n": np.append(acc[at], docs[name])})

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    partial = rows.mapInPandas(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def dense(key, part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(buckets + 1, np.int64)           # the last place, bucket -1, holds the documents
        out[part["bucket"].to_numpy()] = part["n"].to_numpy()
        return pd.DataFrame({"lang": [key[0]], "counts": [out.tobytes()]})

    packed = partial.groupBy("lang").applyInPandas(dense, "lang string, counts binary").limit(MOST_LANGUAGES + 1).collect()
    packed.sort(key=lambda r: r["lang"])
    if len(packed) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would be too large to broadcast")
    languages = [r["lang"] for r in packed]
    every = np.array([np.frombuffer(r["counts"], np.int64) for r in packed], dtype=np.float64).reshape(len(packed), buckets + 1).T
    counts, docs = every[:-1], every[-1]
    weights = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * buckets)) if languages else counts
    return Model(languages, weights, np.log(docs / docs.sum()) if languages else docs, tuple(orders))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row; a text that is null or has no letter is ``und`` with score 0.

    All other columns pass through unchanged (columns named lang_pred or score are replaced).
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)     # MOST_LANGUAGES x buckets numbers at most

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        best, score = shared.value.score(list(texts))
        return pd.DataFrame({"lang_pred": best, "score": score})

    # a filter on the result would otherwise be moved before it, with a second evaluation
    out = df.withColumn("_lid", run.asNondeterministic()(F.col(text)))
    return out.withColumns({"lang_pred": F.col("_lid.lang_pred"), "score": F.col("_lid.score")}).drop("_lid")


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fifth, predict for all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
