"""Quality of texts by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import small_batches, stored
from tidepanel.llm.language import held_out

#: Distinct labelled texts that vote, at most about so many: a hash of the text chooses them if there are more.
MOST_VOTERS = 10_000
#: Length of the latent vectors, passes over the voters' terms that find them, neighbours that vote, and the power of
#: the similarity that weighs a vote.
DIMENSIONS, PASSES, NEIGHBOURS, POWER = 64, 6, 15, 8
#: Similarities this near to the last neighbour's are ties and vote too.
TIE = 1e-9
#: Terms: hashed code-point n-grams, triples of character classes, and three about repeated words.
BUCKETS, ORDERS = 1024, (1, 2, 3)
_CLASSES = 7
TERMS = BUCKETS + _CLASSES ** 3 + 3
#: Code points of one text worked on at once; texts and voters per block of products.
_CHUNK, _BLOCK, _VOTER_BLOCK = 250_000, 128, 4_096


@functools.cache
def _kinds() -> np.ndarray:
    """Class of each code point: space, other white space, lower case, upper case, digit, plain punctuation, other."""
    kind = {"Ll": 2, "Lu": 3, "Lo": 2, "Lm": 2, "Lt": 3, "Nd": 4, "Zs": 0}
    out = np.fromiter((kind.get(unicodedata.category(chr(c)), 6) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[[9, 10, 11, 12, 13]] = 1
    out[[ord(c) for c in ".,;:'\"-?()"]] = 5
    return out


def _words(text: str) -> tuple[int, int, int]:
    """How many words repeat the one before, how many occurred before at all, and how many are new; whole text, in parts."""
    seen: set[str] = set()
    again, n, last, at = 0, 0, None, 0
    while at < len(text):
        stop = min(len(text), at + _CHUNK)
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        words = text[at:stop].lower().split()
        if words:
            again += sum(map(str.__eq__, words, [last or "", *words[:-1]]))
            seen.update(words)
            n, last = n + len(words), words[-1]
        at = stop
    return again, n - len(seen), len(seen)


def term_counts(text: str | None) -> np.ndarray:
    """Counts of all terms of a whole text; zeros for null and empty ones."""
    out = np.zeros(TERMS)
    if not text:
        return out
    over = max(max(ORDERS), 3) - 1
    for k in range(0, len(text), _CHUNK):                # parts overlap, so that their n-grams are those of the text
        part = text[max(0, k - over):k + _CHUNK]
        codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        fresh = len(part) - (min(k + _CHUNK, len(text)) - k)
        wide = codes.astype(np.uint64)
        for n in ORDERS:
            first = max(0, fresh - n + 1)                # n-grams that end in this part only
            m = len(wide) - n + 1
            if m <= first:
                continue
            h = wide[first:m]
            for j in range(1, n):
                h = h * np.uint64(0x100000001B3) + wide[first + j:m + j]
            h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out[:BUCKETS] += np.bincount((h >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
        kind = _kinds()[codes].astype(np.int64)
        first = max(0, fresh - 2)
        if len(kind) - 2 > first:
            triple = (kind[first:-2] * _CLASSES + kind[first + 1:-1]) * _CLASSES + kind[first + 2:]
            out[BUCKETS:-3] += np.bincount(triple, minlength=_CLASSES ** 3)
    out[-3:] = _words(text)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Square roots of the counts, n-grams by rarity; the three kinds of terms weigh the same."""
    x = np.sqrt(counts) * rarity
    return np.concatenate([_unit(x[:, :BUCKETS]), _unit(x[:, BUCKETS:-3]), _unit(x[:, -3:])], axis=1)


@dataclass
class Model:
    """The latent space and its labelled vectors: TERMS x DIMENSIONS and voters x DIMENSIONS numbers at most."""

    rarity: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    base: float

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        counts = np.stack([term_counts(t) for t in texts]) if texts else np.zeros((0, TERMS))
        return _unit(_weighted(counts, self.rarity) @ self.axes)

    def vote(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest voters, weighted by similarity; the base share where none is similar."""
        out = np.full(len(vectors), self.base)
        k = min(neighbours, len(self.voters))
        if k == 0:
            return out
        for i in range(0, len(vectors), _BLOCK):
            block = vectors[i:i + _BLOCK]
            near = np.concatenate([block @ self.voters[j:j + _VOTER_BLOCK].T for j in range(0, len(self.voters), _VOTER_BLOCK)], axis=1)
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            row, voter = np.nonzero(near >= last[:, None] - TIE)
            weight = np.maximum(near[row, voter], 0) ** POWER
            total = np.bincount(row, weight, len(block))
            good = np.bincount(row, weight * self.labels[voter], len(block))
            some = total > 1e-12
            out[i:i + _BLOCK][some] = good[some] / total[some]
        return np.clip(np.round(out, 9), 0, 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = [self.vote(self.vectors(texts[i:i + _BLOCK])) for i in range(0, len(texts), _BLOCK)]
        return np.concatenate(out) if out else np.zeros(0)


def choose_voters(docs: DataFrame, marks: DataFrame, most: int = MOST_VOTERS) -> DataFrame:
    """(text, label): distinct non-empty texts with their mean label, about ``most`` of them if there are more.

    ``docs`` has doc_id and text, ``marks`` doc_id and label; null labels teach nothing, a document marked twice teaches
    twice.  Copies of a text are one voter, and the choice hangs on a hash of the text, so it is the same in every run
    and layout.  Texts stay where they are until the choice is made: only hashes are shuffled.
    """
    keyed = docs.where("text <> ''").select("doc_id", "text", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("check"))
    known = marks.where("label is not null").select(F.col("doc_id").alias("_id"), F.col("label").cast("double").alias("label"))
    met = keyed.select("doc_id", "key", "check").join(known, F.col("doc_id") == F.col("_id"))
    distinct = stored(met.groupBy("key", "check").agg(F.avg("label").alias("label"), F.min("doc_id").alias("first")), "labelled")
    n = distinct.count()
    if n > most:
        distinct = distinct.where(F.shiftrightunsigned(F.xxhash64(F.lit(2), "key", "check"), 32) < int(most / n * (1 << 32)))
    chosen = distinct.select(F.col("key").alias("_key"), F.col("check").alias("_check"), "first", "label")
    texts = keyed.join(F.broadcast(chosen), (F.col("key") == F.col("_key")) & (F.col("check") == F.col("_check")) & (F.col("doc_id") == F.col("first")))
    return stored(texts.dropDuplicates(["key", "check"]).select("text", "label").repartition(8), "voters")     # about `most` rows


def train(docs: DataFrame, marks: DataFrame, most: int = MOST_VOTERS, dimensions: int = DIMENSIONS) -> Model:
    """Fit the latent space and the voters on a bounded sample of the documents that ``marks`` labels.

    The space is the leading eigenvectors of the voters' weighted terms, found by subspace iteration: each pass adds up
    one TERMS x (``dimensions`` + 16) matrix per task.  Without labelled rows every score is 0.5.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [term_counts(t).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column("label")], names=["terms", "label"])

    terms = stored(choose_voters(docs, marks, most).mapInArrow(count, "terms binary, label double"), "terms")

    def matrix(b: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(b["terms"]), np.float32).reshape(-1, TERMS).astype(np.float64)

    def summed(partial) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum((partial(matrix(b)) for b in batches if len(b)), np.zeros(1))
            yield pd.DataFrame({"sum": [np.ascontiguousarray(total).tobytes()]})

        parts = [np.frombuffer(r["sum"]) for r in terms.mapInPandas(run, "sum binary").collect()]      # one per task of at most `most` rows
        return sum((p for p in parts if len(p) > 1), np.zeros(1))

    facts = terms.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("base")).first()
    if not facts["n"]:
        return Model(np.ones(TERMS), np.zeros((TERMS, dimensions)), np.zeros((0, dimensions)), np.zeros(0), 0.5)
    seen = summed(lambda x: (x > 0).sum(axis=0).astype(np.float64))
    rarity = np.ones(TERMS)
    rarity[:BUCKETS] = np.log((1 + facts["n"]) / (1 + seen[:BUCKETS])) + 0.05      # a term of all texts still counts a little
    axes = np.linalg.qr(np.random.default_rng(12).normal(size=(TERMS, min(dimensions + 16, TERMS))))[0]      # 16 spare axes, for convergence
    for last in [False] * PASSES + [True]:
        turned = summed(lambda x, axes=axes: _weighted(x, rarity).T @ (_weighted(x, rarity) @ axes)).reshape(axes.shape)
        if last:                                         # the leading eigenvectors within the subspace
            value, mix = np.linalg.eigh(axes.T @ turned)
            axes = axes @ mix[:, ::-1][:, :dimensions]
        else:
            axes = np.linalg.qr(turned)[0]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vector": [v.tobytes() for v in _unit(_weighted(matrix(b), rarity) @ axes)], "label": b["label"].to_numpy()})

    placed = terms.mapInPandas(place, "vector binary, label double").orderBy("vector").toArrow()            # about `most` rows
    vectors = np.frombuffer(b"".join(placed.column("vector").to_pylist())).reshape(-1, axes.shape[1])
    return Model(rarity, axes, vectors, placed.column("label").to_numpy(), facts["base"])


def predict(df: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= ``least``) to every row.

    Every text is compared with every voter, in blocks.  A null or empty text has no neighbours and gets the share of
    label 1 among the voters.  Other columns pass through (columns named score or predicted are replaced).
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)     # about MOST_VOTERS x DIMENSIONS and TERMS x DIMENSIONS numbers

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    out = df.withColumn("score", run.asNondeterministic()(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_VOTERS) -> DataFrame:
    """Learn quality from labelled documents outside the held-out fifth, score all: doc_id, held_out, score, predicted."""
    held = held_out(F.col("doc_id"))
    model = train(docs.where(~held), labels.select("doc_id", F.col("quality").alias("label")), most)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
