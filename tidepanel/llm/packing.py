"""Packing token pieces into sequences by bin completion over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import random_key, small_batches, spread_rank, stored
from tidepanel.llm.tokens import encoder

CAPACITY = 2048
#: Fillings looked at before the search for one bin settles for the best so far.
SEARCH = 4_000

PIECES = "_row bigint, doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenise(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document: its ids, then ``end_id``.

    Only longer documents are cut, from the end backwards, so their first piece takes what is left over.  A null
    or empty text is the end id alone; repeated rows are documents of their own (``_row`` tells them apart).  With
    ``with_ids`` the ids come along as little-endian 32-bit integers.
    """
    small_batches(docs.sparkSession)
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = [t if t is not None else "" for t in b["text"]]
            rows = []
            for row, doc, ids in zip(b["_row"], b["doc_id"], enc.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    raw = ids[i:j].tobytes()
                    rows.append((row, doc, k, i, j - i, zlib.crc32(raw), *([raw] if with_ids else [])))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield out

    # ids travel as text: pandas would turn a column with nulls into floating point
    out = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


class Completion:
    """Best filling of a bin around its largest item, from what the histogram still holds.

    Depth-first branch and bound over the sizes in falling order, each with as many copies as fit, then fewer.  The
    first filling reached is the one of best-fit decreasing and the first incumbent.  A branch is left when all
    that is no larger could not bring the waste under the incumbent's.  Once only one more item can fit, the largest
    that fits dominates every other and is the only one tried.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.refresh()

    def refresh(self) -> None:
        self.sizes = np.flatnonzero(self.left)
        self.sums = np.cumsum(self.sizes * self.left[self.sizes])

    def best(self, room: int) -> list[int]:
        sizes, left, sums = self.sizes, self.left, self.sums
        smallest = int(sizes[0])
        best: list[tuple[int, int]] = []
        waste, looks = room, SEARCH
        taken: list[tuple[int, int]] = []

        def branch(room: int, top: int) -> None:
            nonlocal best, waste, looks
            if room < waste:
                best, waste = list(taken), room
            i = min(top, int(np.searchsorted(sizes, room, side="right")) - 1)
            while i >= 0 and waste and looks > 0:
                if room - sums[i] >= waste:
                    return
                size = int(sizes[i])
                for k in range(min(int(left[size]), room // size), 0, -1):
                    looks -= 1
                    taken.append((size, k))
                    branch(room - k * size, i - 1)
                    taken.pop()
                    if not waste or looks <= 0:
                        return
                if left[size] and room < 2 * smallest:
                    return
                i -= 1

        branch(room, len(sizes) - 1)
        return [s for s, k in best for _ in range(k)]


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, sizes): bins of equal contents that together hold ``counts[size]`` items of every size.

    The largest size left opens a bin, bin completion fills it, and the same filling is repeated as often as the
    histogram allows; so the work follows the number of sizes, never the number of items.
    """
    bins: list[tuple[int, list[int]]] = []
    work = Completion(counts)
    while len(work.sizes):
        top = int(work.sizes[-1])
        work.left[top] -= 1
        rest = work.best(capacity - top)
        work.left[top] += 1
        content = [top, *rest]
        need = np.bincount(content, minlength=len(counts))
        used = np.flatnonzero(need)
        times = int((work.left[used] // need[used]).min())
        work.left[used] -= times * need[used]
        work.refresh()
        bins.append((times, content))
    return bins


def best_fit_decreasing(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Number of bins of best-fit decreasing on the same histogram, for comparison."""
    bins = 0
    left = counts.copy()
    while left.any():
        room, content = capacity, np.zeros_like(left)
        while True:
            fit = np.flatnonzero(left[: room + 1] - content[: room + 1] > 0)
            if not len(fit):
                break
            content[fit[-1]] += 1
            room -= int(fit[-1])
        used = np.flatnonzero(content)
        times = int((left[used] // content[used]).min())
        left[used] -= times * content[used]
        bins += times
    return bins


def places(bins: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """For every size, the runs of item ranks that go to one pattern: first rank, first bin, items per bin, offset."""
    rows, ranks, base = [], {}, 0
    for times, content in bins:
        offset = 0
        for size in dict.fromkeys(content):
            per_bin = content.count(size)
            first = ranks.get(size, 0)
            rows.append((size, first, times * per_bin, base, per_bin, offset))
            ranks[size] = first + times * per_bin
            offset += per_bin * size
        base += times
    return pd.DataFrame(rows, columns=["size", "first", "n", "base", "per_bin", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 13) -> DataFrame:
    """Add sequence_id and offset to pieces (column ``length``, 1 to ``capacity``; ``_row`` and ``piece`` tell them apart).

    Only the histogram of lengths, ``capacity`` counts, reaches the driver; the solved patterns go back as one row
    per size and pattern, and every piece finds its bin from its rank among the pieces of its size.  Ranks are
    taken in slices, so a length that a third of all pieces share stays split.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    rows = places(pack_histogram(counts, capacity))
    runs = {int(s): g.sort_values("first") for s, g in rows.groupby("size")}
    table = spark.createDataFrame([(s, *(g[c].tolist() for c in ("first", "base", "per_bin", "offset"))) for s, g in runs.items()] or [],
                                  "_size int, _first array<bigint>, _base array<bigint>, _per array<int>, _off array<int>")
    keyed = pieces.withColumn("_key", random_key(seed, F.col("_row"), F.col("piece")))
    ranked = spread_rank(keyed, ["length"], "_key", ["_row", "piece"], int(counts.sum()), rank="_rank")
    # _size has at most `capacity` rows and the arrays as many runs as there are patterns
    joined = ranked.join(F.broadcast(table), F.col("length") == F.col("_size"))
    at = joined.withColumn("_i", F.expr("size(filter(_first, x -> x <= _rank)) - 1")).withColumn("_k", F.expr("_rank - _first[_i]"))
    return (at.withColumn("sequence_id", F.expr("_base[_i] + _k div _per[_i]"))
              .withColumn("offset", F.expr("cast(_off[_i] + (_k % _per[_i]) * length as bigint)"))
              .select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Tokenise and pack documents; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenise(docs, capacity, tokenizer), capacity).drop("_row")
