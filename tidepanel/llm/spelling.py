"""Spelling variants by permuterm rotations: sort the rotations of all words, scan prefix ranges, vote for a form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import small_batches, stored

#: Ends a word inside its rotations; sorts before every letter and is part of no word.
TERMINATOR = "\x01"
#: Prefixes longer than this many code points are named by a digest, so that a word of length L costs L rows of fixed
#: size and not L * L characters.
LONGEST_PREFIX = 64
#: Code points of a text worked on at once, distinct words a task holds before it hands them on, rows per batch.
_CHUNK, _HOLD, _ROWS = 1_000_000, 300_000, 50_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_NO_RUN = re.compile("[^A-Za-zÀ-ÿ]")


def _chunks(text: str, size: int = _CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` code points that never cut a run of letters."""
    at = 0
    while len(text) - at > size:
        cut = _NO_RUN.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def run_counts(docs: DataFrame, least_length: int = 6, drop_one_in: int | None = None) -> DataFrame:
    """(word, n): how often each run of letters of at least ``least_length`` code points occurs in all texts.

    A run is maximal in ``[A-Za-z\\u00C0-\\u00FF]``; only A-Z are lower-cased.  With ``drop_one_in`` = m, a run whose
    crc32 of ``<doc_id>:<run>`` is a multiple of m loses its code point number crc32 % length first (a null doc_id
    counts as the empty string).  Null and empty texts have no runs.  Every task adds up its rows before the shuffle.
    """
    small_batches(docs.sparkSession)
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for part in _chunks(text):
                    for word, n in Counter(runs.findall(part.encode().translate(_LOWER).decode())).items():
                        if drop_one_in:
                            h = zlib.crc32(word.encode(), start)
                            if h % drop_one_in == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1:]
                                if len(word) < least_length:
                                    continue
                        held[word] = held.get(word, 0) + n
                    if len(held) > _HOLD:
                        yield rows()
                        held.clear()
        yield rows()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text <> ''")
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# --- rotations ----------------------------------------------------------------------------------------

#: Primes under 2**31 and a base for each; four residues name a long prefix (124 bits).
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (911382323, 972663749, 1597334677, 1073676287)


def _powers(base: int, n: int, p: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:                                  # base ** (i + len) = base ** i * base ** len
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out[:n]


def _digests(ring: str, starts: range, m: int) -> list[str]:
    """Names of the windows ring[i:i + m], equal for equal windows."""
    codes = np.frombuffer(ring.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at, names = np.arange(starts.start, starts.stop), []
    for p, base in zip(_PRIMES, _BASES):
        power = _powers(base, len(codes), p)
        sums = np.zeros(len(codes) + 1, np.uint64)
        sums[1:] = np.cumsum(codes * power % np.uint64(p)) % np.uint64(p)
        window = (sums[at + m] + np.uint64(p) - sums[at]) % np.uint64(p)
        back = _powers(pow(base, -1, p), len(codes), p)
        names.append(window * back[at] % np.uint64(p))   # as if every window began at 0
    return [f"{m}:{a:x}:{b:x}:{c:x}:{d:x}" for a, b, c, d in zip(*(x.tolist() for x in names))]


def rotations(word: str) -> tuple[list[str], list[bool], list[int]]:
    """(prefix, whole, edited) of all rotations of the terminated word.

    A rotation that ends in letter i gives the prefix without it: words that share it differ in that letter, or have it
    in excess of the word whose whole rotation the prefix is.  ``edited`` is the letter left out, or for a whole
    rotation the letter it begins with (0 for the terminator): the gap before that letter is where one may be missing.
    """
    n, ring = len(word), word + TERMINATOR + word
    cut, whole = ([ring[i:i + m] for i in starts] if m <= LONGEST_PREFIX else _digests(ring, starts, m)
                  for starts, m in ((range(1, n + 1), n), (range(n + 1), n + 1)))
    letters = [ord(c) for c in word]
    return cut + whole, [False] * n + [True] * (n + 1), letters + letters + [0]


_ROTATION = "prefix string, whole boolean, edited int, id bigint, n bigint"
_ROTATION_ARROW = pa.schema([("prefix", pa.string()), ("whole", pa.bool_()), ("edited", pa.int32()), ("id", pa.int64()), ("n", pa.int64())])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns: list[list] = [[], [], [], [], []]
        for word_id, word, n in zip(*(b.column(c).to_pylist() for c in ("id", "word", "n"))):
            parts = rotations(word)
            for k in range(0, len(parts[0]), _ROWS):     # a long word fills batches of its own
                for held, new in zip(columns, (*(x[k:k + _ROWS] for x in parts), [word_id] * len(parts[0][k:k + _ROWS]), [n] * len(parts[0][k:k + _ROWS]))):
                    held += new
                if len(columns[0]) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ROTATION_ARROW)], schema=_ROTATION_ARROW)
                    columns = [[], [], [], [], []]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ROTATION_ARROW)], schema=_ROTATION_ARROW)


# --- scan of the sorted rotations ---------------------------------------------------------------------

def _leaders(group: np.ndarray, n_groups: int, at: np.ndarray) -> np.ndarray:
    """First of the rows ``at`` (ordered best first within groups) per group, -1 for none."""
    out = np.full(n_groups, -1)
    g, first = np.unique(group[at], return_index=True)
    out[g] = at[first]
    return out


def _neighbours(prefix_new: np.ndarray, whole: np.ndarray, edited: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(id, n_near, best_n, best_id) of the rows that have a neighbour inside their prefix range.

    Every near pair meets in exactly one range: a replacement where its letter is left out; an excess letter where the
    letter after the gap differs from it, the last place of a run of equal letters.
    """
    group = np.cumsum(prefix_new) - 1
    size = np.bincount(group)
    shared = size[group] > 1
    group, whole, edited, ids, n = (x[shared] for x in (group, whole, edited, ids, n))
    order = np.lexsort((ids, -n, group))                 # within a range: largest n, then first in code-point order
    group, whole, edited, ids, n = (x[order] for x in (group, whole, edited, ids, n))
    k = len(size)
    row = np.arange(len(ids))
    base = _leaders(group, k, row[whole])                # the word whose whole rotation the prefix is: one at most
    gap = np.where(base >= 0, edited[base] if len(ids) else 0, -1)
    cut = ~whole
    first = _leaders(group, k, row[cut])
    second = _leaders(group, k, row[cut & (row != first[group])])
    excess = cut & (base[group] >= 0) & (edited != gap[group])
    longer = _leaders(group, k, row[excess])
    others = np.bincount(group[cut], minlength=k)
    beyond = np.bincount(group[excess], minlength=k)
    near = np.where(whole, beyond[group], others[group] - 1 + excess)
    best = np.where(whole, longer[group], np.where(row == first[group], second[group], first[group]))
    rival = np.where(excess, base[group], -1)            # the shorter word may beat the replacements
    ahead = (rival >= 0) & ((best < 0) | (rival < best))
    best = np.where(ahead, rival, best)
    found = near > 0
    out = {"id": ids[found], "n_near": near[found], "best_n": n[best[found]], "best_id": ids[best[found]]}
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], names=list(out))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of one prefix in rows sorted by prefix; the last range of a batch waits for the next one."""
    def ranges(t: pa.Table):
        prefix = t.column("prefix").combine_chunks()
        new = np.ones(len(t), bool)
        if len(t) > 1:
            new[1:] = pc.not_equal(prefix.slice(1), prefix.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
        return new

    def result(t: pa.Table, new: np.ndarray):
        return _neighbours(new, *(t.column(c).to_numpy() for c in ("whole", "edited", "id", "n")))

    waiting = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([b])])
        new = ranges(t)
        last = int(np.flatnonzero(new)[-1])
        waiting = t.slice(last)
        if last:
            yield result(t.slice(0, last), new[:last])
    if waiting is not None:
        yield result(waiting, ranges(waiting))


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every distinct word of (word, n).

    Two words are near if one inserted, deleted or replaced code point makes them equal.  ``form`` is the near word of
    the largest n (ties: first in code-point order) if that n is at least ``ratio`` times the word's own, else null;
    ``root`` is the last word on the way over forms.  Null and empty words are left out, rows of one word are added,
    other columns are ignored; an empty table gives no rows.

    Words are numbered in code-point order.  All rotations are partitioned and sorted by their prefix and scanned; a
    prefix range holds at most one word per letter of the alphabet and one more, and gives one row per member with
    its number of neighbours and its best one, never pairs.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms must lead upwards")
    spark = words.sparkSession
    known = words.where("word <> '' and n is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    known = stored(known.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    small_batches(spark)
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turned = known.repartition(many, "id").mapInArrow(_emit, _ROTATION)      # a short table of words makes many rotations
    met = turned.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_scan, "id bigint, n_near bigint, best_n bigint, best_id bigint")
    best = met.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_id")).alias("minus_id"))).alias("best"))
    led = known.join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("best.best_n") >= ratio * F.col("n"), -F.col("best.minus_id")).alias("form_id"))
    led = stored(led, "forms")
    links = led.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    roots = stored(links, "roots")
    while True:                                          # n grows by the ratio each step, so the ways are short
        up = roots.select(F.col("id").alias("_id"), F.col("root_id").alias("_up"))
        jumped = roots.join(up, F.col("root_id") == F.col("_id"), "left")
        jumped = stored(jumped.select("id", F.coalesce("_up", "root_id").alias("root_id"), F.col("_up").isNotNull().alias("moved")), "roots")
        roots = jumped.select("id", "root_id")
        if jumped.where("moved").isEmpty():
            break
    form = known.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = known.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    out = led.join(form, "form_id", "left").join(roots, "id", "left").join(root, "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, drop_one_in: int | None = 199) -> DataFrame:
    """Spelling variants among the words of whole documents that occur often enough."""
    counts = run_counts(docs, least_length, drop_one_in)
    return spelling_variants(counts.where(F.col("n") >= least_count), ratio)
