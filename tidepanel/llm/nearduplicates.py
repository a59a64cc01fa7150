"""Near-duplicate documents: SetSketch registers, banding, likelihood estimates, verification on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import components, small_batches, stored

WORDS = 5


@dataclass(frozen=True)
class Cut:
    """Links need 100 * intersection >= percent * union; registers are ``bands`` bands of ``rows``.

    A pair at the threshold t shares no band with probability (1 - t^rows)^bands: under 3e-7 for 85 percent and 26
    bands of 5, under 7e-7 for 80 percent and 36 bands of 5.
    """

    percent: int = 85
    bands: int = 26
    rows: int = 5

    @property
    def registers(self) -> int:
        return self.bands * self.rows


AT_85, AT_80 = Cut(), Cut(80, 36)
#: Most registers of any cut.
REGISTERS = 256
#: Register values are 1 - log_B of an exponential minimum of rate A per element, rounded down and held in 16 bits.
B, A, TOP = 1.001, 20.0, 65_535
#: An estimate so many standard deviations under the threshold rules a pair out: one in 300,000 at the threshold.
DEVIATIONS = 4.5
#: Rows of a bucket that are compared as one block; larger buckets are worked through in pairs of blocks.
BLOCK = 256
_CHUNK = 500_000

_rng = np.random.default_rng(977)
_ODD = _rng.integers(0, 1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(0, 1 << 63, size=REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first byte) of the words of a UTF-8 text, A-Z lowered."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    inside = b[word].astype(np.uint64)
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(inside), dtype=np.uint64) - np.repeat(at, lengths).astype(np.uint64)
    x = (inside + np.uint64(1) + place * _ODD[5]) * _ODD[6]
    x ^= x >> np.uint64(32)
    x *= _ODD[7]
    x ^= x >> np.uint64(29)
    return _mixed(np.add.reduceat(x, at) + lengths.astype(np.uint64) * _ODD[8]), starts


def _shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text's word hashes."""
    n = len(w)
    if not n:
        return w
    k = min(WORDS, n)
    s = w[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        s = s + w[i: n - k + 1 + i] * _ODD[i]
    s = np.sort(_mixed(s + np.uint64(k)))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """For each text its set of 64-bit shingle hashes, sorted; empty for null, empty or blank texts."""
    group, size = [], 0

    def flush():
        raw = b"\n".join(group)
        hashes, first = word_hashes(raw)
        ends = np.cumsum([len(t) + 1 for t in group])
        cuts = np.concatenate([[0], np.searchsorted(first, ends)])
        for i in range(len(group)):
            yield _shingles(hashes[cuts[i]:cuts[i + 1]])

    for t in texts:
        raw = (t or "").encode()
        group.append(raw)
        size += len(raw)
        if size > _CHUNK:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def registers(s: np.ndarray, cut: Cut = AT_85) -> np.ndarray:
    """SetSketch registers of a non-empty set; those of a union are the larger of the two, register by register."""
    factors = _FACTORS[:cut.registers]
    low = np.full(cut.registers, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(low, (s[i:i + 1024, None] * factors).min(axis=0), out=low)
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / A) / np.log(B)), 0, TOP).astype(np.uint16)


def band_keys(r: np.ndarray, cut: Cut = AT_85) -> np.ndarray:
    rows = r.reshape(cut.bands, cut.rows).astype(np.uint64)
    return _mixed((rows * _ODD[9:9 + cut.rows]).sum(axis=1, dtype=np.uint64) + np.arange(1, cut.bands + 1, dtype=np.uint64) * _ODD[14]).view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, cut: Cut = AT_85, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes, and its standard deviation.

    With u and v the shares of the two sizes in their sum, a register of the first is larger with probability
    p(u - v j), smaller with p(v - u j) and equal otherwise, where p(t) = -log_B(1 - t (B - 1) / B) and
    j is the similarity. The log likelihood is concave in j; its maximum is found by bisection.
    """
    more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = x.shape[1] - more - less
    u = nx / (nx + ny)
    v = 1 - u
    c = (B - 1) / B

    def p(t):
        return -np.log1p(-t * c) / np.log(B)

    def slope(j):
        p1, p2 = p(u - v * j), p(v - u * j)
        d1 = -v * c / (1 - (u - v * j) * c) / np.log(B)
        d2 = -u * c / (1 - (v - u * j) * c) / np.log(B)
        tiny = 1e-12
        return more * d1 / np.maximum(p1, tiny) + less * d2 / np.maximum(p2, tiny) - same * (d1 + d2) / np.maximum(1 - p1 - p2, tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        mid = (low + high) / 2
        up = slope(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    j = (low + high) / 2
    return j, np.sqrt(np.maximum(cut.percent / 100 * (1 - cut.percent / 100), j * (1 - j)) / x.shape[1])


def _likely(x, y, nx, ny, cut: Cut) -> np.ndarray:
    """Estimated similarity of pairs that size and estimate leave possible, -1 for the others."""
    out = np.full(len(nx), -1.0)
    at = np.flatnonzero(100 * np.minimum(nx, ny) >= cut.percent * np.maximum(nx, ny))
    for k in range(0, len(at), 8192):
        i = at[k:k + 8192]
        j, dev = estimate(x[i], y[i], nx[i].astype(float), ny[i].astype(float), cut)
        out[i] = np.where(j + DEVIATIONS * dev >= cut.percent / 100, j, -1.0)
    return out


def _linked(p: bytes, q: bytes, cut: Cut) -> bool:
    p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= cut.percent * (len(p) + len(q) - both)


def _matrix(values, cut: Cut) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(-1, cut.registers)


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set: with its size they name it."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(_mixed(s * _ODD[15]).sum(dtype=np.uint64).view(np.int64))


def sketches(docs: DataFrame, cut: Cut = AT_85) -> DataFrame:
    """doc_id, text_key (hash of the text), n (set size), two set fingerprints, registers and band keys; the last two null for empty sets."""
    small_batches(docs.sparkSession)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in shingle_sets(b["text"]):
                if len(s):
                    r = registers(s, cut)
                    rows.append((len(s), *fingerprints(s), r.tobytes(), band_keys(r, cut)))
                else:
                    rows.append((0, 0, 0, None, None))
            out = pd.DataFrame(rows, columns=["n", "f1", "f2", "regs", "bands"])
            out.insert(0, "text_key", b["text_key"])
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    # ids travel as text: pandas would turn a column with nulls into floating point
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInPandas(
        run, "doc_id string, text_key bigint, n bigint, f1 bigint, f2 bigint, regs binary, bands array<bigint>")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of consecutive rows with equal keys; the last group of a batch waits for the next batch."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        new = (b[keys] != b[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        for i, j in zip(starts[:-1], starts[1:]):
            yield b.iloc[i:j]
        rest = b.iloc[starts[-1]:].reset_index(drop=True) if len(starts) else None
    if rest is not None and len(rest):
        yield rest


def verified(pairs: DataFrame, sets: DataFrame, cut: Cut) -> DataFrame:
    """Those of the pairs (a, b) whose full sets (id, set) meet the threshold."""
    one, two = (sets.select(F.col("id").alias(f"_{c}"), F.col("set").alias(f"set_{c}")) for c in "ab")

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_linked(p, q, cut) for p, q in zip(x, y)], dtype=bool)

    return (pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
                 .where(linked("set_a", "set_b")).select("a", "b"))


def near_duplicates(docs: DataFrame, cut: Cut = AT_85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; and text_key, group (its component by class id).

    Documents with equal sets are one class, so copies cost one row. Classes that share a band form a bucket.
    1. Every member of a bucket is compared with the bucket's head, the class of the smallest id: by likelihood estimate, then full sets.
    2. Buckets that still hold several components are worked through in blocks of BLOCK rows: each block returns the
       forest of its likeliest pairs across components, at most one per row, and these are verified.
    3. In buckets that then still hold several components, blocks return the rows that have a possible partner in
       another component; these rows meet again with their full sets, and all their possible pairs are verified.
    No bucket is cut off, pairs within a component are not needed, and no step returns more than a few rows per row.

    Shingles are 64-bit hashes. Null, empty and blank texts have an empty set and link with nothing. Rows that share
    a doc_id are one document: all classes of its texts are linked. A null doc_id links like any other, names no component and is
    not kept; its component is the smallest id linked with it, or null.
    """
    rows = stored(sketches(docs, cut), "sketches")
    full = rows.where("n > 0")
    # a class of equal sets has a number of its own; ids, null, negative or shared, only name what is found
    classes = stored(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("least"), F.min(F.struct("regs", "bands")).alias("s"))
                         .select("n", "f1", "f2", "least", F.monotonically_increasing_id().alias("id"), "s.regs", "s.bands"), "classes")
    sketch = classes.select("id", "n", "regs")
    spread = stored(classes.select("id", "n", F.col("least").isNull().alias("unnamed"), "least", F.posexplode("bands").alias("band", "key")), "bands")
    # the head is the class of the smallest id: where ids follow time, the text that the others are copies of
    heads = (spread.groupBy("key").agg(F.min(F.struct("unnamed", "least", "id", "n")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
                   .select(F.col("key").alias("_key"), F.col("head.id").alias("head"), F.col("head.n").alias("head_n"), "members"))
    buckets = stored(spread.join(heads, F.col("key") == F.col("_key")).select("key", "band", "id", "n", "head", "head_n", "members"), "buckets")

    def filtered(pairs: DataFrame) -> DataFrame:
        """(a, b) pairs that the estimate leaves possible."""
        one, two = (sketch.select(F.col("id").alias(f"_{c}"), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}")) for c in "ab")

        @F.pandas_udf("boolean")
        def possible(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
            return pd.Series(_likely(_matrix(x, cut), _matrix(y, cut), nx.to_numpy(), ny.to_numpy(), cut) >= 0 if len(x) else np.zeros(0, bool))

        return (pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
                     .where(possible("regs_a", "regs_b", "n_a", "n_b")).select("a", "b"))

    near = f"100 * least(n, head_n) >= {cut.percent} * greatest(n, head_n)"
    stars = stored(filtered(buckets.where("id <> head").where(near).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()), "stars")
    wanted = stars.select(F.col("a").alias("_id")).union(stars.select("b")).union(buckets.where("members > 2").select("id")).distinct()
    chosen = wanted.join(classes.select("id", "n", "f1", "f2", "least"), F.col("_id") == F.col("id")).select("id", "n", "f1", "f2", "least")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = texts.join(chosen.select(F.col("least").alias("_least")).where("_least is not null").distinct(), F.col("doc_id") == F.col("_least"), "left_semi")
    found = named.unionByName(texts.where("doc_id is null")).select("text").mapInPandas(_set_rows, "n1 bigint, g1 bigint, g2 bigint, set binary")
    same_set = (F.col("n") == F.col("n1")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
    sets = stored(found.dropDuplicates(["n1", "g1", "g2"]).join(chosen, same_set).select("id", "set"), "sets")
    # rows of one id with several sets are one document: their classes are linked
    several = full.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "f1", "f2")).alias("x"), F.max(F.struct("n", "f1", "f2")).alias("y")).where("x <> y")
    ties = (full.join(several.select(F.col("doc_id").alias("_doc"), "x"), F.col("doc_id") == F.col("_doc")).select("n", "f1", "f2", "x").distinct()
                .join(classes.select("n", "f1", "f2", "id"), ["n", "f1", "f2"])
                .join(classes.select(F.col("n").alias("n1"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("id").alias("head")),
                      (F.col("x.n") == F.col("n1")) & (F.col("x.f1") == F.col("g1")) & (F.col("x.f2") == F.col("g2")))
                .where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))
    links = stored(verified(stars, sets, cut).union(ties), "links")
    parts = components(links)

    def still_open() -> DataFrame:
        """Members of buckets with several components, with their component, sketch and block."""
        c = parts.select(F.col("id").alias("_p"), "component")
        placed = buckets.where("members > 2").join(c, F.col("id") == F.col("_p"), "left").withColumn("part", F.coalesce("component", "id"))
        sizes = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
        keys = (sizes.groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("rows", "part")).alias("most"), F.sum("rows").alias("all")).where("all > most.rows")
                     .select("_k", F.col("most.part").alias("largest"), F.ceil((F.col("all") - F.col("most.rows")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("most.rows") / BLOCK).cast("int").alias("inner")))
        left = placed.join(keys, F.col("key") == F.col("_k")).join(sketch.select(F.col("id").alias("_s"), "regs"), F.col("id") == F.col("_s"))
        own = F.when(F.col("part") == F.col("largest"), F.col("outer") + F.pmod(F.xxhash64("id"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("id"), F.col("outer")))
        return left.withColumn("block", own.cast("int"))

    forest = stored(in_blocks(still_open(), partial(_forest, cut=cut), "a bigint, b bigint").distinct(), "forest")
    if not forest.isEmpty():
        links = stored(links.union(verified(forest, sets, cut)), "links")
        parts = components(links)
        flagged = stored(in_blocks(still_open(), partial(_flagged, cut=cut), FLAGGED), "flagged")
        if not flagged.isEmpty():
            own = sets.select(F.col("id").alias("_id"), "set")
            with_sets = flagged.join(own, F.col("id") == F.col("_id")).drop("_id")
            rest = together(with_sets).mapInPandas(partial(_verified_blocks, cut=cut), "a bigint, b bigint")
            parts = components(links.union(stored(rest.distinct(), "links")))

    c = parts.select(F.col("id").alias("_p"), "component")
    placed = stored(classes.join(c, F.col("id") == F.col("_p"), "left").select("n", "f1", "f2", "least", F.coalesce("component", "id").alias("part")), "placed")
    names = placed.groupBy(F.col("part").alias("_part")).agg(F.min("least").alias("name"))
    named = placed.join(names, F.col("part") == F.col("_part")).select(F.col("n").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "name", "part")
    out = rows.join(named, (F.col("n") == F.col("_n")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")), "left")
    component = F.coalesce("name", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), "text_key", F.col("part").alias("group"))


def one_of_each(docs: DataFrame, cut: Cut = AT_80) -> DataFrame:
    """The documents that stay: of every group of near-duplicates the one with the smallest id, once.

    Documents without words all stay. Of a group without any id one document stays.
    """
    found = stored(near_duplicates(docs, cut), "groups")
    stay = found.where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.min("text_key").alias("_key"))
    out = docs.join(stay, (F.col("doc_id") == F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_key"))).drop("_id", "_key").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return out
    unnamed = found.where("doc_id is null and component_id is null")
    groups = unnamed.where("group is not null").groupBy("group").agg(F.min("text_key").alias("_key")).select("_key")
    one = nameless.withColumn("_text", F.xxhash64("text")).join(groups, F.col("_text") == F.col("_key")).dropDuplicates(["_text"]).drop("_text", "_key")
    blank = nameless.where(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "") == "")
    return out.unionByName(one).unionByName(blank)


def _set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(len(s), *fingerprints(s), s.tobytes()) for s in shingle_sets(b["text"]) if len(s)]
        yield pd.DataFrame(out, columns=["n1", "g1", "g2", "set"])


# --- blocks of a bucket ----------------------------------------------------------------------------

FLAGGED = "key bigint, band int, i int, j int, block int, id bigint, n bigint, part bigint, regs binary"


def together(df: DataFrame) -> DataFrame:
    """Rows of a meeting in one partition, in order. The number is given, as small rows mean long work here: left to
    itself Spark would join many meetings into few tasks by their bytes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def in_blocks(left: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work`` on the blocks of every bucket that must meet.

    The first ``outer`` blocks hold what is outside the bucket's largest component, and meet each other, themselves and
    the ``inner`` blocks of that component, which need not meet among themselves: with r rows outside and m inside,
    about r * (r + 2 m) / BLOCK rows travel, m for a single outsider."""
    met = left.withColumn("other", F.explode(F.expr("sequence(0, IF(block < outer, outer + inner, outer) - 1)")))
    met = met.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "part", "regs")
    return together(met).mapInPandas(work, schema)


def _meeting(g: pd.DataFrame, cut: Cut) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of i, rows of j, x, y, similarity): possible pairs of different parts in two blocks, each pair once."""
    same = g["i"].iloc[0] == g["j"].iloc[0]
    p = g if same else g[g["block"] == g["i"]]
    q = g if same else g[g["block"] == g["j"]]
    nx, ny = p["n"].to_numpy(), q["n"].to_numpy()
    ok = p["part"].to_numpy()[:, None] != q["part"].to_numpy()[None, :]
    ok &= 100 * np.minimum.outer(nx, ny) >= cut.percent * np.maximum.outer(nx, ny)
    if same:
        ok &= p["id"].to_numpy()[:, None] < q["id"].to_numpy()[None, :]
    x, y = np.nonzero(ok)
    if not len(x):
        return p, q, x, y, np.zeros(0)
    mx, my = _matrix(p["regs"], cut), _matrix(q["regs"], cut)
    j = np.concatenate([_likely(mx[x[k:k + 8192]], my[y[k:k + 8192]], nx[x[k:k + 8192]], ny[y[k:k + 8192]], cut) for k in range(0, len(x), 8192)])
    keep = np.flatnonzero(j >= 0)
    x, y, j = x[keep], y[keep], j[keep]
    # a pair that shares several bands is looked at in the first of them only
    shared = np.concatenate([(mx[x[k:k + 8192]] == my[y[k:k + 8192]]).reshape(-1, cut.bands, cut.rows).all(axis=2).argmax(axis=1) for k in range(0, max(1, len(x)), 8192)])
    first = shared == g["band"].iloc[0]
    return p, q, x[first], y[first], j[first]


def _spanning(pairs, linked=lambda *_: True) -> Iterator[tuple[int, int]]:
    """Those of the pairs ((part, part), rows, ids) that are linked and join parts not joined by earlier ones: their ids."""
    up: dict = {}

    def find(v):
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for (u, v), (a, b), ids in pairs:
        u, v = find(u), find(v)
        if u != v and linked(a, b):
            up[u] = v
            yield ids


def _forest(batches: Iterator[pd.DataFrame], cut: Cut) -> Iterator[pd.DataFrame]:
    for g in _groups(batches, ["key", "i", "j"]):
        p, q, x, y, j = _meeting(g, cut)
        if len(x):
            order = np.argsort(-j, kind="stable")
            ids, parts = (p["id"].to_numpy(), q["id"].to_numpy()), (p["part"].to_numpy(), q["part"].to_numpy())
            pairs = (((parts[0][a], parts[1][b]), (a, b), (ids[0][a], ids[1][b])) for a, b in zip(x[order], y[order]))
            out = np.array(list(_spanning(pairs)))
            yield pd.DataFrame({"a": out.min(axis=1), "b": out.max(axis=1)})


def _flagged(batches: Iterator[pd.DataFrame], cut: Cut) -> Iterator[pd.DataFrame]:
    for g in _groups(batches, ["key", "i", "j"]):
        p, q, x, y, _ = _meeting(g, cut)
        if len(x):
            same = g["i"].iloc[0] == g["j"].iloc[0]
            at = p.iloc[np.union1d(x, y)] if same else pd.concat([p.iloc[np.unique(x)], q.iloc[np.unique(y)]])
            yield at[[c.split()[0] for c in FLAGGED.split(", ")]]


def _verified_blocks(batches: Iterator[pd.DataFrame], cut: Cut) -> Iterator[pd.DataFrame]:
    for g in _groups(batches, ["key", "i", "j"]):
        p, q, x, y, j = _meeting(g, cut)
        sets, ids, parts = (list(p["set"]), list(q["set"])), (p["id"].to_numpy(), q["id"].to_numpy()), (p["part"].to_numpy(), q["part"].to_numpy())
        order = np.argsort(-j, kind="stable")
        pairs = (((parts[0][a], parts[1][b]), (a, b), (ids[0][a], ids[1][b])) for a, b in zip(x[order], y[order]))
        out = np.array(list(_spanning(pairs, lambda a, b: _linked(sets[0][a], sets[1][b], cut))))
        if len(out):
            yield pd.DataFrame({"a": out.min(axis=1), "b": out.max(axis=1)})
