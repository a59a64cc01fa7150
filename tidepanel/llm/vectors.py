"""Embedding near-duplicates by int8 tile products, and exact top-k search by global score histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import components, stored

#: Vectors in a tile, and in the blocks that a tile product is worked through in.
TILE, BLOCK = 4096, 1024


def finite(v: Column) -> Column:
    """True for a vector without null, NaN or infinite components; an empty or null vector is not one."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that norms neither overflow nor vanish."""
    return m / np.abs(m).max(axis=1, keepdims=True)


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error) of unit rows: int8 rows with u = scale * q + e and a bound on the length of e."""
    scale = np.maximum(np.abs(m).max(axis=1), 1e-300) / 127
    q = np.rint(m / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(m - scale[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12


class _Tile:
    def __init__(self, ids: bytes, weights: bytes, vectors: bytes, dim: int):
        self.ids, self.weights = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
        m = _scaled(np.frombuffer(vectors, np.float64).reshape(-1, dim))
        self.m, self.norm = m, np.sqrt((m * m).sum(axis=1))
        q, scale, self.error = quantise(m / self.norm[:, None])
        # integers up to 127 * 127 * dim are exact in single precision below 2**24, in double precision beyond
        self.q = q.astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)
        self.scale = scale


def linked_pairs(a: _Tile, b: _Tile, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with cosine >= threshold; each unordered pair once where both tiles are one.

    The int8 product, scaled, differs from the cosine of rows x and y by at most e_x + (1 + e_x) e_y.  Only pairs
    that this bound leaves possible are computed in double precision.
    """
    for i in range(0, len(a.ids), BLOCK):
        for j in range(i if same else 0, len(b.ids), BLOCK):
            s, t = slice(i, i + BLOCK), slice(j, j + BLOCK)
            rough = (a.q[s] @ b.q[t].T) * a.scale[s, None] * b.scale[None, t]
            bound = a.error[s, None] + (1 + a.error[s, None]) * b.error[None, t]
            x, y = np.nonzero(rough + bound >= threshold)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 65_536):
                p, r = x[k:k + 65_536], y[k:k + 65_536]
                exact = (a.m[p] * b.m[r]).sum(axis=1) / (a.norm[p] * b.norm[r])
                yield p[exact >= threshold], r[exact >= threshold]


def _roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Join the classes of linked rows: ``root`` holds for every row the smallest row known to be in its class."""
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _tile_links(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a = _Tile(r.ids, r.weights, r.vectors, r.dim)
                same = r.i == r.j
                b = a if same else _Tile(r.ids2, r.weights2, r.vectors2, r.dim)
                n = len(a.ids)
                ids, weights = (a.ids, a.weights) if same else (np.append(a.ids, b.ids), np.append(a.weights, b.weights))
                links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for x, y in linked_pairs(a, b, same, threshold):
                    y = y if same else y + n
                    np.add.at(links, x, weights[y])
                    np.add.at(links, y, weights[x])
                    root = _roots(root, x, y)
                at = np.flatnonzero(links)
                if len(at):
                    yield pd.DataFrame({"rep": ids[at], "links": links[at], "root": ids[root[at]]})

    return run


def embedding_links(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Near-duplicate classes of vectors with equal labels: vec_id, n_links, component_id, kept; one row per input row.

    Equal vectors are one row with a weight, so a hot vector costs nothing.  Each label's vectors are dealt into
    tiles; every two tiles of a label meet in one task, which returns one row per linked vector (how many it is
    linked to, and the smallest vector of its class within the two tiles), never the pairs.  Vectors of a label
    with different lengths are not compared.  Null labels, null, empty or zero vectors and those with null or
    non-finite components have no links.  A repeated id counts as one vector per row.  A null id is compared like
    any other, takes no part in naming components, and has a null component.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = stored(df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
                    .withColumn("usable", F.col("label").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0)), "vectors")
    usable = rows.where("usable").drop("usable").withColumn("dim", F.size("v"))
    # a class of equal vectors has a number of its own; ids, null or not, only name what is found
    unique = stored(usable.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
                          .withColumn("rep", F.monotonically_increasing_id()), "unique")
    tiles = unique.groupBy(F.col("label").alias("_l"), F.col("dim").alias("_d")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    dealt = (unique.join(tiles, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d"))).drop("_l", "_d")
                   .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")))

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], key[2], int(part["tiles"].iloc[0]), part["rep"].to_numpy(np.int64).tobytes(),
                              part["weight"].to_numpy(np.int64).tobytes(), np.stack(part["v"]).astype(np.float64).tobytes())],
                            columns=["label", "dim", "tile", "tiles", "ids", "weights", "vectors"])

    kind = dict(df.dtypes)[label]
    packed = stored(dealt.groupBy("label", "dim", "tile").applyInPandas(build, f"label {kind}, dim int, tile int, tiles int, ids binary, weights binary, vectors binary"), "tiles")
    left = packed.withColumn("j", F.explode(F.expr("sequence(tile, tiles - 1)"))).withColumnRenamed("tile", "i").drop("tiles")
    right = packed.select(F.col("label").alias("label2"), F.col("dim").alias("dim2"), F.col("tile").alias("j2"),
                          *[F.col(c).alias(c + "2") for c in ("ids", "weights", "vectors")], "tiles")
    right = right.withColumn("i2", F.explode(F.expr("sequence(0, j2)"))).drop("tiles")
    on = [F.col(c) == F.col(c + "2") for c in ("label", "dim", "i", "j")]
    same = packed.select("label", "dim", F.col("tile").alias("i"), F.col("tile").alias("j"), "ids", "weights", "vectors",
                         *[F.lit(None).cast("binary").alias(c + "2") for c in ("ids", "weights", "vectors")])
    cross = left.where("i < j").join(right.where("i2 < j2"), on).select(*same.columns)
    found = stored(same.union(cross).repartition(F.xxhash64("label", "dim", "i", "j")).mapInPandas(_tile_links(threshold), "rep bigint, links bigint, root bigint"), "found")
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = stored(unique.join(parts.withColumnRenamed("id", "_p"), F.col("rep") == F.col("_p"), "left")
                          .select("label", "v", "rep", "weight", "least", F.coalesce("component", "rep").alias("part")), "placed")
    names = placed.groupBy(F.col("part").alias("_part")).agg(F.min("least").alias("component_id"))
    by_rep = (placed.join(sums.withColumnRenamed("rep", "_s"), F.col("rep") == F.col("_s"), "left").join(names, F.col("part") == F.col("_part"))
                    .select(F.col("label").alias("_l"), F.col("v").alias("_v"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    joined = rows.join(by_rep, F.col("usable") & (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                         F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


# --- exact top-k -----------------------------------------------------------------------------------

#: Candidates and queries in a block; bins of a histogram; rows per query that may remain above its threshold
#: before the selection stops refining (beyond that it refines down to a single score).
CANDIDATES, QUERIES, BINS, REMAIN = 8192, 1024, 64, 64


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, v) packed into blocks of about ``size`` rows: block, ids, vectors."""
    n = max(1, -(-df.count() // size))
    dealt = df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"))

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame([(key[0], key[1], part["id"].to_numpy(np.int64).tobytes(), np.stack(part["v"]).astype(np.int64).tobytes())],
                            columns=["block", "dim", "ids", "vectors"])

    return stored(dealt.groupBy("block", F.size("v").alias("dim")).applyInPandas(build, "block int, dim int, ids binary, vectors binary"), name)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating-point products where those are exact, else in 64-bit integers."""
    bound = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "v") -> DataFrame:
    """The ``k`` highest integer inner products of every query over all rows but its own id: query_id, rank, vec_id, score.

    Both inputs hold an id and an array<bigint>.  Every task scores a block of candidates against a block of
    queries.  Passes of histograms, added up over all blocks, narrow down for each query the score of its k-th
    candidate: each pass cuts the bin that holds it into BINS parts, until no more than REMAIN candidates lie at or
    above it or the bin is a single score.  The last pass keeps what reaches the bin (at most k per block and
    query, ties to the smaller id), and those rows are ranked.  Queries with fewer than k candidates get them all.
    Ties go to the smaller id; a repeated id is a candidate per row; rows with null ids take no part; vectors of
    other lengths than the query's are no candidates.  Scores are exact while they stay below 2**63.
    """
    cand = _blocks(df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("id is not null"), CANDIDATES, "candidates")
    ask = _blocks(queries.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("id is not null").distinct(), QUERIES, "queries")
    # every block of queries meets every block of candidates: the stated query set against all rows
    n = ask.agg(F.max("block")).first()[0]
    spread = cand.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n if n is not None else 0))))
    a = ask.select(F.col("block").alias("qb2"), F.col("dim").alias("dim2"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = spread.join(a, (F.col("qb") == F.col("qb2")) & (F.col("dim") == F.col("dim2"))).select("block", "qb", "dim", "ids", "vectors", "q_ids", "q_vectors")

    def scored(r):
        q, c = (np.frombuffer(x, np.int64).reshape(-1, r.dim) for x in (r.q_vectors, r.vectors))
        q_ids, c_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
        return q_ids, c_ids, _scores(q, c), q_ids[:, None] != c_ids[None, :]

    def span(batches):
        for b in batches:
            for r in b.itertuples():
                q_ids, _, s, other = scored(r)
                big = np.iinfo(np.int64)
                low = np.where(other, s, big.max).min(axis=1)
                high = np.where(other, s, big.min).max(axis=1)
                yield pd.DataFrame({"qb": r.qb, "query_id": q_ids, "low": low, "high": high, "n": other.sum(axis=1)})

    bounds = pairs.mapInPandas(span, "qb int, query_id bigint, low bigint, high bigint, n bigint").where("n > 0")
    # low..high: where the k-th score lies; above: candidates over high; width: of a bin
    state = bounds.groupBy("qb", "query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    state = stored(state.select("qb", "query_id", "low", "high",
                                F.lit(0).cast("bigint").alias("above"), F.col("n").alias("reach"), (F.col("n") <= k).alias("done")), "state")

    def packed_state(s: DataFrame) -> DataFrame:
        """A query block's thresholds in one row; a block has at most about QUERIES queries."""
        return s.groupBy(F.col("qb").alias("sqb")).agg(F.collect_list(F.struct("query_id", "low", "high", "done")).alias("t"))

    def thresholds(r):
        return {x["query_id"]: (x["low"], x["high"], x["done"]) for x in r.t}

    def count(batches):
        for b in batches:
            for r in b.itertuples():
                q_ids, _, s, other = scored(r)
                t, parts = thresholds(r), []
                for i, q in enumerate(q_ids.tolist()):
                    low, high, done = t.get(q, (0, 0, True))
                    if done:
                        continue
                    x = s[i][other[i]]
                    x = x[(x >= low) & (x <= high)]
                    step = -(-(high - low + 1) // BINS)
                    at, c = np.unique((x - low) // step, return_counts=True)
                    parts.append(np.stack([np.full(len(at), q), at, c]))
                if parts:
                    yield pd.DataFrame(np.concatenate(parts, axis=1).T, columns=["query_id", "bin", "c"])

    while not state.where("not done").isEmpty():
        work = pairs.join(packed_state(state.where("not done")), F.col("qb") == F.col("sqb"))
        hist = work.mapInPandas(count, "query_id bigint, bin bigint, c bigint").groupBy("query_id", "bin").agg(F.sum("c").alias("c"))
        # one query has at most BINS bins
        bins = hist.groupBy(F.col("query_id").alias("h_id")).agg(F.sort_array(F.collect_list(F.struct("bin", "c")), asc=False).alias("h"))
        step = F.expr(f"(high - low + {BINS}) div {BINS}")
        at = F.expr(f"""aggregate(h, named_struct('above', above, 'bin', cast(-1 as bigint), 'c', cast(0 as bigint)),
                     (s, x) -> IF(s.bin >= 0, s, IF(s.above + x.c >= {k}, named_struct('above', s.above, 'bin', x.bin, 'c', x.c),
                                                   named_struct('above', s.above + x.c, 'bin', cast(-1 as bigint), 'c', cast(0 as bigint)))))""")
        moved = (state.where("not done").join(bins, F.col("query_id") == F.col("h_id")).withColumn("at", at).withColumn("step", step)
                      .select("qb", "query_id", (F.col("low") + F.col("at.bin") * F.col("step")).alias("low"),
                              F.least(F.col("high"), F.col("low") + (F.col("at.bin") + 1) * F.col("step") - 1).alias("high"),
                              F.col("at.above").alias("above"), (F.col("at.above") + F.col("at.c")).alias("reach"), "step"))
        moved = moved.withColumn("done", (F.col("reach") <= REMAIN) | (F.col("step") <= 1)).drop("step")
        state = stored(state.where("done").unionByName(moved), "state")

    def keep(batches):
        for b in batches:
            for r in b.itertuples():
                q_ids, c_ids, s, other = scored(r)
                t, parts = thresholds(r), []
                for i, q in enumerate(q_ids.tolist()):
                    if q in t:
                        at = np.flatnonzero(other[i] & (s[i] >= t[q][0]))
                        at = at[np.lexsort((c_ids[at], -s[i][at]))][:k]
                        parts.append(np.stack([np.full(len(at), q), c_ids[at], s[i][at]]))
                if parts:
                    yield pd.DataFrame(np.concatenate(parts, axis=1).T, columns=["query_id", "vec_id", "score"])

    rows = pairs.join(packed_state(state), F.col("qb") == F.col("sqb")).mapInPandas(keep, "query_id bigint, vec_id bigint, score bigint")
    # what is left of a query: at most k rows of each block at or above its threshold
    best = rows.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """vec_id and v, floor(256 x) of every component as double; rows with null, empty or non-finite vectors are left out."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return (df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("d")).where(finite(F.col("d")))
              .select("vec_id", F.transform("d", lambda x: F.floor(x * factor)).alias("v")))
