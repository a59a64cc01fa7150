"""Near-duplicates, vectors, sharding, mixing, packing and the pipeline on small inputs, against brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import mixing, nearduplicates, packing, sharding, vectors
from tidepanel.llm.common import components
from tidepanel.llm.tokens import Encoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Classes:
    """Union-find that names a class by its smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- components ------------------------------------------------------------------------------------

def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(7, 7)]
    rng.shuffle(edges)
    c = Classes()
    for a, b in edges:
        c.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: c.find(i) for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- near-duplicates -------------------------------------------------------------------------------

def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows, percent=85):
    c, sets = Classes(), [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        c.find(i)
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                c.join(i, j)
    return {i: (c.find(i), len(s)) for i, s in sets}


def near_rows():
    """Copies, near copies around the threshold, one passage that many share, blank and very long texts."""
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    rows, base = [], [word() for _ in range(200)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(200)] = word()
        rows.append((len(rows), " ".join(w)))
    passage = [word() for _ in range(150)]
    for i in range(60):
        rows.append((len(rows), "\n".join(["\t ".join(passage), " ".join(word() for _ in range(rng.randrange(5, 60)))])))
    for i in range(40):
        rows.append((len(rows), " ".join(word() for _ in range(rng.randrange(1, 40)))))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n", "One two", "one TWO", "ONE two three", base and " ".join(base).upper(), "x " * 30_000, "X " * 30_001])]
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("key", F.lit(1)).withColumn("id", F.lit(1))
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in nearduplicates.near_duplicates(df).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_at_another_threshold(spark):
    rows = near_rows()
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in nearduplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), nearduplicates.AT_80).collect()}
    assert got == brute_classes(rows, 80) != brute_classes(rows)


def test_blocks_of_a_bucket_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(nearduplicates, "BLOCK", 8)
    rows = near_rows()
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in nearduplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 63, 3000, np.uint64), rng.integers(0, 1 << 63, 1000, np.uint64)
    x, y, both = nearduplicates.registers(np.concatenate([a, b])), nearduplicates.registers(a), nearduplicates.registers(b)
    assert (x == np.maximum(y, both)).all()
    j, dev = nearduplicates.estimate(x[None], y[None], np.array([4000.0]), np.array([3000.0]))
    assert abs(j[0] - 0.75) < 4 * dev[0]


def test_near_duplicate_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, "p q r s t u"), (None, "P q r s t u"), (None, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = nearduplicates.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(1, 1, True), (2, 1, False), (None, 1, False), (None, None, False), (9, 9, True)}
    stay = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in nearduplicates.one_of_each(df).collect())
    assert stay == [(0, ""), (0, "p q r s t u"), (1, "a b c d e f"), (9, "")]
    assert nearduplicates.near_duplicates(df.limit(0)).count() == 0


# --- vectors ---------------------------------------------------------------------------------------

def vector_rows():
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(6):
            centre = rng.normal(size=16)
            for _ in range(12):
                rows.append((i, (centre + rng.normal(size=16) * 0.19).astype(float).tolist(), label))
                i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(5)]
    i += 5
    rows += [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [1.0, None] + [0.0] * 14, 0), (i + 3, [float("nan")] * 16, 0), (i + 4, rows[0][1], None),
             (i + 5, [1e200] * 16, 1), (i + 6, [1e-200] * 16, 1), (i + 7, [1.0] * 8, 1), (i + 8, [], 1), (i + 9, [float("inf")] * 16, 0)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("tile", [4096, 16])
def test_embedding_links_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rows, c, links = vector_rows(), Classes(), {}
    unit = {i: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for i, v, g in rows if usable(v) and any(v) and g is not None}
    for i, _, g in rows:
        c.find(i)
        links.setdefault(i, 0)
        for j, _, h in rows:
            if j < i and g == h and i in unit and j in unit and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                c.join(i, j)
                links[i], links[j] = links[i] + 1, links.get(j, 0) + 1
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("links", F.lit(1)).withColumn("v", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.embedding_links(df).collect()}
    assert got == {i: (links[i], c.find(i), c.find(i) == i) for i, *_ in rows} and max(links.values()) > 5
    assert vectors.embedding_links(df.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    m = np.random.default_rng(8).normal(size=(300, 24))
    m /= np.linalg.norm(m, axis=1)[:, None]
    q, s, e = vectors.quantise(m)
    rough = (q.astype(float) @ q.astype(float).T) * np.outer(s, s)
    assert (np.abs(m @ m.T - rough) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()


def brute_top(rows, queries, k):
    out = set()
    for q, v in queries:
        s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
        out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k_against_full_sort(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "CANDIDATES", block)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "REMAIN", 6)
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-300, 300, 8).tolist()) for i in range(300)] + [(i, [5] * 8) for i in range(300, 400)] + [(400, [1 << 30] * 8), (401, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>").withColumn("rank", F.lit(1)).withColumn("low", F.lit(1))
    ask = df.where("vec_id % 20 = 0")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.exact_top_k(df, ask, 5).collect()}
    assert got == brute_top(rows, [r for r in rows if r[0] % 20 == 0], 5)


def test_top_k_edge_cases(spark):
    rows = [(0, [0.5, 1.0]), (50, [1.0, -0.001]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, []), (50, [1.0, -0.001])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = vectors.integer_vectors(df)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.exact_top_k(whole, whole.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 50, 128 * 256 - 256), (0, 2, 50, 128 * 256 - 256), (50, 1, 0, 256 * 128 - 256)]
    assert vectors.exact_top_k(whole.limit(0), whole.limit(0)).count() == 0 and vectors.exact_top_k(whole, whole.limit(0)).count() == 0


# --- sharding --------------------------------------------------------------------------------------

def test_communication_matrix_has_exact_sums_and_the_right_law():
    rows, places = np.array([5, 0, 12, 7]), np.array([6, 6, 6, 6])
    total = np.zeros((4, 4))
    for seed in range(2000):
        m = sharding.communication_matrix(rows, places, seed)
        assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == places).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 2000 - np.outer(rows, places) / 24).max() < 0.12


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(1)
    x = np.array([sharding.hypergeometric(rng, 3_000_000_000, 1_000_000_000, 1_000_000) for _ in range(200)])
    sd = math.sqrt(1e6 * 0.75 * 0.25)
    assert abs(x.mean() - 750_000) < 5 * sd / math.sqrt(200) and 0.8 < x.std() / sd < 1.2


def test_shards(spark):
    rows = [(i, f"text {i}é") for i in range(500)] + [(None, None), (3, ""), (3, ""), (7, "y" * 300_000)] + [(9, "same")] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("x")).withColumn("size", F.lit(1)).repartition(5)
    out = sharding.shard_documents(df).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    n = [len(v) for v in slots.values()]
    assert len(n) == 40 and max(n) - min(n) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(df.limit(0)).count() == 0
    assert sorted(r["shard"] for r in sharding.shard_documents(df.limit(3)).collect()) == [0, 1, 2]


# --- mixing ----------------------------------------------------------------------------------------

def test_targets_stop_at_three_times_the_size():
    t = mixing.targets({"a": 100, "b": 10, None: 50, "c": 0})
    assert sum(t.values()) == 160 and t["b"] == 30 and t["c"] == 0 and t[None] <= 150 and t["a"] + t[None] == 130


def test_splitting_tree_is_exact_and_even():
    counts = mixing.splitting_tree(np.array([1000, 7, 0, 33]), 7, 3)
    assert (counts.sum(axis=0) == [1000, 7, 0, 33]).all() and np.ptp(counts.sum(axis=1)) <= 2


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, f"s{i % 5}", " ".join("w" for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [(400, None, "n n n"), (401, "s0", None), (402, "s0", ""), (403, "s1", "z " * 5000)]
    rows += [(404, "s2", "same row")] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("size", F.lit(1)).withColumn("words", F.lit("x")).withColumn("slot", F.lit(2))
    documents, blocks = mixing.mix(df)
    out = mixing.taken_per_document(documents, blocks).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    want = mixing.targets({s: v[1] for s, v in by.items()})
    for s, (taken, size, target, source_size) in by.items():
        assert size == source_size and abs(target - float(want[s])) < 1e-9 and abs(taken - target) <= 0.5
    slots = {}
    for r in blocks.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for cut in (True, False):
        mixed = mixing.mixed_documents(df, cut=cut)
        assert mixed.columns[:5] == ["doc_id", "source", "text", "size", "words"] and "shard" in mixed.columns
        n, most = {}, {x: max(len(WORDS.findall(t or "")) for _, y, t in rows if y == x) for _, x, _ in rows}
        for r in mixed.collect():
            n[r["source"]] = n.get(r["source"], 0) + len(WORDS.findall(r["text"]))
            assert cut or (r["doc_id"], r["source"], r["text"]) in {(i, x, t) for i, x, t in rows}     # whole texts only
        if cut:
            assert n == {s: v[0] for s, v in by.items() if v[0]}
        else:
            assert all(abs(n[s] - by[s][2]) <= most[s] / 2 + 1 for s in n)
    assert mixing.taken_per_document(*mixing.mix(df.limit(0))).count() == 0


def test_mix_hangs_on_the_rows_alone(spark):
    """Same words, shards and slots however the input is split; quotas of the tree seen in the output."""
    rng = random.Random(15)
    rows = [(i if i % 40 else None, rng.choice(["a", "b", None]), " ".join("w" for _ in range(rng.choice([0, 3, 30, 300])))) for i in range(300)] + [(7, "a", "same row of words")] * 9
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    seen = []
    for parts in (1, 7, 40):
        documents, blocks = mixing.mix(df.repartition(parts), shards=5, block_words=50)
        out = mixing.taken_per_document(documents, blocks).collect()
        seen.append(sorted(((r["doc_id"] or -1), str(r["source"]), r["size"], r["taken"], str(r["places"])) for r in out))
        assert len(out) == len(rows) and all(r["taken"] == sum(p["words"] for p in r["places"]) for r in out)
        for r in out:                                    # blocks of a document do not overlap within a copy
            spans = sorted((p["copy"], p["start"], p["words"]) for p in r["places"])
            assert all(x[0] < y[0] or x[1] + x[2] <= y[1] for x, y in zip(spans, spans[1:])) and all(p["start"] + p["words"] <= r["size"] for p in r["places"])
        per = {}
        for r in out:
            for p in r["places"]:
                per[(p["shard"], r["source"])] = per.get((p["shard"], r["source"]), 0) + 1
        shard_sizes = [sum(n for (k, _), n in per.items() if k == s) for s in range(5)]
        quotas = {s: sum(n for (_, x), n in per.items() if x == s) for s in ("a", "b", None)}
        tree = mixing.splitting_tree(np.array([quotas["a"], quotas["b"], quotas[None]]), 5, 11)
        assert tree.tolist() == [[per.get((k, s), 0) for s in ("a", "b", None)] for k in range(5)] and max(shard_sizes) - min(shard_sizes) <= 3
    assert seen[0] == seen[1] == seen[2]


# --- packing ---------------------------------------------------------------------------------------

def fewest_bins(sizes, capacity):
    """By exhaustive search."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(b for b in bins if b >= sizes[k])):
            i = bins.index(room)
            place(k + 1, bins[:i] + [room - sizes[k]] + bins[i + 1:])
        place(k + 1, [*bins, capacity - sizes[k]])

    place(0, [])
    return best


def bins_of(sizes, capacity):
    counts = np.bincount(sizes, minlength=capacity + 1)
    bins = packing.pack_histogram(counts, capacity)
    assert (sum(t * np.bincount(c, minlength=capacity + 1) for t, c in bins) == counts).all() and all(sum(c) <= capacity for _, c in bins)
    return sum(t for t, _ in bins)


def test_bin_completion_is_near_the_optimum():
    rng, extra, worse = random.Random(7), 0, 0
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        got, best = bins_of(sizes, 20), fewest_bins(sizes, 20)
        assert best <= got <= best + 1
        extra += got - best
        worse += got > packing.best_fit_decreasing(np.bincount(sizes, minlength=21), 20)
    assert extra <= 3 and worse <= 1


def test_a_hot_length_costs_one_pattern():
    counts = np.zeros(2049, np.int64)
    counts[700], counts[648], counts[1] = 2_000_000, 1_000_000, 5
    bins = packing.pack_histogram(counts)
    assert sum(t for t, _ in bins) == 1_000_001 and len(bins) < 5


def test_packing(spark):
    rng, enc = random.Random(8), Encoder()
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "it's", "naïve"]) for _ in range(rng.randrange(0, 900)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "word " * 9000), (None, "x"), (203, "same")] + [(203, "same")] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("length", F.lit(1)).withColumn("piece", F.lit(1)).repartition(4)
    out = packing.pack_documents(df).collect()
    bins, docs = {}, {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    total = sum(r["length"] for r in out)
    assert len(bins) <= -(-total // 2048) + 1
    for i, t in set(rows):
        ids = np.append(enc.whole(t or ""), 0).astype("<u4")
        first = (len(ids) - 1) % 2048 + 1
        want = [(0, first)] + [(s, 2048) for s in range(first, len(ids), 2048)]
        for k, (s, n) in enumerate(want):
            assert set(docs[i, k]) == {(s, n, zlib.crc32(ids[s:s + n].tobytes()))}
    assert len(docs[203, 0]) == 41 and packing.pack_documents(df.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    rows = [(i, f"the cat number {i} and the dog are here with all of their {i} friends", "en", "a", 0) for i in range(40)]
    rows += [(100 + i, f"der hund nummer {i} und die katze sind hier mit allen {i} freunden", "de", "b", 0) for i in range(40)]
    rows += [(200, "write to me at someone@mail.example.com or call +1 (212) 555-0187 and the dog", None, "b", 0), (201, "12345", None, "a", 0), (202, None, None, None, None), (5, rows[5][1].upper(), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("extra", F.lit(1))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], None).cache())
        if name != "pack":
            assert seen[-1].columns == list(corpus_pipeline.COLUMNS)
    lang, near, clean, mixed, packed = seen[1:]
    assert {r["doc_id"] for r in lang.collect()} == {r[0] for r in rows} - {201, 202}
    assert near.count() == near.select("doc_id").distinct().count() <= 81
    text = clean.where("doc_id = 200").first()["text"]
    assert "someone@" not in text and "555-0187" not in text and text.endswith("and the dog")
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, None)
    assert empty.count() == 0
