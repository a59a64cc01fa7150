"""Spelling variants and tokenizer alignment on small inputs, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import alignment, quality, spelling

# --- spelling variants -----------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def variants_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_match_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))): rng.choice([1, 1, 2, 5, 10, 50, 250]) for _ in range(400)}
    for n in (spelling.LONGEST_PREFIX - 1, spelling.LONGEST_PREFIX, spelling.LONGEST_PREFIX + 1, 300):     # plain and named prefixes meet
        w = "".join(rng.choice("ab") for _ in range(n))
        k = rng.randrange(n)
        words |= {w: 100, w[:k] + "c" + w[k:]: 20, w[:k] + w[k + 1:]: 3, w[:k] + "z" + w[k + 1:]: 100}
    rows = [(w, n, 1) for w, n in words.items()] + [(None, 7, 1), ("", 9, 1), ("aab", None, 1)]
    got = variants_of(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n bigint, form int")))
    assert got == brute_variants(words)


def test_near_pairs_meet_in_one_range():
    rng = random.Random(5)
    for n in (1, 2, 5, 63, 64, 65, 90):
        for _ in range(30):
            w = "".join(rng.choice("ab") for _ in range(n))
            k = rng.randrange(n)
            for v in (w[:k] + rng.choice("abc") + w[k:], w[:k] + "c" + w[k + 1:], w[:k] + w[k + 1:]):
                if v and v != w:
                    a, b = ([*zip(*spelling.rotations(x))] for x in (w, v))
                    assert sum(p == q and (not x and not y or x != y and e != f) for p, x, e in a for q, y, f in b) == 1


def test_a_range_over_several_batches():
    import pyarrow as pa

    rows = [("p", False, ord(c), i, 10 * i) for i, c in enumerate("abcdefg")] + [("q", False, 1, 90, 1)]
    whole = pa.Table.from_pylist([dict(zip(("prefix", "whole", "edited", "id", "n"), r)) for r in rows], schema=spelling._ROTATION_ARROW)
    for size in (1, 3, 100):
        out = [r for b in spelling._scan(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted((r["id"], r["n_near"], r["best_id"]) for r in out) == [(i, 6, 5 if i == 6 else 6) for i in range(7)]


def test_hot_word_ties_and_empty(spark):
    words = {"target": 5000, "tarket": 1000, "farget": 1000, "targets": 200, "targetss": 40}
    got = variants_of(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert got == brute_variants(words) and got["targetss"][:2] == ("targets", "target")
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "word string, n bigint"), ratio=1)


def brute_runs(rows, drop=None):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop and len(w) >= 6 and h % drop == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                out[w] += 1
    return out


def test_run_counts(spark, monkeypatch):
    rows = [(1, "Letters ÀÉletters letters_letters9letters"), (2, None), (3, ""), (None, "letters lettersÿ"), (1, "Letters"), (5, "abcdefgh " * 400 + "x" * 3000 + " tail-tailing")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit(1))
    for drop in (None, 3):
        got = {r["word"]: r["n"] for r in spelling.run_counts(df, drop_one_in=drop).collect()}
        assert got == brute_runs(rows, drop)
    text = rows[-1][1]
    assert "".join(spelling._chunks(text, 100)) == text
    assert Counter(w for p in spelling._chunks(text, 100) for w in re.findall("[a-z]+", p)) == Counter(re.findall("[a-z]+", text))


# --- tokenizer alignment ---------------------------------------------------------------------------

SIGNS = ["a", "the", " ", "  ", "   ", "\n", "\t", "ing", "é", "日本", "▁", "'s", "don't", "A", "<s>", "</s>", "<|endoftext|>", "0", "123", "!!", "%%%",
         "ß", "👍🏽", "é", "\x00", "\x85", "\xa0", "\r\n", ",", "Th", " word", "\x1c", "​", "a" * 28, "xq9Zk" * 30]


def brute_groups(text):
    """(A groups, B groups) by whole-text tokens and set intersection of ends; None without tokens."""
    tool = alignment.aligner()
    full = " " + (text or "")
    a, b = tool.a.tokenizer.encode(full, add_special_tokens=False).ids, tool.b.encode(text or "")
    lengths = [[len(table[i]) for i in ids] for ids, table in ((a, tool.bytes_a), (b, tool.bytes_b))]
    joined = [b"".join(table[i] for i in ids) for ids, table in ((a, tool.bytes_a), (b, tool.bytes_b))]
    if not text or any(j != full.encode() for j in joined):
        return None
    ends = [np.cumsum(x).tolist() for x in lengths]
    both = set(ends[0]) & set(ends[1])

    def groups(ids, stops):
        out, cur = [], []
        for i, e in zip(ids, stops):
            cur.append(i)
            if e in both:
                out.append(cur)
                cur = []
        return out

    return list(zip(groups(a, ends[0]), groups(b, ends[1])))


def brute_alignment(texts):
    found = [brute_groups(t) for t in texts]
    links = [Counter((x, y) for p, q in g or [] for x in p for y in q) for g in found]
    docs = Counter(pair for x in links for pair in x)
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for g, x in zip(found, links):
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(x.values()), sum(n for k, n in x.items() if docs[k] == best[k[0]]),
                    sum(n * docs[k] for k, n in x.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_alignment_matches_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    texts += [None, "", " ", "  ", "\n", " a", "a ", "a  ", "same words here", "same words here", "of the and " * 30_000]
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, codes string").repartition(5)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = sorted((i or -1, *w) for (i, _, _), w in zip(rows, brute_alignment(texts)))
    for limit in (alignment.BROADCAST_PAIRS, 0):            # counts broadcast, counts joined
        got = sorted((r["doc_id"] or -1, *(r[c] for c in columns)) for r in alignment.align_tokenizers(df, broadcast_pairs=limit).collect())
        assert got == want
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align_tokenizers(empty).count() == 0 and alignment.align_tokenizers(empty, broadcast_pairs=-1).count() == 0


def test_galloping_finds_every_common_end():
    rng = np.random.default_rng(7)
    for _ in range(300):
        parts = [(np.unique(rng.integers(1, 60, rng.integers(1, 40))), np.unique(rng.integers(1, 60, rng.integers(1, 40)))) for _ in range(rng.integers(1, 5))]
        base = np.arange(len(parts)) * 100
        a, b = (np.concatenate([p[k] + s for p, s in zip(parts, base)]) for k in (0, 1))
        ia, ib = alignment.common_ends(a, np.array([len(p[0]) for p in parts]), b, np.array([len(p[1]) for p in parts]))
        assert a[ia].tolist() == b[ib].tolist() == sorted(set(a) & set(b))


def test_large_groups_count_distinct_ids(monkeypatch):
    a, b = np.array([1, 1, 2]), np.array([7, 8, 8])
    assert sorted(zip(*(x.tolist() for x in alignment.group_links(a, b)))) == [(1, 7, 2), (1, 8, 4), (2, 7, 1), (2, 8, 2)]
    texts = ["".join(random.Random(8).choice(SIGNS) for _ in range(200)), "xq9Zk" * 300]
    want = [[x.tolist() if hasattr(x, "tolist") else x for x in part] for part in alignment.Aligner().align(texts)]
    monkeypatch.setattr(alignment, "_LARGE", 0)
    assert [[x.tolist() if hasattr(x, "tolist") else x for x in part] for part in alignment.Aligner().align(texts)] == want
    monkeypatch.setattr(alignment, "_CHUNK", 50)            # many small runs of texts, forgetting in between
    monkeypatch.setattr(alignment, "_REMEMBER", 3)
    tool, digests = alignment.Aligner(), []
    for part in tool.align(texts * 3):
        digests += part[2]
    assert digests == want[0][2] * 3


# --- quality ---------------------------------------------------------------------------------------

def plain_counts(text):
    """Terms of a text, one at a time."""
    out = np.zeros(quality.TERMS)
    for n in quality.ORDERS:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i:i + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            out[((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % quality.BUCKETS] += 1
    kind = [int(quality._kinds()[ord(c)]) for c in text]
    for x, y, z in zip(kind, kind[1:], kind[2:]):
        out[quality.BUCKETS + (x * quality._CLASSES + y) * quality._CLASSES + z] += 1
    words = text.lower().split()
    out[-3:] = sum(x == y for x, y in zip(words, words[1:])), len(words) - len(set(words)), len(set(words))
    return out


def test_terms_of_whole_texts(monkeypatch):
    rng = random.Random(9)
    texts = ["", "a", "ab", "Same same SAME end.", "".join(rng.choice("ab  .É9\n") for _ in range(400))]
    for size in (1, 2, 7, 10_000):
        monkeypatch.setattr(quality, "_CHUNK", size)
        for t in texts:
            assert (quality.term_counts(t) == plain_counts(t)).all()
    assert not quality.term_counts(None).any()


def quality_rows():
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(240):
        w = [word() for _ in range(rng.randrange(20, 60))]
        kind = i % 4
        text = " ".join(w) + "." if kind else rng.choice([" ".join(f"{x}###" for x in w), " ".join(x for x in w for _ in range(8)), " ".join(w).upper() + "!!"])
        rows.append((i, text, None if i % 7 == 0 else int(kind > 0)))
    return rows


def test_votes_match_brute_force_and_held_out_accuracy(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, i % 3) for i, t, _ in rows] + [(900, None, 0), (901, "", 0), (902, rows[1][1], 0)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5_000, 0), (None, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs.repartition(5), labels).collect()}
    again = {r["doc_id"]: r for r in quality.score_quality(docs.coalesce(1), labels).collect()}
    assert got.keys() == again.keys() and all(abs(got[i]["score"] - again[i]["score"]) < 1e-6 and got[i]["predicted"] == again[i]["predicted"] for i in got)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}
    assert all(got[i]["held_out"] == held[i] and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.3) for i in got)
    truth = {i: int(i % 4 > 0) for i, _, _ in rows}
    wrong = [i for i in truth if held[i] and got[i]["predicted"] != truth[i]]
    assert len(wrong) <= 2
    # the space and the votes by hand, over all voters at once
    voters = [(t, y) for i, t, y in rows if y is not None and not held[i]]
    counts = np.stack([plain_counts(t) for t, _ in voters])
    y = np.array([y for _, y in voters], float)
    rarity = np.ones(quality.TERMS)
    rarity[:quality.BUCKETS] = np.log((1 + len(voters)) / (1 + (counts > 0).sum(axis=0)[:quality.BUCKETS])) + 0.05
    x = quality._weighted(counts, rarity)
    values, axes = np.linalg.eigh(x.T @ x)
    model = quality.train(docs.where(~quality.held_out(F.col("doc_id"))), labels.withColumnRenamed("quality", "label"))
    own = np.linalg.norm((x @ model.axes) @ model.axes.T - x) ** 2
    least = values[:-quality.DIMENSIONS].sum()               # what no space of as many axes can keep
    assert least <= own * (1 + 1e-9) and own <= 1.02 * least + 1e-9
    assert len(model.voters) == len({t for t, _ in voters}) and abs(model.base - y.mean()) < 1e-12
    mine = quality._unit(quality._weighted(np.stack([plain_counts(t) for _, t, _ in rows[:40]]), rarity) @ model.axes)
    for (i, _, _), v in zip(rows[:40], mine):
        near = model.voters @ v
        chosen = near >= np.sort(near)[-quality.NEIGHBOURS] - quality.TIE
        weight = np.maximum(near[chosen], 0) ** quality.POWER
        assert abs(got[i]["score"] - (weight * model.labels[chosen]).sum() / weight.sum()) < 1e-6
    assert got[900]["score"] == got[901]["score"] == round(model.base, 9)
    assert got[902]["score"] == got[1]["score"]               # a copy scores like its original


def test_voters_are_bounded_and_copies_vote_once(spark):
    rows = [(i, f"text number {i % 900}") for i in range(3000)] + [(9_000 + i, "one hot copy") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, label int")
    chosen = quality.choose_voters(docs, marks, most=300)
    assert 230 < chosen.count() < 370 and chosen.select("text").distinct().count() == chosen.count()
    assert sorted(chosen.collect()) == sorted(quality.choose_voters(docs.repartition(9), marks, most=300).collect())
    everyone = {r["text"]: r["label"] for r in quality.choose_voters(docs, marks).collect()}
    assert len(everyone) == 901 and everyone["one hot copy"] == 0.5


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [(r["score"], r["predicted"]) for r in quality.score_quality(docs, labels).collect()] == [(0.5, 1)]
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    assert [r["score"] for r in quality.score_quality(docs, spark.createDataFrame([(1, 0)], "doc_id bigint, quality int")).collect()] == [0.0]
