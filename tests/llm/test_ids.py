"""Ids that only name what is found (null, negative, shared), formats that are used up, meetings of a bucket's blocks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_rows import Classes, brute_classes, shingles
from tidepanel.llm import nearduplicates, pii, vectors

KEY = b"some key"


# --- near-duplicates -------------------------------------------------------------------------------

def base_text(seed, n=120):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def variant(words, k, mark):
    return " ".join([*words[:k], mark, *words[k + 1:]])


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    return {(r["doc_id"], r["component_id"], r["kept"]) for r in nearduplicates.near_duplicates(df).collect()}


def test_negative_ids_name_their_component(spark):
    one, two = base_text(1), base_text(2)
    rows = [(-5, " ".join(one)), (5, " ".join(one)), (8, variant(one, 3, "x")), (9, variant(one, 60, "y")), (-7, " ".join(two)), (-6, variant(two, 5, "z")), (3, "alone")]
    assert found(spark, rows) == {(-5, -5, True), (5, -5, False), (8, -5, False), (9, -5, False), (-7, -7, True), (-6, -7, False), (3, 3, True)}


def test_an_id_of_several_texts_is_one_document(spark):
    one, two = base_text(3), base_text(4)
    rows = [(5, " ".join(one)), (5, " ".join(two)), (8, variant(one, 3, "x")), (7, variant(two, 4, "y")), (9, variant(two, 90, "z")), (1, "alone"), (5, None)]
    assert found(spark, rows) == {(5, 5, True), (8, 5, False), (7, 5, False), (9, 5, False), (1, 1, True)}


def test_null_ids_link_but_never_name(spark):
    one, two = base_text(5), base_text(6)
    rows = [(None, " ".join(one)), (4, variant(one, 3, "x")), (3, variant(one, 70, "y")), (None, " ".join(two)), (None, variant(two, 8, "z"))]
    assert found(spark, rows) == {(None, 3, False), (4, 3, False), (3, 3, True), (None, None, False)}


def test_one_of_each_group_with_odd_ids(spark):
    one, two = base_text(7), base_text(8)
    rows = [(-2, " ".join(one)), (6, variant(one, 3, "x")), (5, " ".join(two)), (5, variant(two, 3, "x")), (9, variant(two, 70, "x")), (None, "only a null id here"), (None, "only a null id here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in nearduplicates.one_of_each(df).collect())
    assert kept == [(False, -2), (False, 5), (True, 0)]


@pytest.mark.parametrize("block", [256, 4])
def test_outsiders_of_a_bucket_meet_its_largest_component(spark, monkeypatch, block):
    """A large group of near copies, some of which are only near others than the smallest, and a few outsiders."""
    monkeypatch.setattr(nearduplicates, "BLOCK", block)
    rng = random.Random(9)
    words = base_text(9, 60)
    rows = []
    for i in range(90):
        w = list(words)
        for k in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"n{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    want = brute_classes(rows)
    assert {(i, c, c == i) for i, (c, _) in want.items()} == found(spark, rows) and len({c for c, _ in want.values()}) > 3


def test_meeting_rows_grow_with_the_outsiders(spark, monkeypatch):
    monkeypatch.setattr(nearduplicates, "BLOCK", 4)
    inside = [(1, 0, i, 50, 7, b"", 1 + i % 25, 1, 25) for i in range(100)]
    left = spark.createDataFrame([*inside, (1, 0, 900, 50, 8, b"", 0, 1, 25)], "key bigint, band int, id bigint, n bigint, part bigint, regs binary, block int, outer int, inner int")
    met = nearduplicates.in_blocks(left, lambda batches: batches, "key bigint, band int, i int, j int, block int, id bigint, n bigint, part bigint, regs binary").collect()
    assert len(met) == 100 + 26                        # each member once, the outsider once per block
    assert {(r["i"], r["j"]) for r in met if r["id"] == 900} == {(0, j) for j in range(26)}


# --- vectors ---------------------------------------------------------------------------------------

def test_a_null_id_leaves_its_class_its_name(spark):
    v = [1.0, 0.0, 0.1]
    rows = [(None, v, 1), (3, [1.0, 0.01, 0.1], 1), (4, [1.0, 0.0, 0.12], 1), (None, [0.0, 1.0, 0.0], 1), (None, [0.0, 1.0, 0.01], 1), (-9, [0.0, 0.0, 1.0], 1), (2, [0.0, 0.01, 1.0], 1), (2, v, 2)]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == sorted([("None", 2, "None", False), ("3", 2, "3", True), ("4", 2, "3", False), ("None", 1, "None", False), ("None", 1, "None", False),
                          ("-9", 1, "-9", True), ("2", 1, "-9", False), ("2", 0, "2", True)])


# --- surrogates ------------------------------------------------------------------------------------

def replaced(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    return [r["text"] for r in pii.replace_entities(df, KEY).orderBy("doc_id").collect()]


def test_a_full_format_ends_and_stays_distinct(spark):
    addresses = [f"192.168.{a}.{b}" for a in range(10) for b in range(10)]
    pins = [f"password = '{i:04d}'" for i in range(0, 10_000, 3)]
    texts = [f"Host {a} is up." for a in addresses] + pins + ["Host 192.168.3.4 again, and 10.20.30.40."]
    got = replaced(spark, texts)
    new = [re.search(r"[\d.]*\d", t)[0] for t in got[:100]]
    assert sorted(new) == sorted(addresses) and all(a != b for a, b in zip(addresses, new))
    pin = [re.search(r"'(.*)'", t)[1] for t in got[100:-1]]
    assert len(set(pin)) == len(pins) and all(re.fullmatch(r"\d{4}", p) for p in pin) and all(f"'{p}'" not in q for p, q in zip(pin, pins))
    assert new[34] in got[-1] and "10.20.30.40" not in got[-1]


def test_permuted_formats_are_one_cycle():
    for kind, values in (("ip", [f"10.{a}.{b}.{c}" for a in range(10) for b in range(10) for c in range(10)]), ("secret", [f"{i:03x}" for i in range(4096) if not f"{i:03x}".isdigit()]),
                         ("secret", [f"{i:03d}" for i in range(1000)]), ("family", [chr(i) for i in range(0x5c40, 0x5c80)])):
        new = [pii.surrogate(KEY, kind, v, pii.PERMUTED) for v in values]
        assert sorted(new) == sorted(values) and all(a != b for a, b in zip(values, new))
        assert new != [pii.surrogate(b"other", kind, v, pii.PERMUTED) for v in values]


@pytest.mark.parametrize("kind,normal", [("email", "joe.b1@ex.com"), ("phone", "15551234567"), ("card", "4111111111111111"), ("card", "4111111111111112"), ("iban", "DE89370400440532013000"),
                                         ("ip", "240.1.1.1"), ("ip", "007.1.2.3"), ("ip", "8.8.8.8"), ("secret", "Ab3$zz"), ("secret", "sk-abcdefgh1234567890ABCD"), ("secret", "90a1"), ("ssn", "123456789")])
def test_surrogates_have_the_format_of_their_entity(kind, normal):
    for attempt in (0, 1, 9, pii.PERMUTED):
        new = pii.surrogate(KEY, kind, normal, attempt)
        assert pii.format_of(kind, new) == pii.format_of(kind, normal) and len(new) == len(normal)
        if kind == "card":
            assert pii.luhn(new) == pii.luhn(normal)
        if kind == "iban":
            assert pii._mod97(new) == 1


def test_the_name_space_grows_with_the_attempts():
    names = [{pii.surrogate(KEY, k, n, a) for a in range(200)} for k, n in (("family", "smith"), ("given_f", "anna"))]
    assert all(len(x) > 190 for x in names)
