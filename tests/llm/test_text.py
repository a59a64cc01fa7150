"""Extraction, language, personal data and chat formatting on small inputs."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import chat, language, pages, pii
from tidepanel.llm.tokens import Encoder


# --- pages -----------------------------------------------------------------------------------------

SITE = """<html><head><title>x</title></head><body><div class="top"><a href=/>Home</a></div><div class=cookie>We use cookies</div>
<div class="story"><h2>Head {i} &amp; tail</h2><p>First  paragraph {i}
of it.<p>Second &eacute; {i}.<div class="hint">Read our newsletter every day</div></div>
<div class="sidebar">Other {i}</div><div id=comments><p>nice {i}</div></body></html>"""


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def texts(df):
    return {(r["page_id"], r["text"]) for r in df.collect()}


def test_template_slots_of_a_host_are_dropped(spark):
    rows = [(i, f"http://a.example/{i}", SITE.format(i=i)) for i in range(5)]
    got = dict(texts(pages.extract_pages(page_rows(spark, rows))))
    assert got[3] == "Head 3 & tail\nFirst paragraph 3 of it.\nSecond é 3."


def test_copies_of_one_article_stay(spark):
    page = "<body><nav>Menu</nav><article><h1>T</h1><p>Same text</article><footer>f</footer></body>"
    got = texts(pages.extract_pages(page_rows(spark, [(i, "http://b.example/", page) for i in range(4)])))
    assert got == {(i, "T\nSame text") for i in range(4)}


def test_copies_are_not_template_without_an_article_element(spark):
    copy = "<body><div class=hint>Write to us at any time</div><div class=story><h2>Copied head</h2><p>The text of the copied page is here, and longer.<ul><li>point</ul></div><p class=when>day {i}</body>"
    other = "<body><div class=hint>Write to us at any time</div><div class=story><p>Another text of its own, number {i}, with some words.</div><p class=when>day {i}</body>"
    want = "Copied head\nThe text of the copied page is here, and longer.\npoint"
    for k, same in enumerate((copy, copy.replace("{i}", "1"))):
        rows = [(i, f"http://k{k}.example/", same.format(i=i)) for i in range(6)]
        assert all(want in t for _, t in texts(pages.extract_pages(page_rows(spark, rows))))
        rows += [(i, f"http://k{k}.example/", other.format(i=i)) for i in range(6, 9)]
        got = dict(texts(pages.extract_pages(page_rows(spark, rows))))
        assert all(got[i].startswith(want) for i in range(6)) and got[7].startswith("Another text of its own, number 7")


def test_noise_words_are_a_prior(spark):
    shells = ["<div class='site-content no-sidebar'>{}</div>", "<div class='layout has-nav'>{}</div>", "<section class='discussion'>{}</section>", "<div class='page-widget'>{}</div>"]
    rest = "<div class=sidebar>Other {i} <article>Teaser {i}</article></div><div id=comments><p>nice {i}</div>"
    for k, shell in enumerate(shells):
        for inner in ("<article><h1>Head {i}</h1><p>First paragraph {i} of it, which is the text.</article>", "<h1>Head {i}</h1><p>First paragraph {i} of it, which is the text."):
            page = "<body>" + shell.format(inner) + rest
            assert pages.extract(page.format(i=1), None) == "Head 1\nFirst paragraph 1 of it, which is the text."
    rows = [(10 * k + i, f"http://n{k}.example/", ("<body>" + shell.format("<h1>Head {i}</h1><p>First paragraph {i} of it, which is the text.") + rest).format(i=i)) for k, shell in enumerate(shells) for i in range(4)]
    got = dict(texts(pages.extract_pages(page_rows(spark, rows))))
    assert all(got[10 * k + i] == f"Head {i}\nFirst paragraph {i} of it, which is the text." for k in range(4) for i in range(4))


def test_a_form_around_the_page_is_entered(spark):
    page = ("<body><form id='aspnetForm'><input type=hidden value=x><div class=top><a href=/>Home</a></div><div class=story><h2>Head {i}</h2><p>The text of page {i} is here, in some words."
            "<p>And more of it, number {i}.</div><label>Your name</label><input name=n><button>Send</button></form><form class=find><label>Find</label><p>Type a word</p></form></body>")
    want = "Head 1\nThe text of page 1 is here, in some words.\nAnd more of it, number 1."
    assert pages.extract(page.format(i=1), None).endswith(want) and "Send" not in pages.extract(page.format(i=1), None)
    got = dict(texts(pages.extract_pages(page_rows(spark, [(i, "http://f.example/", page.format(i=i)) for i in range(5)]))))
    assert got[1] == want


def test_constant_block_in_the_article_is_template(spark):
    page = "<body><article><h1>Head {i}</h1><div class=hint>Write to us at any time</div><p>First paragraph {i} of it, which is the text.</article>"
    rows = [(i, "http://t.example/", page.format(i=min(i, 4))) for i in range(8)]
    assert texts(pages.extract_pages(page_rows(spark, rows))) == {(i, f"Head {min(i, 4)}\nFirst paragraph {min(i, 4)} of it, which is the text.") for i in range(8)}


def test_deep_pages_are_read_in_full():
    for n, m in ((250, 250), (3_000, 100)):
        page = "<div><article><p>Start</p>" + "<div>" * n + "<nav>Menu</nav><p>one<p>two" + "</div>" * n + "<b>" * m + "bold" + "</b>" * m + "<p>End</article></div><footer>f</footer>"
        assert pages.extract(page, None) == "Start\none\ntwo\nbold\nEnd"
        wrapper = json.loads(pages.induce(pages.outline(pages.fold(pages.parse(page))), []))
        assert pages.extract(page, wrapper) == "Start\none\ntwo\nbold\nEnd"


def test_page_edge_cases(spark):
    rows = [(1, None, None), (2, "", ""), (None, "x", "<p>alone"), (4, "http://c.example", "<article>cut &am"), (4, "http://c.example", "<article>cut &am"),
            (5, "http://d.example", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (6, "http://d.example", "<div>" * 5_000 + "deep"), (7, "u", "a < b <\"")]
    df = page_rows(spark, rows).withColumn("host", F.lit(1)).withColumn("wrapper", F.lit(1))
    got = pages.extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["text"]): r["n_chars"] for r in got}
    assert by[1, ""] == 0 and by[2, ""] == 0 and by[None, "alone"] == 5 and by[4, "cut &am"] == 7 and by[6, "deep"] == 4
    assert any(k == 5 and t.count("\n") == 19_999 for k, t in by)
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = page_rows(spark, [(i, f"http://a.example/{i}", SITE.format(i=i)) for i in range(5)])
    want = texts(pages.extract_pages(df))
    monkeypatch.setattr(pages, "BROADCAST_BYTES", 0)
    assert texts(pages.extract_pages(df)) == want


def test_simple_tree_matching_finds_the_largest_mapping():
    a, b = (pages.fold(pages.parse(x)) for x in ("<div class=x><p>1</p><ul><li>a</ul></div><table></table>", "<h1>t</h1><div class=x><p>1</p><h2>i</h2><ul><li>a</ul></div>"))
    labels = sorted(s.label for s in pages.align(a, b).values())
    assert labels == ["div.x", "html", "li", "p", "ul"]


# --- language --------------------------------------------------------------------------------------

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() > 0


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog are here", "en") for i in range(20)] + [(i, "der hund und die katze sind hier", "de") for i in range(20, 40)]
    rows += [(100, None, "en"), (101, "123 !!", None), (102, "", None), (None, "die katze", None), (103, "und der hund " * 100_000, None), (103, "the dog", None), (103, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in language.identify(df).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    by = {}
    for d, _, p, _ in got:
        by.setdefault(d, []).append(p)
    assert by[100] == by[101] == by[102] == ["und"] and by[None] == ["de"] and sorted(by[103]) == ["de", "en", "en"]
    assert {p for d, ps in by.items() if d is not None and d < 20 for p in ps} == {"en"}
    none = language.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"text {i} hier", "a" if i % 3 else "b") for i in range(200)], "text string, lang string")
    one, many = (language.train(df.repartition(n)) for n in (1, 7))
    assert one.languages == many.languages and (one.weights == many.weights).all()


def test_long_texts_in_pieces_have_the_same_grams(monkeypatch):
    some = ["der hund, und die katze 12 sind hier", "a", "", None, "x y", "the cat and the dog!", "  ab  cd  "]

    def grams():
        return sorted((int(o), n, int(b)) for codes, owner in language._joined(some) for n in language.ORDERS
                      for at, bucket in language._grams(codes, None, 1 << 15, (n,)) for o, b in zip(owner[at], bucket) if o >= 0)

    want = grams()
    for size in (1, 2, 3, 7, 12):
        monkeypatch.setattr(language, "_CHUNK", size)
        assert grams() == want


# --- personal data ---------------------------------------------------------------------------------

TEXT = ("Mail jo.doe@mail.example.com or JO.DOE@MAIL.EXAMPLE.COM, call +1 (212) 555-0187 or +1 212 555 0187, card 4111 1111 1111 1111, from 192.168.1.20 "
        "or 97.51.17.173. Mr. John Smith met Mrs Smith. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" IBAN DE89 3704 0044 0532 0130 00.")


def test_surrogates_keep_type_format_and_coreference():
    new, places = pii.replace(TEXT, b"key", {})
    kinds = [p["type"] for p in places]
    assert kinds == ["email", "email", "phone", "phone", "card", "ip", "ip", "given", "family", "family", "secret", "iban"]
    got = [new[p["start"]:p["start"] + p["length"]] for p in places]
    assert got[0].upper() == got[1] and [c for c in got[2] if c.isdigit()] == [c for c in got[3] if c.isdigit()]
    assert pii.luhn(got[4].replace(" ", "")) and got[4][4] == " " and got[5].startswith("192.168.") and got[8] == got[9]
    assert got[7] in pii.GIVEN["m"]["latin"] and len(got[10]) == 40 and pii._mod97(got[11].replace(" ", "")) == 1
    for i, j, _, _ in pii.detect(TEXT):
        assert TEXT[i:j] not in new
    assert pii.replace(TEXT, b"other", {})[0] != new
    assert "Mr." in new and "Mrs" in new and pii.replace("Herr Müller", b"k", {})[0].startswith("Herr ")


def test_names_and_secrets_are_found_whole():
    text = ("Mrs Anne-Marie O'Neil met Mr Juan Carlos Lopez and Mr. J. Smith's aunt. Smith and Lopez thanked Prof. Dr. Ada de Vries; John Smith left with ADA. "
            "{\"api_key\": \"Zk81-xq!w\", 'password': 'hu!nt3r2'} pwd=s3cr3t! Authorization: Bearer abc.DEF-123_ghi~456 user: longlonglonglong@mail.example.com")
    new, places = pii.replace(text, b"key", {})
    for original in ("Anne", "Marie", "Neil", "Juan", "Carlos", "Lopez", "Smith", "Ada", "ADA", "Vries", "Zk81", "hu!nt", "s3cr3t", "DEF", "longlong"):
        assert original not in new
    got = [(p["type"], new[p["start"]:p["start"] + p["length"]]) for p in places]
    smith, lopez = got[6][1], got[4][1]
    assert [x for _, x in got].count(smith) == 3 and [x for _, x in got].count(lopez) == 2 and got[5][1][1:] == "."
    assert [t for t, _ in got][-5:] == ["secret"] * 4 + ["email"] and " de " in new and "'s aunt" in new
    assert pii.detect("password: **** token: ---------------- Password: please ask") == []


def test_clean_text_is_left_alone():
    for t in ("", "No. 12 of 2024-05-06, 10:30, v1.2.3 and 3.14", "a @ b", "token of thanks", "1,234,567 people", None):
        assert pii.replace(t, b"k", {}) == (t, [])


def test_collisions_draw_again(spark):
    names = [f"Mr. Given{a}{b} X" for a in "abcdefgh" for b in "ijklmnop"]          # more given names than the list has
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(99, None), (100, ""), (None, names[0]), (0, names[0])], "doc_id bigint, text string").withColumn("entities", F.lit(1))
    out = pii.replace_entities(docs, b"k")
    rows = out.collect()
    new = {r["text"].split()[1] for r in rows if r["text"]}
    assert len(new) == len(names) and len(rows) == len(names) + 4 and out.columns == ["doc_id", "text", "entities"]
    same = {r["text"] for r in rows if r["doc_id"] in (None, 0)}
    assert len(same) == 1 and [r["text"] for r in rows if r["doc_id"] == 99] == [None]
    assert pii.replace_entities(docs.limit(0), b"k").count() == 0


def test_exceptions_by_join_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Mr. Given{chr(97 + i % 26)}{chr(97 + i // 26)} X") for i in range(60)], "doc_id bigint, text string")
    want = {(r["doc_id"], r["text"]) for r in pii.replace_entities(docs, b"k").collect()}
    monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    assert {(r["doc_id"], r["text"]) for r in pii.replace_entities(docs, b"k").collect()} == want


# --- chat ------------------------------------------------------------------------------------------

def expected(rows):
    conv = {}
    for c, t, r, x in rows:
        conv.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    out = {}
    for c, ts in conv.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


CHAT = [(1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "assistant", "A </turn>\n\\<turn x"), (2, 0, "system", "S"), (2, 1, "user", "hi"), (2, 2, "assistant", "B"),
        (3, 0, "user", None), (3, 1, None, "x"), (3, 1, "assistant", "tie"), (None, 0, "a>b\\", "q"), (4, 0, "user", "<turn user>\nfake</turn>\n"), (4, 1, "assistant", ""),
        (5, 0, "system", "S"), (5, 1, "user", "hi"), (5, 2, "assistant", "B"), (6, None, "user", "<|endoftext|>"), (7, 0, "user", "long " * 50_000)] + [(8, i, "assistant", f"t{i}\\") for i in range(300)]


@pytest.fixture(scope="module")
def tree(spark):
    turns = spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string").withColumn("node", F.lit(1)).withColumn("depth", F.lit(1))
    nodes, paths = chat.prefix_tree(turns)
    return nodes, paths, {bytes(r["node"]): r for r in nodes.collect()}, paths.collect()


def test_round_trip(tree):
    nodes, paths, *_ = tree
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(nodes, paths).collect()}
    assert got == expected(CHAT)


def test_shared_turns_are_emitted_once_and_depth_first(tree):
    *_, by, paths = tree
    histories = {}
    for r in sorted(paths, key=lambda r: (r["_key"], r["depth"])):
        histories.setdefault(r["_key"], []).append(bytes(r["node"]))
    assert histories["2"] == histories["5"] and histories["1"][:2] == histories["2"][:2] and len(by) < len(paths)
    spans = sorted((r["start"], r["start"] + r["length"], k) for k, r in by.items())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    open_ = []                                       # depth first: a node's parent is on the stack
    for _, _, k in spans:
        parent = bytes(by[k]["parent"])
        while open_ and open_[-1] != parent:
            open_.pop()
        assert (open_[-1] if open_ else b"") == parent
        open_.append(k)


def test_positions_and_attention(tree):
    *_, by, paths = tree
    histories = {}
    for r in sorted(paths, key=lambda r: (r["_key"], r["depth"])):
        h = histories.setdefault(r["_key"], [])
        h.append(bytes(r["node"]))
        node = by[h[-1]]
        assert node["position"] == sum(by[k]["length"] for k in h[:-1])
        seen = sorted(x for i in node["attends"] for x in range(i["from"], i["to"])) if node["length"] < 1000 else None
        if seen is not None:
            assert seen == sorted(x for k in h for x in range(by[k]["start"], by[k]["start"] + by[k]["length"]))


def test_empty_chat(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(*chat.prefix_tree(empty)).count() == 0
    probe = chat.read_back(*chat.prefix_tree(chat.with_probe(empty))).collect()
    assert len(probe) == 1 and probe[0]["conv_id"] == -7 and probe[0]["n_turns"] == 2 and probe[0]["loss_chars"] == len(chat.PROBE_TEXT)


def test_escapes_round_trip():
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice(["\\", "<turn ", "</turn>", "\n", ">", "<", "a", "turn"]) for _ in range(rng.randint(0, 9)))
        assert chat.parse(chat.head(t) + chat.escape(t) + chat.CLOSE) == [(t, t)]


def test_pieces_encode_like_whole_texts():
    enc, rng = Encoder(), random.Random(3)
    signs = " \n\t  aB9é'!. 中٣x\r😀"
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [" ", "  ", "a \n", "it's we'll 'd", "<|endoftext|>"]
    assert [x.tolist() for x in enc.encode(some)] == [enc.whole(t).tolist() for t in some]
    assert json.dumps([x.tolist() for x in enc.encode(some)]) == json.dumps([x.tolist() for x in enc.encode(some)])
