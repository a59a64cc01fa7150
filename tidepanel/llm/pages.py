"""Main-text extraction by wrapper induction: DOM trees of a host's pages are aligned by simple tree matching."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import small_batches, stored

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt rtc s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
#: An opening tag of the right ends the open elements of the left that it cannot be part of.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody"}
LIMITS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "option": "select"}
NOISE_TAGS = frozenset("nav aside footer label script style noscript template iframe object embed svg canvas button select option input textarea menu dialog head title "
                       "link meta applet map audio video xmp noembed noframes datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist note".split())
NOISE_WORDS = frozenset("ad ads adsbygoogle adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar nav navbar navigation menu breadcrumb "
                        "breadcrumbs header masthead footer cookie cookies consent notice notices alert popup modal newsletter subscribe signup login comment comments disqus "
                        "discussion feedback respond reply replies share sharing social related recommended pagination pager toolbar topbar sidenav rail widget gdpr skip "
                        "copyright colophon".split())
CONTENT_WORDS = frozenset("article post entry content main story body text".split())
ROOMS = ("article", "main")
#: A class of this form tells of a state, not of the element: no-sidebar, has-nav, withMenu.
_STATE = re.compile(r"(?:no|not|non|has|have|with|without|is|show|hide|hides|enable|enabled|disable|disabled)(?:[-_]|(?=[A-Z]))")

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("tag", "label", "noise", "doubtful", "children")

    def __init__(self, tag: str, label: str = "", noise: bool = False, doubtful: bool = False):
        self.tag, self.label, self.noise, self.doubtful, self.children = tag, label or tag, noise, doubtful, []


def _element(tag: str, attributes: str, inside: bool) -> Node:
    """A node with its label (tag, id and classes) and whether its role is not content; ``inside``: of an article.

    It is doubtful if only its id or classes say so: their words are a prior, which ``choose_room`` may overrule.  So is
    a form, which may wrap the whole page; its controls and their labels are not content in any case.
    """
    noise = tag in NOISE_TAGS or (tag == "header" and not inside)
    if "=" not in attributes and "hidden" not in attributes:
        return Node(tag, tag, noise, tag == "form")
    at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = " ".join(html.unescape(at.get(k, "")) for k in ("id", "class"))
    words = {w.lower() for t in names.split() if not _STATE.match(t) for w in _WORDS.findall(t)}
    bad = words & NOISE_WORDS
    if words & CONTENT_WORDS:
        bad -= {"header"}                        # the heading of an article
    if tag in ("body", "html", *ROOMS):
        bad = set()
    hidden = "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", ""))
    noise = noise or bool(hidden) or at.get("role", "").lower() in NOISE_ROLES
    label = tag + "".join(f".{w}" for w in sorted(set(re.sub(r"\d+", "", names).split())))
    return Node(tag, "main" if at.get("role") == "main" and tag not in ROOMS else label, noise, (bool(bad) or tag == "form") and not noise)


class _Open(list):
    """The open elements of a page, of any depth, with their number by tag."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.n: Counter[str] = Counter()

    def open(self, node: Node) -> None:
        self.append(node)
        self.n[node.tag] += 1

    def close(self, k: int) -> None:
        for x in self[k:]:
            self.n[x.tag] -= 1
        del self[k:]

    def end(self, tags: tuple[str, ...], limits: tuple[str, ...] = ()) -> None:
        """Close the innermost element of ``tags`` that is not beyond one of ``limits``."""
        if not any(self.n[t] for t in tags):
            return
        for k in range(len(self) - 1, 0, -1):
            if self[k].tag in tags:
                return self.close(k)
            if self[k].tag in limits:
                return


def parse(page: str) -> Node:
    """A forgiving DOM: unclosed elements end where they must, stray end tags are ignored."""
    root = Node("html")
    stack = _Open(root)
    at, end = 0, len(page)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            stack.end((tag,))
            continue
        if tag == "html":
            continue
        if tag in ENDS_P:
            stack.end(("p",), ("table",))
        if tag in ENDS:
            stack.end(tuple(ENDS[tag].split()), tuple(LIMITS.get(tag, "table").split()))
        if tag == "body" and stack.n["head"]:
            stack.close(1)
        node = _element(tag, attributes, any(stack.n[t] for t in ROOMS))
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not attributes.endswith("/"):
            stack.open(node)
    return root


# --- skeletons and their alignment -----------------------------------------------------------------

class Slot:
    """A run of neighbouring elements with one label; inline elements belong to the text around them."""

    __slots__ = ("label", "tag", "noise", "doubtful", "members", "children", "text", "links")

    def __init__(self, label: str, tag: str, noise: bool, doubtful: bool = False):
        self.label, self.tag, self.noise, self.doubtful = label, tag, noise, doubtful
        self.members, self.children, self.text, self.links = [], [], [], 0


def _own_text(node: Node) -> Iterator[tuple[str, bool]]:
    todo: list = [(c, False) for c in reversed(node.children)]
    while todo:
        c, linked = todo.pop()
        if isinstance(c, str):
            yield c, linked
        elif c.tag in INLINE and not (c.noise or c.doubtful):
            linked = linked or c.tag == "a"
            todo += [(x, linked) for x in reversed(c.children)]


def _blocks_in(node: Node) -> Iterator[Node]:
    """Block elements below a node, those inside inline elements included."""
    todo: list = node.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            continue
        if c.tag in INLINE and not (c.noise or c.doubtful):
            todo += reversed(c.children)
        else:
            yield c


def fold(root: Node) -> Slot:
    top = Slot(root.label, root.tag, root.noise)
    todo = [(top, [root])]
    while todo:
        slot, members = todo.pop()
        slot.members = members
        if slot.noise:
            continue
        runs: list[tuple[Slot, list[Node]]] = []
        for m in members:
            for s, linked in _own_text(m):
                slot.text.append(s)
                slot.links += len(s.strip()) if linked else 0
            for c in _blocks_in(m):
                if runs and (runs[-1][0].label, runs[-1][0].noise, runs[-1][0].doubtful) == (c.label, c.noise, c.doubtful):
                    runs[-1][1].append(c)
                else:
                    runs.append((Slot(c.label, c.tag, c.noise, c.doubtful), [c]))
        slot.children = [s for s, _ in runs]
        todo += runs
    return top


def preorder(top: Slot) -> list[tuple[int, Slot]]:
    out, todo = [], [(0, top)]
    while todo:
        depth, s = todo.pop()
        out.append((depth, s))
        todo += [(depth + 1, c) for c in reversed(s.children)]
    return out


def outline(top: Slot) -> str:
    """The skeleton as text: depth and label of every slot."""
    return json.dumps([[d, s.label, s.tag, s.noise + 2 * s.doubtful] for d, s in preorder(top)], separators=(",", ":"))


def from_outline(text: str) -> Slot:
    path: list[Slot] = []
    for d, label, tag, noise in json.loads(text):
        s = Slot(label, tag, noise == 1, noise == 2)
        if d:
            path[d - 1].children.append(s)
        path[d:] = [s]
    return path[0]


def align(a: Slot, b: Slot) -> dict[int, Slot]:
    """Simple tree matching: the largest order-keeping mapping of equal labels, roots first: id(slot of a) -> slot of b."""
    pairs = [(a, b)] if a.label == b.label else []
    for x, y in pairs:                               # grows while it is read; a pair comes before the pairs below it
        pairs += [(p, q) for p in x.children for q in y.children if p.label == q.label]
    weights: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list] = {}
    for x, y in reversed(pairs):
        n, m = len(x.children), len(y.children)
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                w = weights.get((id(x.children[i - 1]), id(y.children[j - 1])), 0)
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + w)
        weights[id(x), id(y)], tables[id(x), id(y)] = table[n][m] + 1, table

    out: dict[int, Slot] = {}
    todo = pairs[:1]
    while todo:
        x, y = todo.pop()
        out[id(x)] = y
        table = tables[id(x), id(y)]
        i, j = len(x.children), len(y.children)
        while i and j:
            p, q = x.children[i - 1], y.children[j - 1]
            w = weights.get((id(p), id(q)), 0)
            if w and table[i][j] == table[i - 1][j - 1] + w:
                todo.append((p, q))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


# --- wrappers --------------------------------------------------------------------------------------

def choose_room(top: Slot, mass: dict[int, float]) -> tuple[Slot, set[int]]:
    """The slot that holds the main text, and the ids of doubtful slots that are entered after all.

    The room is the article or main element with the most text, else the deepest slot that still holds three fifths of the varying
    text. Noise is never entered; a doubtful slot is if three fifths of the text are in it, or if it holds an article or
    main element with as much text as all outside, and such elements outside have less than a fifth of that.
    """
    whole: dict[int, float] = {}
    total: dict[int, float] = {}
    above: dict[int, Slot] = {}
    order = [s for _, s in preorder(top) if not s.noise]
    for s in reversed(order):
        whole[id(s)] = mass.get(id(s), 0.0) + sum(whole[id(c)] for c in s.children if not c.noise)
        above.update((id(c), s) for c in s.children)
    kept = {id(s) for s in order if s.doubtful and whole[id(s)] > 0 and whole[id(s)] >= 0.6 * whole[id(top)]}

    def closed(s: Slot) -> list[Slot]:
        out = []
        while s is not top:
            out += [s] if s.doubtful and id(s) not in kept else []
            s = above[id(s)]
        return out

    for s in reversed(order):
        total[id(s)] = mass.get(id(s), 0.0) + sum(total[id(c)] for c in s.children if not c.noise and (not c.doubtful or id(c) in kept))
    for tag in ROOMS:
        rooms = [s for s in order if (s.tag == tag or s.label == tag) and whole[id(s)] > 0]
        inner = [s for s in rooms if not closed(s)]
        best = max(rooms, key=lambda s: whole[id(s)], default=None)
        if inner and whole[id(most := max(inner, key=lambda s: whole[id(s)]))] >= 0.2 * whole[id(best)]:
            return most, kept
        if best and (not closed(best) or whole[id(best)] >= total[id(top)]):
            return best, kept | {id(s) for s in closed(best)}
    s = top
    while True:
        deeper = max((c for c in s.children if not c.noise and (not c.doubtful or id(c) in kept)), key=lambda c: total[id(c)], default=None)
        if deeper is None or total[id(deeper)] <= 0.6 * total[id(s)] or mass.get(id(deeper), 0.0) > 0.4 * total[id(deeper)]:
            return s, kept
        s = deeper


def open_slots(top: Slot, kept: set[int]) -> list[Slot]:
    """Slots outside noise and outside doubtful slots that are not entered."""
    out, todo = [], [top]
    while todo:
        s = todo.pop()
        if not s.noise and (not s.doubtful or id(s) in kept):
            out.append(s)
            todo += s.children
    return out


def page_mass(top: Slot) -> dict[int, float]:
    """Text of every slot that is not mostly links."""
    out = {}
    for _, s in preorder(top):
        n = len("".join(s.text).strip())
        out[id(s)] = float(n) if s.links * 2 <= n else 0.0
    return out


#: Pages of a host are copies of each other, as far as can be told, if less than this share of their text varies.
LEAST_VARYING = 0.2


def induce(seed: str, stats: list) -> str:
    """Wrapper of a host: the seed's outline, the slot that holds the main text, and the template slots within it.

    A slot is template if pages of at least three different texts have it with one and the same text (``kinds``: how many
    texts), in an article or main element too. Where hardly any text varies, the pages are copies of one article, and
    all of it is content.
    """
    top = from_outline(seed)
    order = [s for _, s in preorder(top)]
    by = {r["slot"]: r for r in stats}
    shown = {id(s) for s in open_slots(top, choose_room(top, {id(order[k]): float(r["mass"]) for k, r in by.items()})[1])}
    told = [r for k, r in by.items() if id(order[k]) in shown]
    varying = sum(r["mass"] for r in told if r["low"] != r["high"])
    fixed = {k for k, r in by.items() if r["kinds"] >= 3 and r["low"] == r["high"]}
    if varying < LEAST_VARYING * sum(r["mass"] for r in told):
        fixed = set()
    mass = {id(order[k]): float(r["mass"]) for k, r in by.items() if k not in fixed}
    if not any(mass.values()):
        mass, fixed = {id(order[k]): float(r["mass"]) for k, r in by.items()}, set()
    room, kept = choose_room(top, mass)
    kept = [k for k, s in enumerate(order) if id(s) in kept]
    return json.dumps({"seed": json.loads(seed), "room": order.index(room), "kept": kept, "fixed": sorted(fixed)}, separators=(",", ":"))


def _flow(node: Node, skip: set[int], kept: set[int], out: list, line: list) -> None:
    """Blocks of a subtree in page order, into ``out``; ``line`` collects the block that is being read."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append("".join(line))
            line.clear()
        elif isinstance(x, str):
            line.append(x)
        elif x.noise or id(x) in skip or (x.doubtful and id(x) not in kept):
            continue
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.children)
        else:
            todo += [None, *reversed(x.children), None]


def extract(page: str | None, wrapper: dict | None, seed: Slot | None = None) -> str:
    """Main text of a page by its host's wrapper, or by the page alone where there is none or it does not fit."""
    if not page:
        return ""
    top = fold(parse(page))
    room, skip, kept = None, set(), set()
    if wrapper:
        seed = seed or from_outline(json.dumps(wrapper["seed"]))
        number = {id(s): k for k, (_, s) in enumerate(preorder(seed))}
        fixed, entered = set(wrapper["fixed"]), set(wrapper["kept"])
        mapping = align(top, seed)
        for _, s in preorder(top):
            k = number.get(id(mapping[id(s)])) if id(s) in mapping else None
            if k == wrapper["room"]:
                room = s
            if k in fixed:
                skip |= {id(m) for m in s.members}
            if k in entered:
                kept |= {id(m) for m in s.members}
    if room is None:
        skip = set()
        room, slots = choose_room(top, page_mass(top))
        kept = {id(m) for _, s in preorder(top) if id(s) in slots for m in s.members}
    out: list[str] = []
    line: list[str] = []
    for m in room.members:
        _flow(m, skip, kept, out, line)
    out.append("".join(line))
    return "\n".join(t for t in (" ".join(b.split()) for b in out) if t)


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _lead(text: str) -> tuple[int, int]:
    """Length and hash of the longest sentence: near copies share it, though a date or a line differs."""
    best = max((" ".join(x.split()) for x in re.split(r"[.!?]", text)), key=lambda x: (len(x), x))
    return len(best), _hash(best)


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        tops = [fold(parse(h)) for h in b["html"]]
        leads = [max((_lead("".join(s.text)) for s in open_slots(t, choose_room(t, page_mass(t))[1]) if s.text), default=(0, 0))[1] for t in tops]
        yield pd.DataFrame({"host": b["host"], "content": b["html"].map(_hash), "lead": leads, "outline": [outline(t) for t in tops]})


SLOTS = "array<struct<slot:int,hash:bigint,mass:double,size:int,lead:bigint>>"


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The seed's slots as each page of a batch has them; pages of one content once a batch."""
    seeds: dict[str, tuple[Slot, dict]] = {}
    for b in batches:
        seen: dict[tuple[str, int], list] = {}
        for host, seed, page in zip(b["host"], b["seed"], b["html"]):
            if (host, content := _hash(page)) in seen:
                continue
            if seed not in seeds:
                seeds.clear() if len(seeds) > 1000 else None
                top = from_outline(seed)
                seeds[seed] = top, {id(s): k for k, (_, s) in enumerate(preorder(top))}
            target, number = seeds[seed]
            top = fold(parse(page))
            mass = page_mass(top)
            mapping = align(top, target)
            shown = {id(s) for s in open_slots(top, choose_room(top, mass)[1])}
            slots = seen[host, content] = []
            for _, s in preorder(top):
                text = "".join(s.text)
                if id(s) in mapping and text.strip():
                    size, lead = _lead(text) if id(s) in shown else (0, 0)
                    slots.append({"slot": number[id(mapping[id(s)])], "hash": _hash(text), "mass": mass[id(s)], "size": size, "lead": lead})
        yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["host", "content", "slots"])


#: Largest total of seeds or wrappers that is broadcast; beyond, they are joined by host and salt.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def by_host(pages: DataFrame, one: DataFrame, column: str, salt: tuple = ("page_id", "url")) -> DataFrame:
    """Pages with their host's ``column``: by broadcast where all of it is small, else by a salted join.

    In the salted join every host's row is repeated SALTS times, so a host with a third of all pages is spread.
    """
    size = one.agg(F.coalesce(F.sum(F.length(column) + F.length("host") + 32), F.lit(0))).first()[0]
    right = one.select(F.col("host").alias("_host"), column)
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(right), F.col("host") == F.col("_host"), "left").drop("_host")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = pages.withColumn("_mine", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    return own.join(salted, (F.col("host") == F.col("_host")) & (F.col("_mine") == F.col("_salt")), "left").drop("_host", "_salt", "_mine")


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper. The seed of a host is the outline that the most different texts have; slot statistics are over
    the different contents of the host's pages: copies count once, and near copies (pages that share the longest
    sentence of the slots that vary in the host) are one kind."""
    whole = pages.where("html is not null").select(host_of(F.col("url")).alias("host"), F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    found = whole.select("host", "html").mapInPandas(_outlines, "host string, content bigint, lead bigint, outline string")
    counted = found.groupBy("host", "outline").agg(F.approx_count_distinct("lead").alias("leads"), F.approx_count_distinct("content").alias("n"))
    seeds = stored(counted.groupBy("host").agg(F.max(F.struct("leads", "n", "outline"))["outline"].alias("seed")), "seeds")
    slots = by_host(whole, seeds, "seed").select("host", "seed", "html").mapInPandas(_slots, f"host string, content bigint, slots {SLOTS}")
    slots = stored(slots.dropDuplicates(["host", "content"]), "slots")
    total = stored(slots.select("host", F.inline("slots")).groupBy("host", "slot").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("mass").alias("mass")), "totals")
    varying = total.where("low <> high").groupBy("host").agg(F.concat_ws(",", F.sort_array(F.collect_list("slot"))).alias("varying"))
    kind = F.expr("array_max(transform(filter(slots, x -> x.mass > 0 and x.size > 0 and array_contains(split(varying, ','), cast(x.slot as string))), x -> struct(x.size, x.lead))).lead")
    kinds = (by_host(slots, varying, "varying", ("content",)).withColumn("kind", kind).select("host", "kind", F.inline("slots"))
             .groupBy(F.col("host").alias("_h"), F.col("slot").alias("_s")).agg(F.countDistinct("kind").alias("kinds")))
    # a host has at most as many rows as its seed has slots
    lists = (total.join(kinds, (F.col("host") == F.col("_h")) & (F.col("slot") == F.col("_s")))
             .groupBy("_h").agg(F.collect_list(F.struct("slot", "kinds", "low", "high", "mass")).alias("stats")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "wrapper": [induce(s, t if t is not None else []) for s, t in zip(b["seed"], b["stats"])]})

    return stored(seeds.join(lists, F.col("host") == F.col("_h"), "left").select("host", "seed", "stats").mapInPandas(run, "host string, wrapper string"), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars; all rows, also repeated ones.

    A null or empty html gives an empty text; a page with a null url belongs to the host without a name; a host
    with a single page, or a page that does not fit its host's wrapper, is judged by its own elements. Character
    references are decoded, white space within a block becomes one space, blocks are joined by a line feed. Other
    columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    @F.pandas_udf("string")
    def run(html_: pd.Series, wrapper: pd.Series) -> pd.Series:
        known: dict[str, tuple[dict, Slot]] = {}
        out = []
        for page, w in zip(html_, wrapper):
            if w is not None and w not in known:
                d = json.loads(w)
                known[w] = d, from_outline(json.dumps(d["seed"]))
            out.append(extract(page, *(known[w] if w is not None else (None, None))))
        return pd.Series(out, dtype=object)

    out = by_host(rows, wrappers(pages), "wrapper").withColumn("text", run.asNondeterministic()("html", "wrapper"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
