"""Personal data: detected entities get keyed surrogates of their own type, format, script and gender."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import small_batches, stored

# Titles and given names by gender, in Latin and Cyrillic script.
TITLES = {"m": "Mr Herr Monsieur Señor господин", "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora госпожа", "n": "Dr Doctor Prof Professor доктор профессор"}
GIVEN = {
    "m": {"latin": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karim Leo Martin Noah Oscar Paul Robin Simon Tomas Viktor".split(),
          "cyrillic": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split()},
    "f": {"latin": "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
          "cyrillic": "Анна Вера Галина Дарья Елена Жанна Ирина Клара Лидия Мария".split()},
    "n": {"latin": "Alexis Ariel Ashley Blair Cameron Casey Charlie Dana Devon Jamie Jordan Kim Morgan Riley Sasha Taylor".split(), "cyrillic": "Саша Женя Валя Шура".split()},
}
#: Letters of a script, by which a letter is replaced by another of its kind.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåçèéêëìíîïñòóôõöùúûüýæøœß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_VOWELS, _CONSONANTS = {"latin": "aeiou", "cyrillic": "аеиоу"}, {"latin": "bdfgklmnprstv", "cyrillic": "бвгдклмнпрст"}
_KIND = {c: a for a in ALPHABETS for c in a}

_UPPER = "".join(c for c in map(chr, range(0x10000)) if c.isupper())
#: A name's word after its first letter: letters, hyphens and apostrophes inside, no possessive.
_JOINT = r"(?:(?:-|['’](?!s(?!\w)))[^\W\d_]+)"
_REST = rf"(?:[^\W\d_]+{_JOINT}*|{_JOINT}+)"
_PARTICLES = "van von der den de la le du di da del bin ibn al y"

_TEXT = r"""
  (?P<secret>(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)["']?\s{0,4}[=:]\s{0,4}(?:"(?P<v1>[^"\s]{4,})"|'(?P<v2>[^'\s]{4,})'
     |["']?(?P<v3>(?=[^\s"'<>,;]*[0-9!@\#$%^&*?~])[^\s"'<>,;]{6,}|[A-Za-z0-9_+/-]{16,}={0,2}))|(?<!\w)Bearer[ ]{1,4}(?P<v4>[A-Za-z0-9._~+/-]{16,}={0,2})|(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})(?!\w))
 |(?P<email>(?<![\w.+-])[\w.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))
 |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
 |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))
 |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
 |(?P<card>(?<![\w.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\w))
 |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w))
 |(?P<name>(?<!\w)(?:(?:(?P<m>TITLES_M)|(?P<f>TITLES_F)|(?:TITLES_N))\.?[ ]{1,2})+
     (?P<full>(?:[UPPER]\.[ ]{0,2})*[^\W\d_a-zß-ÿ]REST(?:[ ]{1,2}(?:[UPPER]\.[ ]{0,2})*(?:(?:PARTICLES)[ ]{1,2})*(?!(?:TITLES_ALL)(?!\w))[UPPER]REST)*))
"""
for _k, _v in (("TITLES_M", TITLES["m"]), ("TITLES_F", TITLES["f"]), ("TITLES_N", TITLES["n"]), ("TITLES_ALL", " ".join(TITLES.values())), ("PARTICLES", _PARTICLES)):
    _TEXT = _TEXT.replace(_k, _v.replace(" ", "|"))
_PATTERN = re.compile(_TEXT.replace("UPPER", _UPPER).replace("REST", _REST), re.X)
_NAME_WORDS = re.compile(rf"[^\W\d_]\.|[^\W\d_]{_REST}")
_HINT = re.compile(r"[0-9@]")
_TITLES = tuple(" ".join(TITLES.values()).split())


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _lower(s: str) -> str:
    """Lower case, letter by letter, so that lengths stay."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of every entity, in order; given and family names are entities of their own."""
    if not text or not (_HINT.search(text) or any(t in text for t in _TITLES) or any(t in text for t in ("=", ":", "Bearer"))):
        return []
    out = []
    for m in _PATTERN.finditer(text):
        kind, s = m.lastgroup, m[0]
        if m["secret"]:
            v = next((g for g in ("v1", "v2", "v3", "v4") if m[g]), "secret")
            if sum(c.isascii() and c.isalnum() for c in m[v]) >= 4:           # else there is next to nothing to draw from
                out.append((*m.span(v), "secret", m[v].lower() if _is_hex(m[v].lower()) else m[v]))
        elif m["name"]:
            gender = "m" if m["m"] else "f" if m["f"] else "n"
            words = [(m.start("full") + w.start(), m.start("full") + w.end(), w[0]) for w in _NAME_WORDS.finditer(m["full"]) if w[0] not in _PARTICLES.split()]
            for k, (i, j, w) in enumerate(words):
                out.append((i, j, "family" if k == len(words) - 1 else "given_" + gender, _lower(w)))
        else:
            digits = re.sub(r"\D", "", s)
            if m["ip"] and any(int(x) > 255 for x in s.split(".")):
                continue
            if m["card"] and len(digits) != 16 and not luhn(digits):
                continue
            if m["iban"] and _mod97(re.sub(" ", "", s)) != 1:
                continue
            if m["phone"] and not 7 <= len(digits) <= 15:
                continue
            kind = next(k for k in ("email", "iban", "phone", "ssn", "card", "ip") if m[k])
            out.append((m.start(), m.end(), kind, _lower(s) if kind == "email" else s if kind == "ip" else re.sub(r"[^A-Z0-9]", "", s)))
    return _again(text, out)


def _again(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """With the later and earlier mentions, without a title, of the names found; a given name has one gender in a text."""
    names: dict[str, str] = {}
    for _, _, kind, normal in sorted((x for x in found if x[2] == "family" or x[2].startswith("given_")), key=lambda x: (x[2] == "given_n", x[0])):
        if not normal.endswith("."):
            names.setdefault(normal, kind)
    if not names:
        return found
    found = [(i, j, names.get(n, k) if k == "given_n" and names.get(n, k).startswith("given_") else k, n) for i, j, k, n in found]
    forms = {f for i, j, _, n in found if n in names for f in (text[i:j], text[i:j].upper()) if j - i > 1}
    if not forms:
        return found
    taken, more, at = sorted(x[:2] for x in found), [], 0
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f)))) + r")(?!\w)", text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if (at == len(taken) or taken[at][0] >= m.end()) and (n := _lower(m[0])) in names:
            more.append((m.start(), m.end(), names[n], n))
    return sorted(found + more)


class _Draw:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.key, self.data, self.block, self.state = key, f"{kind}\0{attempt}\0{normal}".encode("utf-8", "surrogatepass"), 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 64:
            h = hashlib.blake2b(self.data + self.block.to_bytes(8, "little"), key=self.key[:64], digest_size=64)
            self.state, self.left, self.block = int.from_bytes(h.digest(), "little"), 1 << 512, self.block + 1
        self.state, r = divmod(self.state, n)
        self.left //= n
        return r

    def of(self, s):
        return s[self.below(len(s))]

#: Attempt number of entities whose format is nearly used up: they are replaced by a permutation of the format's values.
PERMUTED = -1
#: A format is permuted if the corpus holds more than this share of its values.
CROWDED = 0.25
_DIGITS, _HEX = "0123456789", "0123456789abcdef"


@functools.lru_cache(4096)
def _alike(c: str):
    """All signs of the kind of ``c``: digits for a digit, letters of its script and case for a letter, else itself."""
    if c.isascii() and c.isdigit():
        return _DIGITS
    low = c.lower()
    if low not in _KIND:
        return c
    return _KIND[low] if c == low else [x.upper() if len(x.upper()) == 1 else x for x in _KIND[low]]


@functools.lru_cache(4096)
def _octets(p: str, first: bool) -> list[str]:
    """Numbers of an address that are written as long as ``p`` is: those in use, or those that are not (zeros ahead, the
    ends of the first number), whichever it belongs to."""
    low, high = {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(p)]
    low, high = (max(1, low), min(223, high)) if first else (low, high)
    inside = low <= int(p) <= high and p == str(int(p))
    return [x for x in (str(i).zfill(len(p)) for i in range(256)) if len(x) == len(p) and (low <= int(x) <= high and x == str(int(x))) == inside]


def slots(kind: str, normal: str) -> tuple[list, list] | None:
    """(signs, choices): what an entity consists of, and for each part all values of its format; None for names of the
    listed scripts, whose surrogates are made of syllables."""
    if kind == "email":
        local, _, domain = normal.partition("@")
        name, _, top = domain.rpartition(".")
        return list(normal), [*map(_alike, local), "@", *map(_alike, name), *("." + top if name else top)]
    if kind == "phone":
        n = max(0, len(normal) - 10)
        keep = normal[n + 3:n + 6] == "555" and len(normal) >= 10
        return list(normal), [c if i < n or keep and n + 3 <= i < n + 6 else _alike(c) for i, c in enumerate(normal)]
    if kind == "card":
        check = luhn(normal)                             # "*" stands for the digit that follows from the others
        return [*normal[:-1], "*" if check else normal[-1]], [normal[0], *map(_alike, normal[1:-1]), "*" if check else _DIGITS]
    if kind == "iban":
        return list(normal[:2] + normal[4:]), [*normal[:2], *("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isalpha() else _alike(c) for c in normal[4:])]
    if kind == "ip":
        parts = normal.split(".")
        a, b = int(parts[0]), int(parts[1])
        keep = 1 if a in (10, 127) else 2 if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 else 0
        return parts, [[x] if i < keep else _octets(x, i == 0) for i, x in enumerate(parts)]
    if kind == "secret":
        if _is_hex(normal):
            return list(normal), [_HEX] * len(normal)
        prefix = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-", normal)
        n = prefix.end() if prefix else 0
        return list(normal), [*normal[:n], *map(_alike, normal[n:])]
    if kind == "family" or kind.startswith("given_"):
        if any(c in _KIND for c in normal):
            return None
        return list(normal), [[chr(x) for x in range(ord(c) // 64 * 64, ord(c) // 64 * 64 + 64)] if c.isalpha() else c for c in normal]
    return list(normal), list(map(_alike, normal))


def _is_hex(normal: str) -> bool:
    """Hexadecimal and not all digits: a number of digits is a number and stays one."""
    return re.fullmatch(r"[0-9a-f]+", normal) is not None and not normal.isdigit()


def _join(kind: str, parts: list[str]) -> str:
    """The entity that consists of ``parts``, with its check digits."""
    if kind == "ip":
        return ".".join(parts)
    s = "".join(parts)
    if s.endswith("*") and kind == "card":
        return s[:-1] + next(c for c in _DIGITS if luhn(s[:-1] + c))
    return s[:2] + f"{98 - _mod97(s[:2] + '00' + s[2:]):02d}" + s[2:] if kind == "iban" else s


def format_of(kind: str, normal: str) -> tuple[str, float]:
    """(name, number of values) of an entity's format; surrogates have the format of their entity."""
    found = slots(kind, normal)
    if found is None:
        return "", math.inf
    size, name = 1.0, hashlib.blake2b(digest_size=16)
    for x in found[1]:
        size *= len(x)
        name.update(f"{x[0]}\0{x[-1]}\0{len(x)}\0".encode("utf-8", "surrogatepass"))
    return name.hexdigest(), size


class _Permutation:
    """A keyed permutation of 0 .. n - 1 by alternating rounds over the halves of a number, walked on while beyond n."""

    def __init__(self, key: bytes, name: str, n: int):
        self.key, self.name, self.n = key[:64], name, n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _round(self, r: int, x: int) -> int:
        h = hashlib.blake2b(f"{self.name}\0{r}\0{x}".encode("utf-8", "surrogatepass"), key=self.key, digest_size=64).digest()
        return int.from_bytes(h, "little") & self.mask

    def there(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in range(8):
                a, b = b, a ^ self._round(r, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def back(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in reversed(range(8)):
                a, b = b ^ self._round(r, a), a
            x = a << self.half | b
            if x < self.n:
                return x


def _permuted(key: bytes, kind: str, normal: str) -> str:
    """The next value of the entity's format on one keyed cycle through all of them: different entities get different
    values, and none its own unless it is alone."""
    parts, choices = slots(kind, normal)
    name, size = format_of(kind, normal)
    n = math.prod(len(x) for x in choices)
    walk = _Permutation(key, f"{kind}\0{name}", n)
    at = 0
    for p, x in zip(parts, choices):
        at = at * len(x) + list(x).index(p)
    while True:
        at = walk.back((walk.there(at) + 1) % n)
        out, rest = [], at
        for x in reversed(choices):
            rest, k = divmod(rest, len(x))
            out.append(x[k])
        new = _join(kind, out[::-1])
        if new == normal or format_of(kind, new)[0] == name:     # other values on the cycle have another format
            return new


@functools.lru_cache(1 << 12)
def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """The replacement, in normal form: same length and kinds of signs, valid where the original is valid."""
    if attempt == PERMUTED:
        return _permuted(key, kind, normal)
    d = _Draw(key, kind, normal, attempt)
    found = slots(kind, normal)
    if found is not None:
        name = format_of(kind, normal)[0]
        for _ in range(64):
            new = _join(kind, [x if len(x) == 1 and isinstance(x, str) else d.of(x) for x in found[1]])
            if format_of(kind, new)[0] == name:
                return new
        return _permuted(key, kind, normal)
    script = "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in normal) else "latin"
    more = attempt // 8                                  # the longer the search, the longer the names
    syllables = "".join(d.of(_CONSONANTS[script]) + d.of(_VOWELS[script]) for _ in range(min(attempt, 4) + more if kind != "family" else 2 + d.below(2) + more))
    return (d.of(GIVEN[kind[-1]][script]).lower() + syllables) if kind != "family" else syllables + d.of(_CONSONANTS[script])


def render(mention: str, kind: str, new: str) -> str:
    """A surrogate in the format of a mention: its punctuation, spaces and case."""
    if kind == "family" or kind.startswith("given_"):
        if len(mention) == 2 and mention[1] == ".":
            return new[:1].upper() + "."
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    if kind in ("phone", "card", "ssn", "iban"):
        it = iter(new)
        return "".join(next(it) if c.isascii() and c.isalnum() else c for c in mention)
    return "".join(n.upper() if m.isupper() and len(n.upper()) == 1 else n for m, n in zip(mention, new))


ENTITY = "array<struct<type:string,start:int,length:int>>"


def replace(text: str | None, key: bytes, attempts: dict) -> tuple[str | None, list]:
    """The text with all entities replaced, and their places in it."""
    found = detect(text)
    if not found:
        return text, []
    out, at, size, places = [], 0, 0, []
    for i, j, kind, normal in found:
        new = render(text[i:j], kind, surrogate(key, kind, normal, attempts.get((kind, normal), 0)))
        out += [text[at:i], new]
        size += i - at
        places.append({"type": kind.split("_")[0], "start": size, "length": len(new)})
        size += len(new)
        at = j
    return "".join(out) + text[at:], places


#: Exceptions up to this many are broadcast; beyond, they are joined to the texts that mention them.
BROADCAST_ROWS = 200_000


def exceptions(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """(type, normal, attempt) of entities that don't take their first surrogate.

    Formats of which the corpus holds more than CROWDED of all values (four-digit numbers, private addresses) are
    permuted: attempt PERMUTED, always distinct, and only there may a surrogate be another real entity.  In all
    others, the entities of one type that share a surrogate leave it to the smallest of them; the others, and those
    whose surrogate is itself an entity of the corpus, draw again until none is left: every draw succeeds with an even
    chance or better, as no more than a quarter of the values are real and as many taken.  Entities are counted once per
    task before the shuffle, so one that a third of all documents hold is a row like any other.
    """
    def entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(sorted({(k, n) for t in b["t"] for _, _, k, n in detect(t)}), columns=["type", "normal"])

    @F.pandas_udf("string")
    def draw(kind: pd.Series, normal: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, n, a) for k, n, a in zip(kind, normal, attempt)], dtype=object)

    known = stored(docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(entities, "type string, normal string").distinct(), "entities")
    @F.pandas_udf("format string, size double")
    def formats(kind: pd.Series, normal: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([format_of(k, n) for k, n in zip(kind, normal)], columns=["format", "size"])

    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = known.repartition(many, "type", "normal")   # small rows, long work: by bytes they would be one task
    sized = stored(spread.withColumn("f", formats("type", "normal")).select("type", "normal", "f.format", "f.size"), "formats")
    full = (sized.groupBy(F.col("type").alias("_k"), F.col("format").alias("_f")).agg(F.count(F.lit(1)).alias("held"), F.max("size").alias("_size"))
                 .where((F.col("held") > CROWDED * F.col("_size")) & (F.col("_f") != "")).select("_k", "_f"))
    started = sized.join(full, (F.col("type") == F.col("_k")) & (F.col("format") == F.col("_f")), "left")
    started = started.select("type", "normal", F.when(F.col("_k").isNotNull(), PERMUTED).otherwise(0).alias("attempt"))
    all_ = stored(started.withColumn("new", draw("type", "normal", "attempt")), "surrogates")
    real = known.select(F.col("type").alias("_t"), F.col("normal").alias("_n"))
    while True:
        first = all_.groupBy(F.col("type").alias("_k"), F.col("new").alias("_new")).agg(F.min("normal").alias("_first"))
        marked = (all_.join(first, (F.col("type") == F.col("_k")) & (F.col("new") == F.col("_new")))
                      .join(real, (F.col("type") == F.col("_t")) & (F.col("new") == F.col("_n")), "left")
                      .withColumn("clash", (F.col("attempt") != PERMUTED) & ((F.col("normal") != F.col("_first")) | F.col("_n").isNotNull())))
        marked = stored(marked.select("type", "normal", F.col("attempt") + F.col("clash").cast("int"), "new", "clash").toDF("type", "normal", "attempt", "new", "clash"), "surrogates")
        if marked.where("clash").isEmpty():
            return marked.where("attempt <> 0").select("type", "normal", "attempt")
        all_ = stored(marked.withColumn("new", F.when(F.col("clash"), draw("type", "normal", "attempt")).otherwise(F.col("new"))).drop("clash"), "surrogates")


def replace_entities(docs: DataFrame, key: bytes = b"tidepanel", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with entities of ``text`` replaced and ``entities`` (type, start, length in the
    new text) added.

    Detected are e-mail addresses, telephone, card, bank-account and social-security numbers, IPv4 addresses, secrets
    and names after a title, with their other mentions in the text. A surrogate depends on the key, the type and the entity's normal form: mentions of one
    entity, however formatted, are replaced alike in all documents, different entities differently. Null texts stay
    null, texts without entities are unchanged; an existing column ``entities`` is replaced.
    """
    small_batches(docs.sparkSession)
    odd = exceptions(docs, key, text)
    result = f"text string, entities {ENTITY}"
    if odd.count() <= BROADCAST_ROWS:
        shared = docs.sparkSession.sparkContext.broadcast({(r["type"], r["normal"]): r["attempt"] for r in odd.collect()})

        @F.pandas_udf(result)
        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([replace(t, key, shared.value) for t in texts], columns=["text", "entities"])

        out = docs.withColumn("_new", run.asNondeterministic()(F.col(text)))
    else:
        def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(h, k, n) for h, t in zip(b["_text"], b["t"]) for k, n in {x[2:] for x in detect(t)}], columns=["_text", "_k", "_n"])

        keyed = docs.withColumn("_text", F.xxhash64(text))
        own = (keyed.select("_text", F.col(text).alias("t")).where("t is not null").mapInPandas(mentions, "_text bigint, _k string, _n string").distinct()
                    .join(odd, (F.col("_k") == F.col("type")) & (F.col("_n") == F.col("normal")))
                    .groupBy(F.col("_text").alias("_h")).agg(F.collect_list(F.struct("type", "normal", "attempt")).alias("_odd")))

        @F.pandas_udf(result)
        def run_joined(texts: pd.Series, odd: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([replace(t, key, {(x["type"], x["normal"]): x["attempt"] for x in (o if o is not None else ())}) for t, o in zip(texts, odd)], columns=["text", "entities"])

        out = keyed.join(own, F.col("_text") == F.col("_h"), "left").withColumn("_new", run_joined.asNondeterministic()(F.col(text), F.col("_odd"))).drop("_text", "_h", "_odd")
    return out.withColumns({text: F.col("_new.text"), "entities": F.col("_new.entities")}).drop("_new")
