"""Alignment of two tokenizers over the same texts: galloping intersection of token ends, and links counted corpus-wide."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import small_batches, stored
from tidepanel.llm.tokens import Encoder, default_path

#: Id pairs that are broadcast with their counts (17 bytes each); beyond it the counts are joined instead.
BROADCAST_PAIRS = 2_000_000
#: Code points worked on at once, pieces and id pairs a worker remembers before it starts afresh.
_CHUNK, _REMEMBER, _REMEMBER_PAIRS = 1_000_000, 500_000, 5_000_000
#: Id pairs a task adds up before it hands them on; a group with more links than this is counted by distinct ids.
_HOLD, _LARGE = 2_000_000, 4_096
_SPACE = "▁"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# --- galloping intersection ---------------------------------------------------------------------------

def gallop(x: np.ndarray, longer: np.ndarray, start: np.ndarray, stop: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Index in ``longer`` of every x that occurs in its part [start, stop), -1 for the others.

    Every x searches on its own: from ``guess`` in steps of doubling length, to the right or to the left, until it is
    enclosed, then by halving.  Parts are ascending and not empty.
    """
    guess = np.clip(guess, start, stop - 1)
    up = longer[guess] < x
    low = np.where(up, guess, start - 1)                 # longer[low] < x, or nothing is there
    high = np.where(up, stop, guess)                     # longer[high] >= x, or nothing is there
    live, step = np.arange(len(x)), 1
    while len(live):                                     # exponential phase
        to = np.where(up[live], guess[live] + step, guess[live] - step)
        inside = (to >= start[live]) & (to < stop[live])
        live, to = live[inside], to[inside]
        below = longer[to] < x[live]
        low[live[below]] = to[below]
        high[live[~below]] = to[~below]
        live, step = live[below == up[live]], step * 2
    live = np.flatnonzero(high - low > 1)
    while len(live):                                     # binary phase
        middle = (low[live] + high[live]) // 2
        below = longer[middle] < x[live]
        low[live[below]] = middle[below]
        high[live[~below]] = middle[~below]
        live = live[high[live] - low[live] > 1]
    there = high < stop
    there[there] = longer[high[there]] == x[there]
    return np.where(there, high, -1)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i behind one another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def common_ends(ends_a: np.ndarray, n_a: np.ndarray, ends_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into ends_a, into ends_b) of the ends both tokenizers have, for many texts behind one another.

    Ends ascend over all texts; text i has n_a[i] and n_b[i] of them.  The shorter list of each text drives the search.
    """
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    found = []
    for mine, theirs, n, m, at, to, drives in ((ends_a, ends_b, n_a, n_b, at_a, at_b, n_a <= n_b), (ends_b, ends_a, n_b, n_a, at_b, at_a, n_b < n_a)):
        own = np.repeat(np.flatnonzero(drives), n[drives])
        index = _spread(at[drives], n[drives])
        rank = index - at[own]
        hit = gallop(mine[index], theirs, to[own], to[own] + m[own], to[own] + rank * m[own] // n[own])
        found.append((index[hit >= 0], hit[hit >= 0]))
    (a1, b1), (b2, a2) = found
    a, b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def group_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A ids, B ids, occurrences) of the distinct id pairs that one group links: every A token with every B token."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    return np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(ca, cb).ravel()


# --- both tokenizers over pieces ----------------------------------------------------------------------

def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(weight[order], first) if len(key) else weight


#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
_CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that end in white space or have a sign beyond the Latin letters are encoded one by one.
_ALONE = re.compile(r"\s\Z|[^\x00-\u024F]")


class Aligner:
    """Tokens, groups and links of whole texts.

    A space and the text are cut before every space that follows a sign other than white space.  Neither tokenizer has
    a token over such a place (checked on the piece vocabulary; else a text is one piece), so groups end there too, and
    what a distinct piece gives is found once per worker: both token lists, the intersection of their ends, groups and
    links.  Pieces are kept without their first space.
    """

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import json

        import sentencepiece
        import tiktoken

        path = a_path or default_path()
        self.a = Encoder(path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or piece_path())
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]      # bytes shown as themselves; the others from 256 on
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        ranks = {x: i for i, x in enumerate(self.bytes_a) if i < self.a.tokenizer.get_vocab_size(with_added_tokens=False)}
        self.joint = None if self.a.core is None else tiktoken.Encoding("joint", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(_SPACE, " ").encode() for p in names]
        self.length_a, self.length_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        # every id in decimal with each sign that may follow it
        self.shown = {(side, mark): np.array([b"%d%s" % (i, mark) for i in range(len(x))]) for side, x in (("a", self.bytes_a), ("b", self.bytes_b)) for mark in (b",", b"|", b";")}
        self.lone = self.b.piece_to_id(_SPACE)
        self.apart = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in names) and self.b.id_to_piece(self.lone) == _SPACE
        self.cut = re.compile(r"(?<=\S)(?= )" if self.apart else r"(?!)")
        self.double = re.compile(r"\s ")
        self.span = len(self.bytes_b)
        self.wide = len(self.bytes_a) * self.span
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.names: list[bytes] = []
        self.facts = np.zeros((0, 5), np.int64)          # ok, n_a, n_b, n_groups, n_links
        self.pair_start = np.zeros(0, np.int64)
        self.pair_count = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        full = " " + text
        if self.apart and not self.double.search(full):
            return text.split(" ")
        return [p[1:] for p in self.cut.split(full)]

    def _encode_a(self, joint: list[str], alone: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (the joint ones first) behind one another and their numbers."""
        ids = self.joint.encode_ordinary("".join([" " + p for p in joint])) if joint else []
        ends = np.cumsum(self.length_a[ids]) if ids else np.zeros(0, np.int64)
        stops = np.searchsorted(ends, np.cumsum([len(r) for r in raw[:len(joint)]]), side="right")
        rest = [self.a.whole(" " + p) for p in alone]
        return np.concatenate([np.array(ids, np.int64), *rest]).astype(np.int64), np.concatenate([np.diff(stops, prepend=0), [len(x) for x in rest]]).astype(np.int64)

    def _encode_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [ids if ids else [self.lone] for ids in self.b.encode(pieces, num_threads=1)]      # it puts the space back
        return np.array(list(chain.from_iterable(got)), np.int64), np.array([len(x) for x in got], np.int64)

    def _learn(self, new: list[str]) -> None:
        joint, alone = [], []
        for p in new:
            (joint if self.joint and p and (p.isascii() and not p[-1].isspace() or not _ALONE.search(p)) else alone).append(p)
        pieces = joint + alone
        raw = [b" " + p.encode() for p in pieces]
        (a, n_a), (b, n_b) = self._encode_a(joint, alone, raw), self._encode_b(pieces)
        ok = np.ones(len(pieces), bool)
        if not (b"".join(raw) == b"".join([self.bytes_a[i] for i in a.tolist()]) == b"".join([self.bytes_b[i] for i in b.tolist()])):
            for i, (ia, ib) in enumerate(zip(np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]))):
                ok[i] = b"".join([self.bytes_a[x] for x in ia]) == raw[i] == b"".join([self.bytes_b[x] for x in ib])
            a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        good = np.flatnonzero(ok)
        n_a, n_b = n_a[good], n_b[good]
        common_a, common_b = common_ends(np.cumsum(self.length_a[a]), n_a, np.cumsum(self.length_b[b]), n_b)
        owner = np.repeat(np.arange(len(good)), n_a)[common_a]              # every piece ends with a common end
        size_a, size_b = np.diff(common_a, prepend=-1), np.diff(common_b, prepend=-1)
        facts = np.zeros((len(pieces), 5), np.int64)
        facts[:, 0] = ok
        facts[good, 1], facts[good, 2] = n_a, n_b
        facts[good, 3] = np.bincount(owner, minlength=len(good))
        facts[good, 4] = np.bincount(owner, weights=size_a * size_b, minlength=len(good)).astype(np.int64)
        owner_of, code, times = self._links(a, b, common_a, common_b, size_a, size_b, owner)
        counts = np.zeros(len(pieces), np.int64)
        counts[good] = np.bincount(owner_of, minlength=len(good))
        names = [b""] * len(pieces)
        for i, name in zip(good.tolist(), self._spelled(a, b, common_a, common_b, size_a, size_b, owner, len(good))):
            names[i] = name
        self.slot.update(zip(pieces, range(len(self.names), len(self.names) + len(pieces))))
        self.names += names
        self.facts = np.concatenate([self.facts, facts])
        self.pair_start = np.concatenate([self.pair_start, len(self.codes) + np.cumsum(counts) - counts])
        self.pair_count = np.concatenate([self.pair_count, counts])
        self.codes = np.concatenate([self.codes, code])
        self.times = np.concatenate([self.times, times])

    def _links(self, a, b, common_a, common_b, size_a, size_b, owner):
        """(piece, code, occurrences) of the distinct id pairs of each piece: small groups by their rank ranges, large
        ones by distinct ids."""
        start_a, start_b = common_a - size_a + 1, common_b - size_b + 1
        small = np.flatnonzero(size_a * size_b <= _LARGE)
        each = np.repeat(small, size_a[small])
        row_a = np.repeat(_spread(start_a[small], size_a[small]), size_b[each])
        row_b = _spread(start_b[each], size_b[each])
        owners, codes, times = [np.repeat(owner[each], size_b[each])], [a[row_a] * self.span + b[row_b]], [np.ones(len(row_a), np.int64)]
        for g in np.flatnonzero(size_a * size_b > _LARGE):
            x, y, n = group_links(a[start_a[g]:common_a[g] + 1], b[start_b[g]:common_b[g] + 1])
            owners.append(np.full(len(x), owner[g]))
            codes.append(x * self.span + y)
            times.append(n)
        key, n = _sums(np.concatenate(owners) * self.wide + np.concatenate(codes), np.concatenate(times))
        return key // self.wide, key % self.wide, n

    def _spelled(self, a, b, common_a, common_b, size_a, size_b, owner, n) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each piece: A and B ids put in their places, each with the sign after it."""
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)
        text = np.zeros(len(a) + len(b), f"S{max(x.dtype.itemsize for x in self.shown.values())}")
        text[place_a], text[place_b] = self.shown["a", b","][a], self.shown["b", b","][b]
        text[place_a[common_a]], text[place_b[common_b]] = self.shown["a", b"|"][a[common_a]], self.shown["b", b";"][b[common_b]]
        signs = text.view(np.uint8).reshape(len(text), -1)
        used = signs > 0
        length = np.concatenate([[0], np.cumsum(np.count_nonzero(used, axis=1))])
        flat = signs[used].tobytes()
        last = np.searchsorted(owner, np.arange(n), side="right") - 1       # last group of each piece
        stops = length[place_b[common_b[last]] + 1].tolist()
        return [flat[s:e - 1] for s, e in zip([0, *stops[:-1]], stops)]

    def _together(self, texts: list[str | None]):
        """Per text (facts, digest), and (text, code, occurrences) of its distinct id pairs."""
        if len(self.names) > _REMEMBER or len(self.codes) > _REMEMBER_PAIRS:
            self._forget()
        cut = [self._pieces(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        slots = list(map(self.slot.get, flat))
        if None in slots:
            missing = [i for i, s in enumerate(slots) if s is None]
            self._learn(list(dict.fromkeys([flat[i] for i in missing])))
            for i in missing:
                slots[i] = self.slot[flat[i]]
        n, at = np.array([len(x) for x in cut], np.int64), np.array(slots, np.int64)
        facts = np.zeros((len(texts), 5), np.int64)
        if len(at):
            full = np.flatnonzero(n)
            facts[full] = np.add.reduceat(self.facts[at], (np.cumsum(n) - n)[full], axis=0)
        ok = (n > 0) & (facts[:, 0] == n)
        facts[~ok] = 0
        digests, stops = [""] * len(texts), np.cumsum(n).tolist()
        for i in np.flatnonzero(ok).tolist():
            digests[i] = hashlib.sha256(b";".join([self.names[s] for s in slots[stops[i] - len(cut[i]):stops[i]]])).hexdigest()
        doc = np.repeat(np.arange(len(texts)), n)
        keep = ok[doc]
        many = max(1, len(self.names))
        key, uses = _sums(doc[keep] * many + at[keep], np.ones(np.count_nonzero(keep), np.int64))
        doc, piece = key // many, key % many
        count = self.pair_count[piece]
        row = _spread(self.pair_start[piece], count)
        key, times = _sums(np.repeat(doc, count) * self.wide + self.codes[row], np.repeat(uses, count) * self.times[row])
        return facts[:, 1:], digests, key // self.wide, key % self.wide, times

    def align(self, texts: list[str | None]) -> Iterator[tuple]:
        """(first row, facts, digests, text, code, occurrences) of runs of neighbouring texts, of bounded size."""
        group, size, first = [], 0, 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size >= _CHUNK:
                yield first, *self._together(group)
                first, group, size = first + len(group), [], 0
        if group:
            yield first, *self._together(group)


@functools.cache
def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    return Aligner(a_path, b_path)


# --- Spark --------------------------------------------------------------------------------------------

_FACTS = ("n_a", "n_b", "n_groups", "n_links")
_DOCUMENT = f"doc_id bigint, {', '.join(f'{c} bigint' for c in _FACTS)}, groups_sha256 string, codes array<bigint>, times array<bigint>"


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]), values).cast(pa.list_(pa.int64()))


def linked_pairs(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked id pairs as
    ``codes`` (A id * size of B's vocabulary + B id, ascending) with the number of their links, ``times``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for b in batches:
            ids = b.column("doc_id")
            for first, facts, digests, doc, code, times in tool.align(b.column("text").to_pylist()):
                n = np.bincount(doc, minlength=len(digests))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(digests)), *(pa.array(x) for x in facts.T), pa.array(digests), _lists(code, n), _lists(times, n)],
                    names=["doc_id", *_FACTS, "groups_sha256", "codes", "times"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "text").mapInArrow(run, _DOCUMENT)


def pair_counts(linked: DataFrame, span: int) -> DataFrame:
    """(code, docs, best): in how many documents each id pair is linked, and whether no pair of its A id is in more.

    Tasks add up their documents before the shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def rows(code, n):
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "docs"])

        for b in batches:
            parts.append(np.unique(b.column("codes").flatten().to_numpy(), return_counts=True))
            held += len(parts[-1][0])
            if held > _HOLD:
                parts = [_sums(*(np.concatenate(x) for x in zip(*parts)))]
                held = len(parts[0][0])
                if held > _HOLD // 2:
                    yield rows(*parts[0])
                    parts, held = [], 0
        if parts:
            yield rows(*_sums(*(np.concatenate(x) for x in zip(*parts))))

    sums = stored(linked.select("codes").where("size(codes) > 0").mapInArrow(count, "code bigint, docs bigint").groupBy("code").agg(F.sum("docs").alias("docs")), "pairs")
    side = F.floor(F.col("code") / span)
    most = sums.groupBy(side.alias("_a")).agg(F.max("docs").alias("_most"))
    return sums.join(most, side == F.col("_a")).select("code", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokenizer A (byte-level) reads a space and the text, B (pieces) the text, to which it adds that space.  Texts that
    are null or empty, or whose tokens of either side don't give back the bytes of a space and the text, have no tokens:
    zeros and an empty digest.  A link is an A and a B token of one group; an id pair counts once per document; rows
    with one doc_id, null included, are documents of their own.  Other columns are ignored; an empty table gives no
    rows.  A group is worked on as a whole: it needs memory for its distinct A ids times its distinct B ids.

    The counts are broadcast up to ``broadcast_pairs`` id pairs, else joined to the id pairs of each document.
    """
    spark = docs.sparkSession
    linked = stored(linked_pairs(docs, a_path, b_path, id_col), "linked")
    counts = stored(pair_counts(linked, aligner(a_path, b_path).span), "pair-counts")
    if counts.count() <= broadcast_pairs:
        known = counts.orderBy("code").toArrow()
        shared = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("code", "docs", "best")))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code_of, docs_of, best_of = shared.value
            for b in batches:
                doc = np.repeat(np.arange(b.num_rows), b.column("codes").value_lengths().to_numpy(zero_copy_only=False))
                at = np.searchsorted(code_of, b.column("codes").flatten().to_numpy())
                times = b.column("times").flatten().to_numpy()
                sums = np.zeros((2, b.num_rows), np.int64)
                np.add.at(sums[0], doc, times * best_of[at])
                np.add.at(sums[1], doc, times * docs_of[at])
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", *_FACTS)] + [pa.array(x) for x in sums] + [b.column("groups_sha256")],
                                                 names=["doc_id", *_FACTS, "n_best", "count_sum", "groups_sha256"])

        return linked.mapInArrow(score, f"doc_id bigint, {', '.join(f'{c} bigint' for c in (*_FACTS, 'n_best', 'count_sum'))}, groups_sha256 string")
    keyed = stored(linked.withColumn("row", F.monotonically_increasing_id()), "linked-rows")
    each = keyed.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", "p.codes", "p.times")
    seen = counts.select(F.col("code").alias("codes"), "docs", "best")
    sums = each.join(seen, "codes").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    out = keyed.drop("codes", "times").join(sums, "row", "left")
    return out.select("doc_id", *_FACTS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
