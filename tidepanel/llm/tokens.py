"""Token ids of whole texts, with each distinct piece of a text encoded once per worker."""

from __future__ import annotations

import functools
import os
import sys
import unicodedata

import numpy as np

#: Distinct pieces a worker remembers before it starts afresh.
REMEMBER = 400_000
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    space = {0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(9, 14), 0x20, *range(0x2000, 0x200B)}
    kind = {"L": 1, "N": 2}
    return np.fromiter((0 if c in space else kind.get(unicodedata.category(chr(c))[0], 3) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def cut(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the pieces of joined texts without contractions, each text beginning a piece: runs of letters, numbers or other signs, each with one
    space before it, and the white space between."""
    kind = _classes()[codes]
    first = np.empty(len(codes), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    starts_run = first & (kind > 0)
    at = np.flatnonzero(starts_run[1:]) + 1           # runs with something before them
    white = kind[at - 1] == 0
    lead = at[white & (codes[at - 1] == 32)]          # their space belongs to the run
    first[lead] = False
    first[lead - 1] = True
    alone = at[white & (codes[at - 1] != 32)] - 1     # the last white-space sign before a run stands alone
    first[alone] = True
    first[begins] = True
    return np.flatnonzero(first)


def _core(tokenizer):
    """The same merges as a rank table, which encodes a lone piece several times faster; None where ids aren't ranks."""
    import json

    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]       # bytes shown as themselves; the others from 256 on
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe


class Encoder:
    """Byte-level BPE ids; equal to encoding the whole text, as pieces are encoded independently of each other.

    Pieces are found by a 64-bit hash of their code points.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = True      # their strings are ordinary text
        self.core = _core(self.tokenizer)
        rng = np.random.default_rng(20240229)
        self.mix = rng.integers(1, 1 << 62, size=2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif "'" in t and any(c in t for c in _CONTRACTIONS):
                out[i] = self.whole(t)
            else:
                plain.append(i)
        group, size = [], 0
        for i in plain:                                  # bounded memory, whatever the batch holds
            group.append(i)
            size += len(texts[i])
            if size > 400_000:
                self._together(texts, group, out)
                group, size = [], 0
        if group:
            self._together(texts, group, out)
        return out

    def _together(self, texts, group, out) -> None:
        joined = "".join([texts[i] for i in group])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(texts[i]) for i in group])
        begins = np.concatenate([[0], ends[:-1]])
        starts = cut(codes, begins)
        # a text's last white space is one piece with what is before it, not parted for the next text's first run
        stops = np.concatenate([starts[1:], [len(codes)]])
        keep = self._join_trailing(codes, starts, stops, begins, ends)
        starts = starts[keep]
        stops = np.concatenate([starts[1:], [len(codes)]])
        lengths = stops - starts
        key = self._hash(codes, starts, lengths)
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        slot = self._learn(joined, unique, starts[first], stops[first])
        n = self.lengths[slot][inverse]
        where = self.starts[slot][inverse]
        total = np.cumsum(n)
        at = np.repeat(where - (total - n), n) + np.arange(total[-1])
        ids = self.pool[at]
        piece_of_text = np.searchsorted(starts, begins)
        before = np.concatenate([[0], total])
        edges = np.concatenate([before[piece_of_text], [total[-1]]])
        for j, i in enumerate(group):
            out[i] = ids[edges[j]:edges[j + 1]]

    @staticmethod
    def _join_trailing(codes, starts, stops, begins, ends) -> np.ndarray:
        keep = np.ones(len(starts), bool)
        is_space = _classes()[codes[starts]] == 0
        last = np.searchsorted(starts, ends) - 1           # last piece of each text
        for p, b in zip(last, begins):
            if is_space[p] and starts[p] > b and _classes()[codes[starts[p] - 1]] == 0 and stops[p] - starts[p] == 1:
                keep[p] = False
        return keep

    def _hash(self, codes, starts, lengths) -> np.ndarray:
        a, b = self.mix
        place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
        x = (codes.astype(np.uint64) + place * b + np.uint64(0x9E3779B97F4A7C15)) * a
        x ^= x >> np.uint64(29)
        x *= b
        x ^= x >> np.uint64(32)
        h = np.add.reduceat(x, starts) + lengths.astype(np.uint64)
        h ^= h >> np.uint64(31)
        return h * a

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        if self.core is not None:
            return [self.core.encode_single_piece(p.encode()) for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _learn(self, joined, unique, starts, stops) -> np.ndarray:
        slot = np.searchsorted(self.keys, unique)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == unique[known]
        if not known.all():
            if len(self.keys) + np.count_nonzero(~known) > REMEMBER:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            ids = self._pieces([joined[starts[i]:stops[i]] for i in new])
            n = np.array([len(x) for x in ids], np.int64)
            at = len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, np.fromiter((y for x in ids for y in x), np.uint32, n.sum())])
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.starts = np.concatenate([self.starts, at])[order]
            self.lengths = np.concatenate([self.lengths, n])[order]
            slot = np.searchsorted(self.keys, unique)
        return slot


@functools.cache
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)
