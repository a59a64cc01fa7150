"""Chat formatting over a prefix tree: shared turns are emitted once, depth first, with attention intervals."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import small_batches, stored
from tidepanel.llm.tokens import encoder

#: The template: a turn is OPEN, the role, MID, the text, CLOSE.
OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"
#: Turns of this role are learned.
LEARNED = "assistant"
_CONTROL = re.compile(r"\\|<(?=/?turn)|>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n(.*?)(?<!\\)((?:\\\\)*)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    """Put a backslash before backslashes and before what would open or close a turn (in a role, also before >)."""
    return _CONTROL.sub(lambda m: m[0] if m[0] == ">" and not role else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    return OPEN + escape(role, role=True) + MID


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2] + m[3])) for m in _TURN.finditer(formatted)]


NODES = ("node binary, parent binary, depth bigint, role string, text string")


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Node id of every turn: a 128-bit hash of its conversation up to and including it. Rows arrive in turn order."""
    key, node, depth = None, b"", 0
    for b in batches:
        nodes, parents, depths = [], [], []
        for k, role, text in zip(b["_key"], b["role"], b["text"]):
            if k != key:
                key, node, depth = k, b"", 0
            parents.append(node)
            h = hashlib.blake2b(node, digest_size=16)
            r = role.encode()
            h.update(len(r).to_bytes(8, "little") + r + text.encode())
            node = h.digest()
            nodes.append(node)
            depths.append(depth)
            depth += 1
        yield pd.DataFrame({"_key": b["_key"], "node": nodes, "parent": parents, "depth": depths, "role": b["role"], "text": b["text"]})


def _tokenise(tokenizer):
    """Ids of a turn: its head, text and end are tokenised apart, so the loss mask is an interval of tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        end = enc.encode([CLOSE])[0]
        for b in batches:
            heads = enc.encode([head(r) for r in b["role"]])
            texts = enc.encode([escape(t) for t in b["text"]])
            out = b.drop(columns=["role", "text"])
            out["ids"] = [np.concatenate([h, t, end]).astype("<u4").tobytes() for h, t in zip(heads, texts)]
            out["length"] = [len(h) + len(t) + len(end) for h, t in zip(heads, texts)]
            learned = (b["role"] == LEARNED).to_numpy()
            starts, sizes = np.array([len(h) for h in heads]), np.array([len(t) for t in texts])
            out["loss_from"] = np.where(learned, starts, 0)
            out["loss_to"] = np.where(learned, starts + sizes, 0)
            yield out

    return run


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Position of every turn of a conversation and the merged intervals of what is before it in the sequence.

    Rows of a conversation arrive in turn order; its ancestors mostly lie behind one another in depth-first order,
    so few intervals are held.
    """
    key, position, spans = None, 0, []
    for b in batches:
        rows = []
        for k, node, start, length in zip(b["_key"], b["node"], b["start"], b["length"]):
            if k != key:
                key, position, spans = k, 0, []
            if spans and spans[-1][1] == start:
                spans = [*spans[:-1], (spans[-1][0], start + length)]
            else:
                spans = [*spans, (start, start + length)]
            rows.append((node, position, [{"from": int(i), "to": int(j)} for i, j in spans]))
            position += length
        yield pd.DataFrame(rows, columns=["node", "position", "attends"])


def prefix_tree(turns: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of the prefix tree of conversations (conv_id, turn, role, text).

    paths: conv_id, depth, node; one row per turn. nodes, one row per distinct turn with its history: node, parent,
    depth, ids (little-endian 32-bit), length, start (its place in the depth-first sequence of all trees), position
    (position id of its first token), attends (intervals of the sequence that its tokens may see, its own end
    included: causal within the last one), loss_from and loss_to (interval of its own tokens under the loss mask).

    Turns are taken in the order of turn, role and text; a null role or text is empty; rows without conv_id make one
    conversation with a null id. Runs of turns that the same conversations share are one branch, and branches are
    ordered by the hashes along their path, which is a depth-first order; sorting, lengths before a node and its
    history are computed by range, never in one task. A tree that many conversations share is rows like any others.
    """
    small_batches(turns.sparkSession)
    # a conversation is read turn by turn in one task, streaming; its copies share only hashes
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_key"), "turn",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("_key").sortWithinPartitions("_key", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")
    chained = stored(ordered.mapInPandas(_chain, "_key string, " + NODES), "turns")
    shared = chained.groupBy("node").agg(F.count(F.lit(1)).alias("shares"), F.first("text").alias("text"), F.first("role").alias("role"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("_key").alias("owner"))
    shared = stored(shared.mapInPandas(_tokenise(tokenizer), "node binary, shares bigint, parent binary, depth bigint, owner string, ids binary, length bigint, loss_from bigint, loss_to bigint"), "nodes")

    # branch heads along each owner's conversation: where the number of conversations that share the turn changes
    sized = shared.select(F.col("node").alias("_n"), "shares", "owner")
    own = chained.select("_key", "depth", "node").join(sized, F.col("node") == F.col("_n"))
    w = Window.partitionBy("_key").orderBy("depth")
    heads = own.withColumn("new", F.coalesce(F.col("shares") != F.lag("shares").over(w), F.lit(True)))
    branch = heads.withColumn("path", F.array_join(F.collect_list(F.when(F.col("new"), F.substring(F.hex("node"), 1, 16))).over(w.rowsBetween(Window.unboundedPreceding, 0)), "/"))
    order = branch.where(F.col("_key") == F.col("owner")).select(F.col("node").alias("_m"), "path")
    placed = (shared.select("node", "depth", "length").join(order, F.col("node") == F.col("_m")).select("node", "path", "depth", "length")
                    .repartitionByRange(F.col("path"), F.col("depth")).sortWithinPartitions("path", "depth").withColumn("_part", F.spark_partition_id()))

    def cumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for b in batches:
            n = b["length"].to_numpy()
            ahead = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pd.DataFrame({"node": b["node"], "_part": b["_part"], "ahead": ahead, "size": n})

    local = stored(placed.mapInPandas(cumulate, "node binary, _part int, ahead bigint, size bigint"), "order")
    ranges = local.groupBy("_part").agg(F.sum("size").alias("size"))        # one row per range partition
    offsets = ranges.select(F.col("_part").alias("_q"), F.coalesce(F.sum("size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    starts = local.join(offsets, F.col("_part") == F.col("_q")).select(F.col("node").alias("_s"), (F.col("ahead") + F.col("offset")).alias("start"))
    nodes = stored(shared.join(starts, F.col("node") == F.col("_s")).drop("_s", "shares"), "placed")

    # position ids and intervals along each owner's conversation
    spans = nodes.select(F.col("node").alias("_n"), "start", "length", "owner")
    walk = (chained.select("_key", "depth", "node").join(spans, F.col("node") == F.col("_n"))
                   .select("_key", "depth", "node", "start", "length", "owner"))
    needed = walk.groupBy(F.col("_key").alias("_k")).agg(F.max(F.when(F.col("_key") == F.col("owner"), F.col("depth"))).alias("deepest")).where("deepest is not null")
    walk = walk.join(needed, (F.col("_key") == F.col("_k")) & (F.col("depth") <= F.col("deepest")))
    seen = (walk.select("_key", "depth", "node", "start", "length").repartition("_key").sortWithinPartitions("_key", "depth")
                .mapInPandas(_intervals, "node binary, position bigint, attends array<struct<from:bigint,to:bigint>>"))
    # an ancestor is seen from several owners, with the same history
    seen = seen.groupBy(F.col("node").alias("_n")).agg(F.first("position").alias("position"), F.first("attends").alias("attends"))
    return nodes.join(seen, F.col("node") == F.col("_n")).drop("_n", "owner"), chained.select(F.when(F.col("_key") != "", F.col("_key").cast("bigint")).alias("conv_id"), "_key", "depth", "node")


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digest of every conversation, decoded from the emitted ids, parsed by the template and unescaped."""
    own = nodes.select(F.col("node").alias("_n"), "ids", "loss_from", "loss_to")
    rows = (paths.join(own, F.col("node") == F.col("_n")).select("_key", "depth", "ids", "loss_from", "loss_to")
                 .repartition("_key").sortWithinPartitions("_key", "depth"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = encoder(tokenizer).tokenizer
        key, state = None, None
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in b["ids"]]
            whole = tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
            learned = tok.decode_batch([x[i:j].tolist() for x, i, j in zip(ids, b["loss_from"], b["loss_to"])], skip_special_tokens=False)
            done = []
            for k, text, loss in zip(b["_key"], whole, learned):
                if k != key:
                    if state:
                        done.append(state.row())
                    key, state = k, _Digest(k)
                state.add(text, unescape(loss))
            if done:
                yield _frame(done)
        if state:
            yield _frame([state.row()])

    return rows.mapInPandas(digest, DIGEST)


class _Digest:
    def __init__(self, key: str):
        self.conv_id, self.turns, self.formatted, self.loss = int(key) if key else None, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: str) -> None:
        for role, text in parse(formatted):
            self.all.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        self.formatted += len(formatted)
        self.loss += len(loss)
        self.learned.update(loss.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.formatted


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


#: A conversation whose texts hold control strings, formatted along with the table's.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
