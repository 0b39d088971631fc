"""Training windows without padding: minimum bin slack over remaining lengths, and cuts where a window stays open."""
from __future__ import annotations

import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shelfline.session import settle

WINDOW = 2048
END_ID = 1
GROUP_ROWS = 50_000         # pieces of one length that are numbered in one group
_workers: dict = {}


# --- tokens ------------------------------------------------------------------------------------------------------
def _ranked(tokenizer_json: str):
    """A byte-level merge encoder of the tokenizer's own vocabulary, and the strings it must not see; None where
    the tokenizer is of another kind. Ids of such a vocabulary are the ranks of its merges."""
    import json
    import public_tokenizers
    import tiktoken
    told = json.loads(tokenizer_json)
    pre, model, added = told.get("pre_tokenizer") or {}, told["model"], told.get("added_tokens", [])
    if told.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        return None
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]         # bytes that stand for themselves
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    special = {t["content"] for t in added}
    ranks = {bytes(map(byte.__getitem__, k)): i for k, i in model["vocab"].items() if k not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def _worker(tokenizer_json: str):
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _workers:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _workers[key] = Tokenizer.from_str(tokenizer_json), _ranked(tokenizer_json)
    return _workers[key]


def token_bytes(texts: list[str | None], tokenizer_json: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers, exactly as the tokenizer gives them.

    A byte-level vocabulary whose ids are merge ranks is encoded by a faster encoder of the same vocabulary; texts
    with special tokens, and other tokenizers, go through the tokenizer itself.
    """
    tokenizer, ranked = _worker(tokenizer_json)
    out = []
    for t in texts:
        t = t or ""
        if ranked and not any(s in t for s in ranked[1]):
            out.append(array("I", ranked[0].encode_ordinary(t)).tobytes())
        else:
            out.append(array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
    return out


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole windows and the rest of each document.

    A document is the ids of its text (null text: none) and ``end_id``. Every input row gives pieces of its
    own, repeated rows included. The tokenizer's file has a fixed size and is sent along.
    """
    tokenizer_json, end, width = read_tokenizer(tokenizer_path), array("I", [end_id]).tobytes(), 4 * window
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                owner, rows = [], []
                for i, ids in enumerate(token_bytes(part.column("text").to_pylist(), tokenizer_json)):
                    ids += end
                    for at in range(0, len(ids), width):
                        owner.append(i)
                        rows.append((at // 4, min(width, len(ids) - at) // 4, zlib.crc32(ids[at:at + width]), len(ids) // 4))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int32())),
                                                  *[pa.array([r[j] for r in rows], pa.int64()) for j in range(4)]], ["doc_id", *names])
    return documents.select("doc_id", "text").mapInArrow(cut, T.StructType(
        [documents.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names]]))


# --- plan --------------------------------------------------------------------------------------------------------
def fullest(left: dict[int, int], seed: int, window: int) -> Counter:
    """The combination with ``seed`` that leaves the least slack, as counts per length.

    Bit f of a state says that fill f can be reached; a length with count c enters in doubling multiples
    (1, 2, 4, ... and the rest), so every count up to c can be made. Walking back over the states gives the counts.
    """
    limit, full = (1 << window + 1) - 1, 1 << window
    state, trail = 1 << seed, []
    for length in sorted((x for x in left if x <= window - seed), reverse=True):
        count, unit = min(left[length] - (length == seed), (window - seed) // length), 1
        while count > 0 and not state & full:
            take = min(unit, count)
            trail.append((state, length, take))
            state |= state << take * length & limit
            count, unit = count - take, 2 * unit
        if state & full:
            break
    fill, counts = state.bit_length() - 1, Counter({seed: 1})
    for before, length, take in reversed(trail):
        if not before >> fill & 1:
            counts[length] += take
            fill -= take * length
    return counts


class Plan:
    """Where the pieces of each length go, by their rank among the pieces of that length.

    ``rows[length]`` holds (first rank, pieces per window, first sequence, offset, kept, next rank): the ranks
    from the first on go to windows in turn, ``pieces per window`` to each. Where ``kept`` is less than the
    length, only so many tokens go there, and the rest is a piece of length - kept with ranks from ``next rank``.
    """

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        self.window, self.sequences = window, 0
        self.left = {x: n for x, n in histogram.items() if n > 0}
        self.born, self.used = Counter(self.left), Counter()
        self.found: dict[int, list[tuple]] = defaultdict(list)
        while self.left:
            seed = max(self.left)
            counts = fullest(self.left, seed, window)
            slack = window - sum(x * n for x, n in counts.items())
            rest = {x: n - counts[x] for x, n in self.left.items() if n > counts[x]}
            if not slack:
                self._fill(counts, min(self.left[x] // n for x, n in counts.items()))
            elif rest:      # all that is left is longer than the slack: the most frequent length gives the open tokens
                length = max(rest, key=lambda x: (rest[x], x))
                asked = counts + Counter({length: 1})
                self._fill(counts, min(self.left[x] // n for x, n in asked.items()), length, slack)
            else:
                self._last(counts)
        self.rows = {x: np.array(rows, np.int64) for x, rows in self.found.items()}

    def _take(self, length: int, per: int, times: int, offset: int, kept: int) -> None:
        rest = length - kept
        self.found[length].append((self.used[length], per, self.sequences, offset, kept, self.born[rest] if rest else 0))
        self.used[length] += per * times
        self.left[length] -= per * times
        if not self.left[length]:
            del self.left[length]
        if rest:
            self.born[rest] += per * times
            self.left[rest] = self.left.get(rest, 0) + per * times

    def _fill(self, counts: Counter, times: int, cut: int = 0, slack: int = 0) -> None:
        offset = 0
        for length, per in sorted(counts.items(), reverse=True):
            self._take(length, per, times, offset, length)
            offset += per * length
        if slack:
            self._take(cut, 1, times, offset, slack)
        self.sequences += times

    def _last(self, counts: Counter) -> None:
        """The last tokens, fewer than a window, go to sequences of powers of two, which need no padding."""
        queue, total = sorted(counts.elements(), reverse=True), sum(x * n for x, n in counts.items())
        while total:
            open_, offset = 1 << total.bit_length() - 1, 0
            total -= open_
            while open_:
                length = queue.pop(0)
                kept = min(length, open_)
                self._take(length, 1, 1, offset, kept)
                if kept < length:
                    queue.insert(0, length - kept)
                open_, offset = open_ - kept, offset + kept
            self.sequences += 1


def resolve(rows: dict[int, np.ndarray], length: np.ndarray, rank: np.ndarray):
    """(piece, position in it, tokens, sequence, offset) of every part of the pieces."""
    piece, at = np.arange(len(length)), np.zeros(len(length), np.int64)
    length, rank, done = length.astype(np.int64), rank.astype(np.int64), []
    while len(piece):
        sequence, offset, kept, follows = (np.zeros(len(piece), np.int64) for _ in range(4))
        for x in np.unique(length):
            own = np.flatnonzero(length == x)
            first, per, start, begin, keep, after = rows[int(x)].T
            k = np.searchsorted(first, rank[own], "right") - 1
            past = rank[own] - first[k]
            window, turn = np.divmod(past, per[k])
            sequence[own], offset[own] = start[k] + window, begin[k] + turn * x
            kept[own], follows[own] = keep[k], after[k] + past
        done.append((piece, at, kept, sequence, offset))
        more = kept < length
        piece, at, rank, length = piece[more], (at + kept)[more], follows[more], (length - kept)[more]
    return [np.concatenate(c) for c in zip(*done)] if done else [np.zeros(0, np.int64)] * 5


# --- windows -----------------------------------------------------------------------------------------------------
def ranked(found: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Adds ``_rank``, dense from 0 within each length. Lengths are numbered in groups of about GROUP_ROWS pieces,
    so that a frequent length never meets in one task. Equal rows may swap ranks; they are alike."""
    order = ["doc_id", "start", "ids_crc32"]
    groups = F.broadcast(found.sparkSession.createDataFrame(        # at most one row per length, so a window's worth
        [(x, -(-n // GROUP_ROWS)) for x, n in sizes.items()], "length long, _groups long"))
    dealt = found.join(groups, "length").withColumn("_group", F.pmod(F.xxhash64(*order), "_groups")).drop("_groups")
    before = (dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).drop("_n"))
    inside = F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(before, ["length", "_group"])
            .withColumn("_rank", (F.col("_inside") + F.col("_before")).cast("long")).drop("_group", "_inside", "_before"))


def place(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, piece_start, piece_length, piece_crc32).

    One row per part of a piece; ``ids_crc32`` is null for parts of a cut piece. The plan is made from the
    histogram of lengths, which has at most ``window`` rows whatever the data.
    """
    sizes = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = Plan(sizes, window).rows
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_start", "piece_length", "piece_crc32"]

    def put(batches):
        for b in batches:
            col = lambda n: b.column(n).to_numpy()
            start, length, crc = col("start"), col("length"), col("ids_crc32")
            piece, at, kept, sequence, offset = resolve(rows, length, col("_rank"))
            values = [pa.array(start[piece] + at), pa.array(kept), pa.array(crc[piece], mask=kept < length[piece]), pa.array(col("doc_tokens")[piece]),
                      pa.array(sequence), pa.array(offset), pa.array(start[piece]), pa.array(length[piece]), pa.array(crc[piece])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(piece)), *values], ["doc_id", *names])
    return ranked(found, sizes).mapInArrow(put, T.StructType(
        [found.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names]]))


def cut_ids(documents: DataFrame, parts: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Adds the ids of ``parts`` (rows of ``place`` without a crc) as little-endian 32-bit numbers.

    Only documents that lost a part are tokenized again. Pieces with one id, place, length and crc hold the
    same ids, so a document that repeats is taken once.
    """
    key = ["piece_start", "piece_length", "piece_crc32"]
    tokenizer_json, end = read_tokenizer(tokenizer_path), array("I", [end_id]).tobytes()
    wanted = parts.select("doc_id", *key).distinct()
    ids_of = documents.select("doc_id", "text")
    places = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("piece_start", "piece_length")).alias("_cuts"))
    again = ids_of.join(places, ids_of["doc_id"].eqNullSafe(places["_id"])).drop("_id")

    def take(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                owner, rows = [], []
                for i, (ids, cuts) in enumerate(zip(token_bytes(part.column("text").to_pylist(), tokenizer_json), part.column("_cuts").to_pylist())):
                    ids += end
                    for c in cuts:
                        held = ids[4 * c["piece_start"]:4 * (c["piece_start"] + c["piece_length"])]
                        owner.append(i)
                        rows.append((c["piece_start"], c["piece_length"], zlib.crc32(held), held))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner, pa.int32())), *[pa.array([r[j] for r in rows], pa.int64()) for j in range(3)],
                     pa.array([r[3] for r in rows], pa.binary())], ["doc_id", *key, "_ids"])
    made = again.mapInArrow(take, T.StructType([documents.schema["doc_id"], *[T.StructField(k, T.LongType()) for k in key],
                                                T.StructField("_ids", T.BinaryType())])).dropDuplicates(["doc_id", *key])
    made = made.withColumnsRenamed({c: f"_{c}" for c in ["doc_id", *key]})
    same = parts["doc_id"].eqNullSafe(made["_doc_id"])
    for k in key:
        same &= parts[k] == made[f"_{k}"]
    first, size = (4 * (F.col("start") - F.col("piece_start")) + 1).cast("int"), (4 * F.col("length")).cast("int")
    return parts.join(made, same).select(*[parts[c] for c in parts.columns], F.substring("_ids", first, size).alias("ids"))


def fill_windows(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every token of every document in exactly one place of a sequence: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    Documents longer than ``window`` give whole windows and a rest. The longest remaining length opens a window and
    the fullest combination with it is found; where that leaves slack, one remaining piece is cut to fill it.
    All sequences are full but the last few, whose sizes are powers of two. An empty or null text is its end
    token alone. Null and repeated ids are rows like others. An empty table gives no rows.
    """
    documents = documents.select("doc_id", "text")
    placed = settle(place(settle(pieces(documents, tokenizer_path, window, end_id), "pieces"), window), "windows")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = cut_ids(documents, placed.where("ids_crc32 is null").drop("ids_crc32"), tokenizer_path, end_id)
    return placed.where("ids_crc32 is not null").select(*out).unionByName(cut.withColumn("ids_crc32", F.crc32("ids")).select(*out))
