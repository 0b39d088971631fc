"""Best-fit packing of token pieces by minimum bin slack."""
from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shelfline.session import settle

from .textkit import releasing, remembered

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 300_000       # words whose ids a Python worker remembers
GROUP_ROWS = 50_000         # pieces of one length that are numbered in one group

# Texts of these characters may be lower-cased and cut at blanks before tokenizing: none of them combines
# with a neighbour, changes length or case by its neighbours, or is a blank that only some libraries know.
_SIMPLE = "[\\t\\n\\r -~¡-į]*"


def _encoder(tokenizer_json: str):
    """The tokenizer and the word cache of this Python worker."""
    def make():
        import os
        import re
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        return Tokenizer.from_str(tokenizer_json), {}, re.compile(_SIMPLE).fullmatch
    return remembered(("packing", zlib.crc32(tokenizer_json.encode())), make)


def _printable() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}


_ALPHABET = _printable()


def _fresh_words(new: list[str], cache: dict[str, bytes], tokenizer) -> dict[str, bytes]:
    """Ids of words that the cache does not hold. Letters, and letters with stops behind them, are cut into
    letters and stops, as the tokenizer's own pattern cuts them; the rest goes through it whole."""
    fresh: dict[str, bytes] = {}
    model, rest = tokenizer.model, []

    def letters(word: str) -> bytes:
        found = cache.get(word) or fresh.get(word)
        if found is None:
            found = np.array([t.id for t in model.tokenize(word.encode("utf-8").decode("latin-1").translate(_ALPHABET))], "<u4").tobytes()
            fresh[word] = found
        return found

    def stops(tail: str) -> bytes:
        found = cache.get(tail) or fresh.get(tail)
        if found is None:
            found = fresh[tail] = np.array(tokenizer.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
        return found
    for w in new:
        base = w.rstrip(".,;:!?")
        if not base.isalpha():
            rest.append(w)
        elif len(base) == len(w):
            letters(w)
        else:
            fresh[w] = letters(base) + stops(w[len(base):])
    fresh.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
    return fresh


def token_bytes(texts: list[str | None], tokenizer_json: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers, exactly as the tokenizer gives them.

    The tokenizer cuts at blanks and lower-cases, so the ids of a plain text are those of its words in turn;
    each distinct word is tokenized once. Other texts go through the tokenizer whole.
    """
    tokenizer, cache, simple = _encoder(tokenizer_json)
    out: list[bytes] = []
    for at in range(0, len(texts), 400):
        parts = [t or "" for t in texts[at:at + 400]]
        plain = [bool(simple(t)) and "<|" not in t for t in parts]
        cut = [t.lower().split() if ok else [] for t, ok in zip(parts, plain)]
        fresh = _fresh_words(list(set().union(*cut).difference(cache)), cache, tokenizer)
        cache.update(fresh)
        for t, ok, ws in zip(parts, plain, cut):
            out.append(b"".join(map(cache.__getitem__, ws)) if ok
                       else np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
        if len(cache) > CACHE_WORDS:          # the cache is full: words of these texts alone are forgotten again
            for w in fresh:
                del cache[w]
    return out


def tokenize_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                    with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the ids of its text (null text: none) and ``end_id``. Only longer ones are cut, into
    pieces of ``capacity``; the last may be shorter. Every input row gives pieces of its own, repeated ids
    included. The tokenizer's file is read on the driver and sent along; its size is fixed.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    end = np.array([end_id], "<u4").tobytes()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = T.StructType([documents.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                owner, rows, ids = [], [], []
                for i, own in enumerate(token_bytes(part.column("text").to_pylist(), tokenizer_json)):
                    own += end
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        held = own[at:at + 4 * capacity]
                        owner.append(i)
                        rows.append((k, at // 4, len(held) // 4, zlib.crc32(held)))
                        if with_ids:
                            ids.append(np.frombuffer(held, "<u4").astype(np.int64))
                columns = [part.column("doc_id").take(pa.array(owner, pa.int32()))]
                columns += [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(fields)]
                columns += [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[n for n, _ in fields], *(["ids"] if with_ids else [])])
    return documents.select("doc_id", "text").mapInArrow(releasing(cut, remembers=True), schema)


def fullest(available: list[tuple[int, int]], seed: int, capacity: int) -> Counter:
    """The fullest bin holding ``seed``: a subset-sum over bitsets of reachable fills, longest lengths first.

    ``available`` is (length, count), lengths descending, without the seed. Stops at a full bin. The states
    after each step lead back to the chosen lengths.
    """
    mask, states, steps = (1 << (capacity + 1)) - 1, [1 << seed], []
    for length, count in available:
        count, unit = min(count, (capacity - seed) // length), 1
        while count > 0 and not states[-1] >> capacity & 1:
            take = min(unit, count)
            reached = states[-1] | (states[-1] << (take * length)) & mask
            if reached != states[-1]:
                states.append(reached)
                steps.append((length, take))
            count, unit = count - take, unit * 2
        if states[-1] >> capacity & 1:
            break
    fill, chosen = states[-1].bit_length() - 1, Counter({seed: 1})
    for (length, take), before in zip(reversed(steps), reversed(states[:-1])):
        if not before >> fill & 1:
            chosen[length] += take
            fill -= take * length
    return chosen


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Counter]]:
    """(times, {length: count}) of the bins for a histogram of lengths.

    The longest remaining length opens a bin and the fullest feasible combination is removed, as often as
    the counts allow. Its size depends on the number of distinct lengths (at most ``capacity``), not on the
    number of pieces.
    """
    left, bins = {length: n for length, n in lengths.items() if n > 0}, []
    order = sorted(left, reverse=True)
    while left:
        seed = next(x for x in order if x in left)
        bin_ = fullest([(x, left[x] - (x == seed)) for x in order if x in left and x <= capacity - seed and left[x] > (x == seed)],
                       seed, capacity)
        times = min(left[x] // k for x, k in bin_.items())
        for x, k in bin_.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        order = [x for x in order if x in left]
        bins.append((times, bin_))
    return bins


def _slots(bins: list[tuple[int, Counter]], sequence: int = 0) -> tuple[dict[int, np.ndarray], int]:
    """Per length, rows (first rank, per bin, first sequence, offset): where the pieces of that length go, by rank.

    Sequences are numbered from ``sequence``; the number after the last one is returned too.
    """
    found, used = {}, Counter()
    for times, bin_ in bins:
        offset = 0
        for length, k in sorted(bin_.items(), reverse=True):
            found.setdefault(length, []).append((used[length], k, sequence, offset))
            used[length] += times * k
            offset += k * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}, sequence


def pack(pieces: DataFrame, capacity: int = CAPACITY, turn: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length from 1 to ``capacity``.

    The histogram of lengths has at most ``capacity`` rows whatever the data, so the packing is planned on
    it. Pieces of a length are interchangeable: each gets a rank among them, and the plan gives ranges of
    ranks their places. Ranks come from groups of about GROUP_ROWS pieces, so no length, however frequent,
    meets in one task. Ties in rank order do not matter. No pieces give no sequences.

    ``turn`` names an integer column of a few values, nulls excluded: pieces of a turn are packed among
    themselves, and the sequences of a lesser turn have lesser numbers. A plan is made for each turn.
    """
    by = ["length"] if turn is None else [turn, "length"]
    counts = {(r[turn] if turn else 0, r["length"]): r["n"] for r in pieces.groupBy(*by).agg(F.count("*").alias("n")).collect()}
    slots, sequence = {}, 0
    for t in sorted({t for t, _ in counts}):
        own, sequence = _slots(plan({x: n for (u, x), n in counts.items() if u == t}, capacity), sequence)
        slots |= {(t, x): rows for x, rows in own.items()}
    spark = pieces.sparkSession
    sized = [(*((t, x) if turn else (x,)), -(-n // GROUP_ROWS)) for (t, x), n in counts.items()]
    groups = F.broadcast(spark.createDataFrame(sized, (f"`{turn}` long, " if turn else "") + "length long, _groups long"))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.join(groups, by).withColumn("_group", F.pmod(F.xxhash64(*order), "_groups")).drop("_groups")
    base = (salted.groupBy(*by, "_group").agg(F.count("*").alias("_n"))
            .withColumn("_base", F.sum("_n").over(Window.partitionBy(*by).orderBy("_group")) - F.col("_n")).drop("_n"))
    within = Window.partitionBy(*by, "_group").orderBy(*order)
    ranked = (salted.withColumn("_rank", F.row_number().over(within) - 1).join(base, [*by, "_group"])
              .withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_group", "_base"))
    kept = [f for f in ranked.schema.fields if f.name not in ("_rank", "sequence_id", "offset")]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            turns = b.column(turn).to_numpy() if turn else np.zeros(len(length), np.int64)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for t in np.unique(turns):
                for x in np.unique(length[turns == t]):
                    own = (length == x) & (turns == t)
                    first, per, start, begin = slots[t, x].T
                    at = np.searchsorted(first, rank[own], "right") - 1
                    copy, again = np.divmod(rank[own] - first[at], per[at])
                    sequence[own], offset[own] = start[at] + copy, begin[at] + again * x
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(sequence), pa.array(offset)],
                                             [*[f.name for f in kept], "sequence_id", "offset"])
    return ranked.mapInArrow(place, T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenizes, cuts and packs documents; the pieces are settled, as counting and placing both read them."""
    return pack(settle(tokenize_pieces(documents, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(placed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The token ids of every sequence, in order of offset. Each is at most the capacity long."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = placed.dropDuplicates([*key, "sequence_id", "offset"]).join(pieces_with_ids.dropDuplicates(key).select(*key, "ids"), key)
    return (rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
            .select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids")))
