"""Packing against the tokenizer and a bound; mixing against the definition of a Pfair schedule."""
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfline.llm import mixing, packing
from shelfline.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "Hello, World! it's 42", "ÄÖÜ straße İstanbul ΣΑΣ", "a\x1cb\x85c\xa0d", "x<|endoftext|>y <|ENDOFTEXT|>", "été ⅷ ½²", "wort " * 6000,
         "'s 'LL it'S don't", "日本語 テキスト", "a­b _under_ ##",
         "été, naïve! çœur... ßtraße? ÿ; ñandú: a,b ª º µ'll. don't, x.y ...", "thĳs ŉ ĸ."]


def test_ids_equal_the_tokenizer():
    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.token_bytes(TEXTS * 2, open(path, encoding="utf-8").read())
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS * 2]


def test_pieces_and_places(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 5), (None, "null id", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int")
    pieces = packing.tokenize_pieces(docs, tokenizer_path(), 512, 1, with_ids=True)
    out = packing.pack(pieces.drop("ids"), 512).toPandas().sort_values(["sequence_id", "offset"])
    assert len(out) == pieces.count() and (out.groupby("sequence_id").length.sum() <= 512).all()
    for _, g in out.groupby("sequence_id"):
        assert g.offset.tolist() == [0, *itertools.accumulate(g.length.tolist()[:-1])]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for r in pieces.collect():
        if r.doc_id is None:
            continue
        ids = tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [1]
        own = ids[r.start:r.start + 512]
        assert r.ids == own and r.length == len(own) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.start == 512 * r.piece
    whole = packing.sequences(packing.pack(pieces.drop("ids"), 512), pieces).collect()
    assert max(len(r.ids) for r in whole) <= 512


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenize_pieces(none, tokenizer_path())).count() == 0
    assert mixing.mix(none.withColumn("source", F.lit("a"))).count() == 0


def best_fill(seed, others, capacity):
    return max(seed + sum(c) for n in range(len(others) + 1) for c in itertools.combinations(others, n) if seed + sum(c) <= capacity)


@pytest.mark.parametrize("seed", range(12))
def test_bins_are_the_fullest(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(9)]
    counts = Counter(lengths)
    for times, bin_ in packing.plan(dict(counts), 40):
        first = max(x for x, n in counts.items() if n)
        rest = list((counts - Counter({first: 1})).elements())
        assert sum(x * k for x, k in bin_.items()) == best_fill(first, rest, 40)
        for x, k in bin_.items():
            counts[x] -= k * times
    assert not +counts and min(counts.values()) == 0


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(1)
    base = Counter(rng.randint(1, 4096) for _ in range(3000))
    small, large = packing.plan(dict(base)), packing.plan({x: n * 100_000 for x, n in base.items()})
    assert len(large) < 6 * len(small)
    needed = max(-(-sum(x * n for x, n in base.items()) * 100_000 // 4096), 100_000 * sum(n for x, n in base.items() if x > 2048))
    assert needed <= sum(t for t, _ in large) <= 1.01 * needed


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {f"s{i}": i + 1 for i in range(20)}, {"a": 1}, {"a": 1e-9, "b": 1}])
def test_lag_is_under_one_block(weights):
    period = 256
    slots = mixing.quantise(weights, period)
    assert sum(slots.values()) == period and min(slots.values()) >= 1
    table = mixing.turn(slots, period)
    assert sorted(np.concatenate(list(table.values()))) == list(range(period))
    for s, own in table.items():
        done = np.searchsorted(own, np.arange(period + 1))
        assert (np.abs(done - np.arange(period + 1) * slots[s] / period) < 1).all()


def test_phases_use_every_block_once():
    blocks = {"a": 900, "b": 41, "c": 0, "d": 300, "e": 1}
    phases = mixing.schedule(blocks, {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1})
    at = np.concatenate([mixing.place(s, np.arange(n), phases)[1] for s, n in blocks.items() if n])
    assert sorted(at) == list(range(sum(blocks.values())))


def test_mix_keeps_every_row(spark):
    rows = [(i, None if i % 50 == 0 else "t" * (i % 90), None if i % 7 == 0 else f"s{i % 3}", i) for i in range(900)] + [(5, "same", "s1", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot int")
    for weights in (None, {"s1": 2.0, "s2": 1.0, "zz": 1.0}):
        out = mixing.mix(docs, weights, block_chars=200).toPandas()
        assert len(out) == len(rows) and (out.groupby("mix_slot").source.nunique(dropna=False) == 1).all()
        first = out[out.mix_phase == 0].groupby("source", dropna=False).mix_slot.nunique()
        n = out[out.mix_phase == 0].mix_slot.max() + 1
        if weights:
            assert abs(first["s1"] - n * 2 / 3) < 1.1 and set(first.index) == {"s1", "s2"}
