"""Conversation repair, window filling and periodic runs against plain brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfline.llm import conversation_repair as repair, periodic_runs, window_fill
from shelfline.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
BYTES = "byte_bpe_50k.json"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- conversations -------------------------------------------------------------------------------------------------
def every_edit(rows):
    """(cost, audit) over all edit sequences with at most three inserted rows."""
    best = None

    def legal(roles):
        return re.fullmatch("(s?(ua)+)?", roles)

    def go(i, roles, cost, audit, added):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if legal(roles):
                best = min(best or (cost, audit), (cost, audit))
        else:
            initial, fault = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", added)
            if fault in (0, 3):
                go(i + 1, roles + initial, cost + 5 * (fault == 3), audit + "K", added)
                for x in "ua":
                    go(i + 1, roles + x, cost + 1 + 5 * (fault == 3), audit + "R", added)
        if added < 3:
            for x in "ua":
                go(i, roles + x, cost + 5, audit + "I", added + 1)
    go(0, "", 0, "", 0)
    return best


def test_agenda_finds_the_cheapest_edits():
    rng = random.Random(1)
    for _ in range(120):
        rows = [(rng.choice("uuaas x"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
        assert repair.lightest(rows, repair.START, True)[-1] == every_edit(rows)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_pieces_give_what_the_whole_gives(size):
    rng = random.Random(size)
    for _ in range(150):
        kinds = rng.choice(["uuaas x", "u", "ua", "a"])
        rows = [(rng.choice(kinds), rng.choice([0, 0, 0, 0, 1, 3])) for _ in range(rng.randint(0, 50))]
        tables = [repair.table_of(rows[i:i + size]) for i in range(0, len(rows), size)] or [repair.table_of([])]
        total, path = repair.borders([t[0] for t in tables], [t[1] for t in tables])
        audit = "".join(t[2][4 * b + e] for t, (b, e) in zip(tables, path)) + repair.CLOSING[path[-1][1]][1]
        assert (total, audit) == repair.lightest(rows, repair.START, True)[-1]


def plainly(rows):
    """The report of damaged conversations, one at a time."""
    said = lambda v: " " if v is None else str(v)
    found, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", said(text)) if code == 2 else said(text)
        found[conv] += [(turn, "user" if code == 4 else said(role), text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            ends = WORDS.findall(text)
            faults.append(1 if not ends else 2 if (role, text) in seen else 3 if ends[-1][-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        cost, audit = repair.lightest(list(zip(initials, faults)), repair.START, True)[-1]
        lines = [f"{r}:{t}" for r, t in repair.edited(audit, repair.START, [r for _, r, _ in own], [t for _, _, t in own])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                     sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def held_against_plain(df):
    got = repair.report(repair.repaired_pieces(repair.damaged(df), present="present")).collect()
    want = plainly([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r


def test_conversations_of_the_tables(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    held_against_plain(df)
    assert QUERIES["op11_lightest_repair"](spark, SF).columns == ["conv_id", *repair.REPORT]


def test_odd_conversations(spark, monkeypatch):
    """A conversation with most rows, repeated rows, nulls everywhere, one turn for many rows, other roles, clashing columns."""
    monkeypatch.setattr(repair, "PIECE_ROWS", 16)
    rng = random.Random(3)
    text = lambda: rng.choice(["a.", "b!", "c d", "", " ", "x?\n", "same.", None, "long word. " * 3000] + [f"w{rng.random()}." for _ in range(9)])
    rows = [(rng.choice([1, 2, 3, None] + [7] * 8), rng.choice([None, *range(300)]), rng.choice(["user", "assistant"] * 3 + ["system", "tool", None, ""]), text(), "x", 1)
            for _ in range(700)]
    rows += rows[:40] + [(50 + i, None, "user", "x.", "x", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, _seq int")
    held_against_plain(df.repartition(5))
    held_against_plain(df.where("false"))


def test_conversation_with_every_row_dropped(spark):
    ids = [i for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(i, 0, "user", "hello.") for i in ids], "conv_id long, turn int, role string, text string")
    got = repair.report(repair.repaired_pieces(repair.damaged(df), present="present")).collect()
    assert sorted(r.conv_id for r in got) == ids and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- windows -------------------------------------------------------------------------------------------------------
TEXTS = [None, "", " ", "\n", "Hello, World! it's 42", " ÄÖÜ  straße İstanbul", "a\x1cb\x85c\xa0d", "x<|endoftext|>y", "été ⅷ ½²\n\nzwei", "wort " * 6000, "tail ", "nl\n",
         "'s 'LL it'S don't", "日本語 テキスト。", "a­b _under_ ##\tc", "é, naïve! çœur... ßtraße? a,b ª º µ'll. x.y ...", "a \n b", "q\0r", "one  two   three"]


def test_byte_ids_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(tokenizer_path(BYTES))
    got = window_fill.token_bytes(TEXTS * 2, window_fill.read_tokenizer(tokenizer_path(BYTES)))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS * 2]


def test_byte_ids_of_random_texts():
    """Rare merges: random bytes, letters of many scripts, blanks and signs, in long words and short ones."""
    rng = random.Random(11)
    alphabets = ["abcdefghij", "ABcd ef", "aeiouéèêçöüß ", " \n\t ", "0123456789 .", "!?#$%&'\"-_ ", "абвгд ", "漢字かな ", "\u0301\u200d\u2028\xa0a ", "ſƒɐʒ "]
    texts = ["".join(rng.choice(rng.choice(alphabets) if rng.random() < .2 else a) for _ in range(rng.randint(1, 80))) for _ in range(400) for a in alphabets]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800)])) for _ in range(60)) for _ in range(600)]
    tokenizer = Tokenizer.from_file(tokenizer_path(BYTES))
    got = window_fill.token_bytes(texts, window_fill.read_tokenizer(tokenizer_path(BYTES)))
    assert window_fill._worker(window_fill.read_tokenizer(tokenizer_path(BYTES)))[1] is not None
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_go_through_themselves():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = window_fill.token_bytes(TEXTS, window_fill.read_tokenizer(tokenizer_path()))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("seed", range(40))
def test_plan_fills_windows(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 64, 256])
    lengths = [rng.randint(1 if rng.random() < .7 else window // 2 + 1, window) for _ in range(rng.choice([0, 1, 3, 10, 200]))]
    plan, rank, ranks = window_fill.Plan(Counter(lengths), window), Counter(), []
    for x in lengths:
        ranks.append(rank[x])
        rank[x] += 1
    piece, at, kept, sequence, offset = (c.tolist() for c in window_fill.resolve(plan.rows, np.array(lengths, np.int64), np.array(ranks, np.int64)))
    parts, held = defaultdict(list), defaultdict(list)
    for p, a, k, s, o in zip(piece, at, kept, sequence, offset):
        parts[p].append((a, k))
        held[s].append((o, k))
    for found, sizes in ((parts, dict(enumerate(lengths))), (held, None)):
        for key, own in found.items():
            end = 0
            for a, k in sorted(own):
                assert a == end
                end += k
            assert end == (sizes[key] if sizes else end) and (sizes or end == window or end & (end - 1) == 0)
    assert len(parts) == len(lengths)


def test_fullest_against_all_combinations():
    import itertools
    rng = random.Random(5)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 30) for _ in range(9)), reverse=True)
        got = window_fill.fullest(Counter(lengths), lengths[0], 60)
        best = max(lengths[0] + sum(c) for n in range(9) for c in itertools.combinations(lengths[1:], n) if lengths[0] + sum(c) <= 60)
        assert sum(x * n for x, n in got.items()) == best and all(Counter(lengths)[x] >= n for x, n in got.items())


def test_windows_of_odd_documents(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 5), (None, "null id " * 70, "x", 5), (4, "another text", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int")
    out = window_fill.fill_windows(docs, tokenizer_path(BYTES), window=64).collect()
    tokenizer, sizes, made = Tokenizer.from_file(tokenizer_path(BYTES)), Counter(), Counter()
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    places = defaultdict(list)
    for r in out:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in texts[r.doc_id])
        places[r.sequence_id].append((r.offset, r.length))
        made[r.doc_id] += r.length
    assert made == Counter({i: sum(map(len, t)) for i, t in texts.items()})
    for own in places.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        sizes[end] += 1
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sum(c for n, c in sizes.items() if n < 64) <= 6
    assert window_fill.fill_windows(docs.where("false"), tokenizer_path(BYTES)).count() == 0


def test_window_query(spark):
    out = QUERIES["op12_window_fill"](spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    total = out.agg(F.sum("length")).first()[0]
    sizes = [r.n for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n == 2048 for n in sizes) == total // 2048 and all(n & (n - 1) == 0 for n in sizes)
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d"), F.max("ids_crc32").alias("c"), F.min("ids_crc32").alias("m"))
    assert whole.where("n <> d or m is null").isEmpty()


# --- runs ------------------------------------------------------------------------------------------------------------
def all_runs(words):
    """Maximal stretches that agree with themselves a period on, by period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.randint(0, rng.choice([0, 1, 3, 9])) for _ in range(rng.randint(1, rng.choice([2, 9, 40])))]
        words += block * rng.choice([1, 1, 3, 4, 5, 8, 40])
    return words[:rng.choice([5, 50, 900])]


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng) for _ in range(12)]
    for words, rows in zip(texts, periodic_runs.runs_in([np.array(t, np.int64) for t in texts])):
        assert [tuple(r) for r in rows.tolist()] == all_runs(words)


def test_cover_meets_every_difference():
    assert {(a - b) % periodic_runs.MODULUS for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.MODULUS))


@pytest.mark.parametrize("seed", range(5))
def test_common_extensions(seed):
    rng = random.Random(seed)
    words = np.array([rng.randint(0, 1) if rng.random() < .02 else 0 for _ in range(700)] + [9], np.int64)
    i, j = (np.array([rng.randrange(700) for _ in range(2000)]) for _ in range(2))
    i, j = i[i != j], j[i != j]
    plain = [next(k for k in range(701) if words[a + k] != words[b + k]) if max(a, b) < 700 else 0 for a, b in zip(i, j)]
    assert periodic_runs.CommonExtension(words).common(i, j).tolist() == plain


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n or doc_id is None:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_tables_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 3000)
    odd = [(100_000 + i, t) for i, t in enumerate([None, "", " \t\n", "a", "a " * 5, "a " * 6, "x\xa0y " * 9, "ab " * 30_000, "a b a b a b a b c"])]
    odd += [(100_008, "a b a b a b a b c"), (None, "z z z z z z z")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    docs = docs.withColumn("Runs", F.lit("x")).withColumn("day", F.lit(7)).repartition(3)
    source = defaultdict(list)
    for r in docs.collect():
        source[r.doc_id].append(planted(r.doc_id, WORDS.findall(r.text or "")))
    got = periodic_runs.find_runs(periodic_runs.plant_repeats(docs)).collect()
    assert len(got) == sum(map(len, source.values())) and got[0].day == 7 and "Runs" not in got[0]
    for r in got:
        words = source[r.doc_id][0]
        assert r.n_words == len(words)
        if len(words) > 5000 and len(set(words)) == 1:
            assert [tuple(x) for x in r.runs] == [(0, len(words), 1)] and r.collapsed == words[0]
            continue
        runs = all_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == " ".join(kept)
    assert periodic_runs.find_runs(docs.where("false")).count() == 0


def test_run_query(spark):
    docs = {r.doc_id: planted(r.doc_id, WORDS.findall(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    from fractions import Fraction
    seen = 0
    for r in QUERIES["op13_periodic_runs"](spark, SF).collect():
        runs = all_runs(docs[r.doc_id])
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        seen += len(runs)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    assert seen > 5
