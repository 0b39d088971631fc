"""Periodic runs of words: longest common extensions from a difference cover drive a harmonic grid of candidates."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

CHUNK_WORDS = 200_000       # words that are searched together; a longer text is searched alone
PAIR_BLOCK = 2_000_000      # grid pairs looked at together
LEAST_WORDS, LEAST_TIMES = 6, 4

# Residues modulo MODULUS whose differences give every residue.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class CommonExtension:
    """Longest common extensions of suffixes of an integer array, in O(MODULUS) word comparisons each.

    Only suffixes at positions whose residue is in COVER are sorted: first by their leading MODULUS words,
    then by prefix doubling, where the suffix MODULUS words on is the next one of the same residue. For any two
    positions some shift below MODULUS brings both to the cover; up to there words are compared, beyond it a
    range minimum over the neighbours' common prefixes answers. Every text in the array must end in an integer
    that occurs nowhere else, and both positions of a question must lie in one text.
    """
    _residue = np.zeros(MODULUS, bool)
    _residue[list(COVER)] = True
    _a, _b, _k = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    SHIFT = (_residue[(_a + _k) % MODULUS] & _residue[(_b + _k) % MODULUS]).argmax(axis=2)

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate((words, np.full(2 * MODULUS, -1, words.dtype)))
        per = [np.arange(r, n, MODULUS) for r in COVER]
        self.first = np.zeros(MODULUS, np.int64)
        self.first[list(COVER)] = np.cumsum([0, *map(len, per)])[:-1]
        position = np.concatenate(per)
        m = len(position)
        last = np.zeros(m, bool)                    # the last sample of its residue has no follower
        last[[e - 1 for e in np.cumsum([len(p) for p in per]) if e]] = True
        order, rank = self._leading(position)
        levels = [rank]
        while m and rank.max() + 1 < m and (1 << len(levels) - 1) * MODULUS < n:
            ahead = self._ahead(rank, 1 << len(levels) - 1, last)
            key = rank.astype(np.int64) * (m + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
            levels.append(rank)
        self.place = np.empty(m, np.int64)
        self.place[order] = np.arange(m)
        self.table = self._minima(self._neighbours(order, levels, position))

    @staticmethod
    def _ahead(rank: np.ndarray, steps: int, last: np.ndarray) -> np.ndarray:
        """1 + the rank ``steps`` samples on in the same residue, 0 beyond its end."""
        run = np.cumsum(np.concatenate(([0], last[:-1])))
        out = np.zeros(len(rank), np.int64)
        if steps < len(rank):
            same = run[steps:] == run[:-steps]
            out[:-steps][same] = rank[steps:][same] + 1
        return out

    def _leading(self, position: np.ndarray):
        """Order and dense rank of the samples by their leading MODULUS words, three words to a key, last key first."""
        width = int(self.words.max()) + 2
        per = 1
        while width ** (per + 1) < 1 << 62:
            per += 1
        keys = []
        for at in range(0, MODULUS, per):
            key = np.zeros(len(position), np.int64)
            for k in range(at, min(at + per, MODULUS)):
                key = key * width + self.words[position + k] + 1
            keys.append(key)
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(position), bool)
        for key in keys:
            fresh[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(position), np.int64)
        rank[order] = np.cumsum(fresh)
        return order, rank

    def _neighbours(self, order: np.ndarray, levels: list, position: np.ndarray) -> np.ndarray:
        """Common prefix lengths of neighbours in the order: halving steps over the levels, then words."""
        a, b = order[:-1].copy(), order[1:].copy()
        found, rest = np.zeros(len(a), np.int64), np.arange(len(a))
        for t in reversed(range(len(levels))):
            same = levels[t][a] == levels[t][b]         # so both go on in their texts, as no two separators agree
            found[same] += MODULUS << t
            a[same] += 1 << t
            b[same] += 1 << t
        x, y = position[a], position[b]
        for _ in range(MODULUS):
            same = self.words[x] == self.words[y]
            rest, x, y = rest[same], x[same] + 1, y[same] + 1
            if not len(rest):
                break
            found[rest] += 1
        return found

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values]
        while 2 << len(table) - 1 <= len(values):
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = (self.place[self.first[p % MODULUS] + p // MODULUS] for p in (i, j))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for t in np.unique(level):
            own = level == t
            out[own] = np.minimum(self.table[t][lo[own]], self.table[t][hi[own] - (1 << t)])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same; i and j differ."""
        shift = self.SHIFT[i % MODULUS, j % MODULUS]
        out, rest = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(MODULUS):
            at_cover = shift[rest] == t
            if at_cover.any():
                met = rest[at_cover]
                out[met] = t + self._sampled(i[met] + t, j[met] + t)
                rest = rest[~at_cover]
            same = self.words[i[rest] + t] == self.words[j[rest] + t]
            out[rest[~same]] = t
            rest = rest[same]
            if not len(rest):
                break
        return out


def _grid(sizes: np.ndarray, starts: np.ndarray):
    """Blocks of grid pairs (text, position, period). A run of ``LEAST_TIMES`` periods agrees with itself one
    period on over three periods of positions at least, so every third multiple of the period meets it."""
    most = np.where(sizes >= LEAST_WORDS, sizes // LEAST_TIMES, 0)
    total = int(most.sum())
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(1, total + 1) - np.repeat(np.cumsum(most) - most, most)
    step = (LEAST_TIMES - 1) * period
    count = (sizes[text] - 1 - period) // step + 1
    done = np.cumsum(count)
    lo = 0
    while lo < total:
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIR_BLOCK, "right")))
        c = count[lo:hi]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        t, q = np.repeat(text[lo:hi], c), np.repeat(period[lo:hi], c)
        yield t, starts[t] + k * np.repeat(step[lo:hi], c), q
        lo = hi


def _agreeing(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray):
    """Grid pairs whose words agree here and on one side at least, as (text, position, period).

    Words beyond a text are separators, which agree with nothing; one stands before the first text too.
    """
    found = [np.zeros((3, 0), np.int64)]
    for t, i, q in _grid(sizes, starts):
        same = words[i] == words[i + q]
        t, i, q = t[same], i[same], q[same]
        side = (words[i + 1] == words[i + q + 1]) | (words[i - 1] == words[i + q - 1])
        found.append(np.array((t[side], i[side], q[side])))
    return np.concatenate(found, axis=1)


def runs_in(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) of every run of each text of word numbers, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    high = max((int(t.max()) for t in texts if len(t)), default=0) + 1

    def laid_out(some: np.ndarray):
        """A separator, then each text and a separator of its own."""
        parts = [np.array([high])]
        for n, k in enumerate(some):
            parts += [texts[k], np.array([high + 1 + n])]
        width = sizes[some] + 1
        return np.concatenate(parts).astype(np.int64), np.cumsum(width) - width + 1

    words, starts = laid_out(np.arange(len(texts)))
    text, at, period = _agreeing(words, sizes, starts)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(text):
        return out
    some, text = np.unique(text, return_inverse=True)
    at -= starts[some[text]]
    words, starts = laid_out(some)          # only texts with a candidate are indexed
    i = starts[text] + at
    onward = CommonExtension(words).common(i, i + period)
    backward = CommonExtension(words[::-1]).common(len(words) - i, len(words) - i - period)
    start, length = at - backward, onward + backward + period
    long = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    text, start, length, period = text[long], start[long], length[long], period[long]
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    # a multiple of a run's period gives the same stretch again
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, rows = text[fresh], np.stack((start, length, period), axis=1)[fresh]
    order = np.lexsort((rows[:, 2], rows[:, 0], text))
    text, rows = text[order], rows[order]
    edge = np.searchsorted(text, np.arange(len(some) + 1))
    for k, n in enumerate(some):
        out[n] = rows[edge[k]:edge[k + 1]]
    return out


def kept_words(n: int, rows: np.ndarray) -> np.ndarray:
    """False for words that some run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, rows[:, 0] + rows[:, 2], 1)
    np.add.at(step, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def find_runs(documents: DataFrame) -> DataFrame:
    """Adds n_words, runs (start, length, period; by start, then period) and collapsed to every row.

    Words are stretches of anything but the blanks of ASCII. A run is a stretch of words with smallest period q,
    of at least max(6, 4q) words, that no neighbouring word extends. ``collapsed`` joins, by one blank, the words
    that no run holds after its first period. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Other columns stay; those with the new names, in any case, are replaced.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())]
    taken = {f.name.lower() for f in fields}
    base = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in taken])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(texts: list[list[bytes]]):
        flat = [w for t in texts for w in t]
        numbers = pd.factorize(np.array(flat, object))[0] if flat else np.zeros(0, np.int64)
        cuts = np.cumsum([len(t) for t in texts])
        return runs_in(np.split(numbers, cuts[:-1]))

    def apply(batches):
        for b in batches:
            column, at, names = b.column(b.schema.get_field_index("text")), 0, b.schema.names
            while at < b.num_rows:
                texts, held, lo = [], 0, at
                while at < b.num_rows and (not texts or held < CHUNK_WORDS) and at - lo < 4096:
                    # whole texts, a long one alone
                    words = (column[at].as_py() or "").encode("utf-8").split()
                    if texts and held + len(words) > CHUNK_WORDS:
                        break
                    texts.append(words)
                    held, at = held + len(words), at + 1
                found = search(texts)
                collapsed = [b" ".join(t if not len(r) else [w for w, k in zip(t, kept_words(len(t), r)) if k]).decode("utf-8")
                             for t, r in zip(texts, found)]
                sizes = np.array([len(r) for r in found], np.int64)
                rows = np.concatenate(found)
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                                                pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(3)], fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, at - lo).columns, pa.array([len(t) for t in texts], pa.int64()), runs, pa.array(collapsed, pa.string())],
                                                 [*names, "n_words", "runs", "collapsed"])
    return base.mapInArrow(apply, T.StructType([*base.schema.fields, *fields]))


def strongest(runs: str | Column) -> Column:
    """The run with the greatest length / period, compared in whole numbers; the first of equals; null without runs."""
    c = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(c, F.get(c, 0), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def plant_repeats(documents: DataFrame) -> DataFrame:
    """A tenth of the documents, by the crc32 of their id, goes on repeating a stretch from some word to its end.

    With h the crc32, g = floor(h / 10) and n words, word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). A null id or a text without words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(ws, a + (i - a) % p))
        return F.array_join(F.concat(F.slice(ws, F.lit(1), a), tail), " ")
    planted = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(F.array(words), repeated), 0))
    return documents.withColumn("text", F.coalesce(planted, "text"))
