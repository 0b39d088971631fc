"""N-gram Jaccard join over prefix trees of globally ordered n-gram sets."""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from shelfline.operators.graph import components
from shelfline.session import discard, scratch_path, settle, settled_at

from .textkit import LOWER_AZ, SPACE, chunks, mix, raw, release, releasing, signed, words

WORDS = 5
PERCENT = 80
BLOCK_ROWS = 1_000          # sets of a block that one tree holds
PIVOTS = 16                 # sets that every part of a split block also holds
KEYS_PER_TASK = 700_000     # candidate keys that a task holds and compares, about
SHARE = 4                   # how the shares of keys grow from one round to the next
MOST_SHARES = 3             # the first round has a SHARE ** MOST_SHARES-th of the keys at least
DEAL_ROWS = 2_000           # documents of a chunk whose keys are thinned together, less than 2 ** ROW_BITS
ROW_BITS = 11               # bits of a document's number that hold its row in the chunk
CHUNK_KEYS = 1_000_000      # keys of a chunk, about
KEY_BYTES = 6               # bytes of a key that are sent
BIN_ROWS = 2_000            # sets per task group, many small blocks together
SIGN_ROWS = 3_000           # documents of a stretch in which n-grams are counted
COMMON_DOCS = 3             # different sets of a stretch that make an n-gram common there
COMMON_GRAMS = 400_000      # common n-grams that tasks know, at most


def ngram_sets(texts, n: int) -> list[np.ndarray]:
    """Per text its sorted distinct n-gram hashes: the global order of n-grams is the order of their hashes.

    A text of fewer than n words has one: its whole sequence. A text without words has none.
    """
    texts = [raw(t).translate(LOWER_AZ) for t in texts]
    place = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    out = []
    for lo, hi in chunks(texts):
        w = words(texts[lo:hi], ~SPACE)
        first = np.searchsorted(w.doc, np.arange(hi - lo + 1))
        gram = np.zeros(0, np.uint64)
        if len(w.hash) >= n:
            gram = sum(w.hash[i:len(w.hash) - n + 1 + i] * place[i] for i in range(n))
            gram = mix(gram)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= n:
                out.append(np.unique(gram[a:b - n + 1]))
            elif b > a:
                short = (w.hash[a:b] * place[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; equal sets have equal digests."""
    a = int(mix(s).sum(dtype=np.uint64)) + len(s)
    b = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) ^ (len(s) << 17)
    return ((a + 2 ** 63) % 2 ** 64) - 2 ** 63, ((b + 2 ** 63) % 2 ** 64) - 2 ** 63


class Segments:
    """Keys under which any two sets that link share at least one.

    Sizes fall into classes so wide that linked sets are in the same or in neighbouring classes; a set has
    keys for its own class and the next. In a class, two linked sets differ in at most d n-grams. The order
    of n-grams is cut into m > d stretches, so m - d stretches or more hold the same n-grams in both: the
    class, the stretch and its n-grams are a key. ``common`` n-grams (any set of them) are left out of the
    stretches, so that a passage of many documents makes no keys. What is common to both may then be empty
    stretches only; a set with more than m - d - 1 empty ones therefore has keys over all its n-grams too,
    and if those leave as many stretches empty, its single n-grams up to the prefix length.
    """

    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.percent, self.low = percent, [1]
        self.common = np.zeros(0, np.uint64) if common is None else np.sort(common)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.common & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def _class_of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def _rare(self, s: np.ndarray) -> np.ndarray:
        out = np.flatnonzero(self.maybe[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(out) or not len(self.common):
            return s
        at = np.minimum(np.searchsorted(self.common, s[out]), len(self.common) - 1)
        return np.delete(s, out[self.common[at] == s[out]])

    @staticmethod
    def _stretches(s: np.ndarray, m: int, tag: int) -> np.ndarray:
        if not len(s):
            return s
        stretch = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1])))
        return mix(np.add.reduceat(mix(s + np.uint64(7)), start) + mix((stretch[start] << np.uint64(20)) + np.uint64(tag)))

    def keys(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        own, found, rare = self._class_of(len(s)), [], self._rare(s)
        for c in (own, own + 1):
            self._class_of(self.low[c])
            d = 2 * (self.low[c + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            spare = 1 + d // 8
            m = d + 1 + spare
            found.append(self._stretches(rare, m, 4 * c))
            if m - len(found[-1]) > spare and len(rare) < len(s):
                found.append(self._stretches(s, m, 4 * c + 1))
            if m - len(found[-1]) > spare:
                prefix = len(s) - -(-len(s) * self.percent // 100) + 1
                found.append(mix(s[:prefix] + mix(np.array([4 * c + 2], np.uint64))))
        return np.concatenate(found)


class Forest:
    """Smallest-root union-find over positions."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.find(a), self.find(b)))
        self.root[b] = a
        return a != b


class PrefixTree:
    """A path-compressed trie of n-gram sets, kept level by level in arrays.

    The order of n-grams is by falling frequency among the sets, so that similar sets begin alike and share
    nodes. A probe's overlap with a node is counted once for all sets below it, for a whole level at a time.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        vocabulary, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(vocabulary))
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = rank[inverse]
        tokens = tokens[np.lexsort((tokens, owner))]
        self.words, self.sets = len(vocabulary), np.split(tokens, np.cumsum([len(s) for s in sets])[:-1])
        order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        length = np.array([len(self.sets[i]) for i in order])
        same = np.zeros(len(order), np.int64)                   # n-grams that a set shares with the one before it
        for k in range(1, len(order)):
            x, y = self.sets[order[k - 1]], self.sets[order[k]]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            same[k] = differ[0] if len(differ) else n
        self.levels = []
        open_ = [(lo, hi, 0, 0) for lo, hi in self._cut(same, 0, len(order), 0)]
        while open_:
            grams, rows, members, below = [], [], [], []
            for at, (lo, hi, depth, parent) in enumerate(open_):
                end = min(int(same[lo + 1:hi].min()), int(length[lo])) if hi - lo > 1 else int(length[lo])
                grams.append(self.sets[order[lo]][depth:end])
                rows.append((parent, end, int(grams[-1][-1]), int(length[lo:hi].min()), int(length[lo:hi].max())))
                while lo < hi and length[lo] == end:
                    members.append((at, order[lo]))
                    lo += 1
                below += [(x, y, end, at) for x, y in self._cut(same, lo, hi, end)]
            start = np.cumsum([0, *[len(g) for g in grams[:-1]]])
            self.levels.append((np.concatenate(grams), start, *np.array(rows).T, np.array(members, np.int64).reshape(-1, 2).T))
            open_ = below

    @staticmethod
    def _cut(same: np.ndarray, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
        """Runs of sets in order that agree beyond ``depth``."""
        cuts = [lo, *(lo + 1 + np.flatnonzero(same[lo + 1:hi] <= depth)).tolist(), hi]
        return [(x, y) for x, y in zip(cuts[:-1], cuts[1:]) if x < y]

    def linked(self, probe: int) -> np.ndarray:
        """Sets linked to a set of the tree, itself included.

        Down a path, ``got`` n-grams are common, ``passed`` of the probe's and ``depth`` of the path's lie
        behind. The overlap cannot exceed got plus what is left on either side; a subtree whose smallest
        union is too large for that goes, and a level without any other ends the search.
        """
        own = self.sets[probe]
        size, mark, found = len(own), np.zeros(self.words, np.int64), []
        mark[own] = 1
        behind = np.cumsum(mark)
        got, alive = np.zeros(1, np.int64), np.ones(1, bool)
        for grams, start, parent, depth, last, least, most, (at, member) in self.levels:
            got, alive = got[parent] + np.add.reduceat(mark[grams], start), alive[parent]
            best = np.minimum(got + np.minimum(size - behind[last], most - depth), size)
            alive = alive & (100 * best >= self.percent * (size + np.maximum(least, best) - best))
            if not alive.any():
                break
            ends = alive[at] & (100 * got[at] >= self.percent * (size + depth[at] - got[at]))
            found.append(member[ends])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def spanning_links(sets: list[np.ndarray], start: list[int], percent: int, needed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what links connect, given that equal ``start`` values are connected already.

    If ``needed`` is given, pairs of two sets that are both not needed are left out. The search ends when
    all sets are one component.
    """
    forest, seen, out = Forest(len(sets)), {}, []
    some = [i for i, s in enumerate(sets) if len(s)]
    left = len(some)
    for i in some:
        left -= forest.join(i, seen.setdefault(start[i], i))
    if left < 2:
        return out
    tree = PrefixTree([sets[i] for i in some], percent)
    for k, i in enumerate(some):
        if needed is not None and not needed[i]:
            continue
        for other in tree.linked(k):
            j = some[other]
            if forest.join(i, j):
                out.append((i, j))
                left -= 1
        if left < 2:
            break
    return out


def signatures(documents: DataFrame, n: int) -> DataFrame:
    """Per row doc_id, n_shingles and the 128-bit digest of the n-gram set (``docs`` is 0), and per task the
    n-grams that at least COMMON_DOCS different sets of SIGN_ROWS documents in a row hold (doc_id null, h1 the n-gram, ``docs``
    how many): one pass over all texts for both. Only sets are kept from batch to batch, so batches may be small."""
    def often(different):
        grams = np.sort(np.concatenate(list(different.values()))) if different else np.zeros(0, np.uint64)
        at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
        held = np.diff(np.append(at, len(grams)))
        some = held >= COMMON_DOCS
        if some.any():
            yield pd.DataFrame({"doc_id": pd.array([None] * int(some.sum()), "Int64"), "n_shingles": np.int64(0),
                                "h1": signed(grams[at[some]]), "h2": np.int64(0), "docs": held[some].astype(np.int64)})

    def sign(batches):
        different, rows = {}, 0
        for whole in batches:
            at = 0
            while at < len(whole):
                b = whole.iloc[at:at + SIGN_ROWS - rows]
                sets = ngram_sets(b["text"], n)
                d = [digest(s) for s in sets]
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_shingles": np.array([len(s) for s in sets], np.int64),
                                    "h1": np.array([x[0] for x in d], np.int64), "h2": np.array([x[1] for x in d], np.int64), "docs": np.int64(0)})
                different.update(zip(d, sets))
                at, rows = at + len(b), rows + len(b)
                if rows == SIGN_ROWS:
                    yield from often(different)
                    different, rows = {}, 0
        yield from often(different)
    return documents.select("doc_id", "text").mapInPandas(releasing(sign), "doc_id long, n_shingles long, h1 long, h2 long, docs long")


def common_grams(signs: DataFrame, most: int) -> np.ndarray:
    """The most frequent n-grams, ``most`` at most, as far as a threshold on a power of two allows.

    Any set of n-grams gives exact results; this one keeps passages of many documents from making candidate
    pairs. Its size is bounded by the parameter, so it is sent to the tasks.
    """
    counts = settle(signs.where("docs > 0").groupBy("h1").agg(F.sum("docs").alias("docs")), "common")
    sizes = {r["p"]: r["n"] for r in counts.groupBy(F.floor(F.log2("docs")).alias("p")).agg(F.count("*").alias("n")).collect()}
    total, power = 0, max(sizes, default=0) + 1
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > most:
            break
        power = p
    return np.array([r["h1"] for r in counts.where(F.col("docs") >= 2 ** int(power)).select("h1").toLocalIterator()], np.int64).view(np.uint64)


def _chain(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key: the first of each run of equal keys, and links from each further document to the one before."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    again = key[1:] == key[:-1]
    edge = np.unique(np.stack([doc[:-1][again], doc[1:][again]], 1), axis=0)
    return np.concatenate(([True], ~again)) if len(key) else np.zeros(0, bool), order, edge[edge[:, 0] != edge[:, 1]]


def _shares(tasks: float) -> list[float]:
    """Upper ends of the shares of keys that the rounds take; a few tasks' worth of keys needs one round."""
    first = 0
    while first < MOST_SHARES and SHARE ** first < tasks:
        first += 1
    return [1 / SHARE ** k for k in range(first, -1, -1)]


def _packed(key: np.ndarray) -> bytes:
    """The lower KEY_BYTES of every key. Keys that agree in them only make candidates, never links."""
    return np.ascontiguousarray(key).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8").astype(np.int64)


def _nodes(chunk: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Numbers of the documents of a chunk: their own, or those they go by (``to``)."""
    out = (np.int64(chunk) << ROW_BITS) + np.arange(1 << ROW_BITS)
    out[at] = to
    return out


def _cuts(sizes: list[int]) -> list[int]:
    """Ends of stretches of at most DEAL_ROWS documents and about CHUNK_KEYS keys."""
    ends, rows, keys = [], 0, 0
    for i, n in enumerate(sizes):
        if rows and (rows == DEAL_ROWS or keys + n > CHUNK_KEYS):
            ends.append(i)
            rows = keys = 0
        rows, keys = rows + 1, keys + n
    return [*ends, len(sizes)] if sizes else []


def _seats(spark, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning sends there."""
    ids, found = 32 * n, {}
    while len(found) < n:
        place = spark.range(ids).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
        found, ids = {r["p"]: r["id"] for r in place.collect()}, 2 * ids
    return [found[i] for i in range(n)]


def _by_chunk(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` settled in buckets of their chunk, so that a join on the chunk leaves them where they are."""
    path, name = scratch_path(rows.sparkSession, "keys"), f"shelfline_keys_{uuid.uuid4().hex[:12]}"
    settled_at(path)
    rows.write.bucketBy(buckets, "chunk").option("path", path).format("parquet").saveAsTable(name)
    found = rows.sparkSession.table(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")         # the name only: files at a given path stay
    return found


def candidates(documents: DataFrame, n: int, percent: int, common: np.ndarray | None, grams: int) -> DataFrame:
    """Edges (a, b) that connect all documents sharing a key of ``Segments``; settled.

    ``grams`` is the number of n-grams of all sets. From it follows how many tasks the keys are dealt to. A
    pair with many keys in common would be found by each task that gets one of them, so the keys are dealt in
    rounds of growing shares, each key in one round, by a hash. After a round, documents go by the smallest
    number of their component so far, so what is connected already makes no rows.

    Keys are made in one pass over the texts and set aside by chunks of documents, one column for each round.
    A document is numbered by its chunk and its row there. Chunks lie in buckets: before a round the numbers
    that documents go by are sent to their chunk, and keys are not moved for it.

    Keys of a chunk are thinned before the shuffle: of the documents with a key in common one
    goes on, and the others are chained to it. So a frequent key is sent once per chunk, and a key shared by
    k documents makes k - 1 edges, never all pairs. What a chunk sends to a task is one row of packed keys.
    """
    spark = documents.sparkSession
    tasks = grams * 3 * (100 - percent) / (100 * KEYS_PER_TASK)
    shares = _shares(tasks)
    ends = np.array([min(int(x * 2 ** 32), 2 ** 32) for x in shares], np.uint64)
    names = [f"{c}{i}" for i in range(len(shares)) for c in "kr"]

    def emit(batches):
        maker, chunk = Segments(percent, common), TaskContext.get().partitionId() << 20
        for b in batches:
            for at in range(0, len(b), DEAL_ROWS):
                part = b.iloc[at:at + DEAL_ROWS]
                ids, found, lo = part["doc_id"].to_numpy(np.int64), [maker.keys(s) for s in ngram_sets(part["text"], n)], 0
                for hi in _cuts([len(k) for k in found]):
                    key = np.concatenate(found[lo:hi])
                    row = np.repeat(np.arange(hi - lo, dtype=np.uint16), [len(k) for k in found[lo:hi]])
                    turn = np.searchsorted(ends, mix(key) >> np.uint64(32), "right")
                    out = {"chunk": chunk, "ids": ids[lo:hi].tobytes()}
                    for i in range(len(shares)):
                        out |= {f"k{i}": _packed(key[turn == i]), f"r{i}": row[turn == i].tobytes()}
                    yield pd.DataFrame([out])
                    chunk, lo = chunk + 1, hi

    def deal(seats):
        def run(batches):
            for b in batches:
                for r in b.itertuples():
                    at, to = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (r.at, r.to))
                    own, row = _nodes(r.chunk, at, to), np.frombuffer(r.rows, np.uint16)
                    key = _unpacked(r.keys)
                    first, order, edge = _chain(key, own[row])
                    key, row = key[order][first], row[order][first]       # in the order of the tasks, as keys are sorted
                    task = ((key >> 16) * len(seats)) >> 32
                    moved = own != _nodes(r.chunk, at[:0], to[:0])
                    start = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1]))) if len(task) else task
                    out = []
                    for lo, hi in zip(start, [*start[1:], len(task)]):
                        known = np.unique(row[lo:hi])
                        known = known[moved[known]]
                        out.append((seats[task[lo]], r.chunk, _packed(key[lo:hi]), row[lo:hi].tobytes(), known.tobytes(), own[known].tobytes(), b""))
                    if len(edge):
                        out.append((seats[r.chunk % len(seats)], r.chunk, b"", b"", b"", b"", edge.tobytes()))
                    yield pd.DataFrame(out, columns=["task", "chunk", "keys", "rows", "at", "to", "pairs"])
        return run

    def join(batches):
        keys, docs, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for b in batches:
            for r in b.itertuples():
                keys.append(_unpacked(r.keys))
                docs.append(_nodes(r.chunk, np.frombuffer(r.at, np.uint16), np.frombuffer(r.to, np.int64))[np.frombuffer(r.rows, np.uint16)])
                pairs.append(np.frombuffer(r.pairs, np.int64).reshape(-1, 2))
        _, _, edge = _chain(np.concatenate(keys), np.concatenate(docs))
        edge = np.unique(np.concatenate([edge, *pairs]), axis=0)
        yield pd.DataFrame({"a": edge[:, 0], "b": edge[:, 1]})

    def names_of(batches):
        for b in batches:
            for r in b.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                yield pd.DataFrame({"node": _nodes(r.chunk, ids[:0], ids[:0])[:len(ids)], "doc_id": ids})
    schema = ", ".join(["chunk long, ids binary", *[f"{c} binary" for c in names]])
    keys = _by_chunk(documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(releasing(emit), schema), max(1, round(tasks)))
    found, before = None, 0.0
    for i, share in enumerate(shares):
        rows = keys.select("chunk", F.col(f"k{i}").alias("keys"), F.col(f"r{i}").alias("rows"))
        if found is None:
            rows = rows.withColumns({"at": F.lit(None).cast("array<long>"), "to": F.lit(None).cast("array<long>")})
        else:
            row = F.struct(F.col("node").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"), "component")
            go_by = components(found).where("node <> component").groupBy(F.shiftright("node", ROW_BITS).alias("chunk")).agg(F.collect_list(row).alias("_go"))
            rows = rows.join(settle(go_by, "go_by"), "chunk", "left").select("chunk", "keys", "rows", F.col("_go.row").alias("at"), F.col("_go.component").alias("to"))
        seats = _seats(spark, max(1, round(tasks * (share - before))))
        dealt = rows.mapInPandas(releasing(deal(seats)), "task long, chunk long, keys binary, rows binary, at binary, to binary, pairs binary").repartition(len(seats), "task")
        edges = settle(dealt.mapInPandas(releasing(join), "a long, b long").distinct(), "candidates")
        found, before = edges if found is None else found.unionByName(edges), share
    named = components(found).join(keys.select("chunk", "ids").mapInPandas(names_of, "node long, doc_id long"), "node").select("component", F.col("doc_id").alias("a"))
    named = settle(named, "named")
    discard(keys)       # about as large as the input
    return settle(named.join(named.groupBy("component").agg(F.min("a").alias("b")), "component").select("a", "b"), "candidates")


def _compare(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Spanning links within each (block, part) of members with texts; rows of many parts share a task group."""
    def trees(rows):
        a, b = [], []
        for _, part in rows.groupby(["block", "part"], sort=True):
            sets, ids = ngram_sets(part["text"], n), part["doc_id"].to_numpy()
            for i, j in spanning_links(sets, part["comp"].tolist(), percent, part["needed"].to_numpy()):
                a.append(ids[i])
                b.append(ids[j])
        release()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
    return members.groupBy("bin").applyInPandas(trees, "a long, b long")


def link_documents(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links), one row per input row.

    Two documents link when the Jaccard similarity of their sets of lower-cased n-word shingles reaches
    ``percent`` per cent. Exact: no limit on partners or group sizes.

    1. Documents with equal sets are linked through their digest and the smallest id stands for them.
    2. Representatives that share a key (``candidates``) form blocks; no link leaves a block.
    3. A block's texts go through prefix trees. A large block is split by the sizes of the sets into parts of
       BLOCK_ROWS that share PIVOTS sets; what a part leaves apart from the block's largest component is then
       compared with all parts of the block whose sizes are near enough for a link.
    4. Components of all links found.

    Null or empty texts have no shingles and link with nothing. A null doc_id links with nothing and has a
    null component. Rows that repeat a doc_id with other texts share the smallest of their components. Other
    columns are not read.
    """
    passed = settle(signatures(documents, n), "signatures")
    signs = passed.where("docs = 0").drop("docs")
    sets = signs.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2").distinct()
    reps = sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    copies = settle(sets.join(reps, ["h1", "h2"]).select("doc_id", "rep", "n_shingles"), "copies")
    grams = signs.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    edges = candidates(documents, n, percent, common_grams(passed, COMMON_GRAMS), grams)
    blocks = components(edges)
    members = (copies.where("doc_id = rep").join(blocks, copies["doc_id"] == blocks["node"])
               .select("doc_id", "n_shingles", F.col("component").alias("block")))
    sizes = members.groupBy("block").agg(F.count("*").alias("size")).where("size > 1")
    members = settle(members.join(sizes, "block"), "members")
    parts = F.ceil(F.col("size") / F.lit(BLOCK_ROWS)).cast("int")
    # only members' texts are read again and again, so they are set aside once
    texts = settle(documents.select("doc_id", "text").join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")

    def with_texts(rows: DataFrame) -> DataFrame:
        """Rows (doc_id, block, part, comp, needed) with their texts and a bin of about BIN_ROWS rows."""
        bins = max(1, -(-rows.count() // BIN_ROWS))
        bin_ = F.when(F.col("size") > BLOCK_ROWS // 4, F.xxhash64("block", "part")).otherwise(F.pmod(F.xxhash64("block"), F.lit(bins)))
        return rows.withColumn("bin", bin_).join(texts, "doc_id").drop("size")

    split = members.where(F.col("size") > BLOCK_ROWS)
    # in the order of their sizes, from one row per block and size; sets of one size are dealt by hash
    counts = split.groupBy("block", "n_shingles").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("block").orderBy("n_shingles")) - F.col("_n"))
    place = F.col("_before") + F.pmod(F.xxhash64("doc_id"), "_n")
    split = settle(split.join(counts, ["block", "n_shingles"]).withColumn("part", F.floor(place / BLOCK_ROWS).cast("int")).drop("_n", "_before"), "split")
    drawn = split.withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(1)), "size")).where(F.col("_h") < 4 * PIVOTS)
    pivots = (drawn.withColumn("_r", F.row_number().over(Window.partitionBy("block").orderBy("_h", "doc_id")))
              .where(F.col("_r") <= PIVOTS).drop("_h", "_r"))
    everywhere = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("doc_id", "block", "size", "part")
    first = members.where(F.col("size") <= BLOCK_ROWS).withColumn("part", F.lit(0)).unionByName(split).select("doc_id", "block", "size", "part")
    first = settle(first.unionByName(everywhere).distinct()
                   .withColumn("comp", F.col("doc_id")).withColumn("needed", F.lit(True)), "parts")
    links = settle(_compare(with_texts(first), n, percent), "links")
    if not split.isEmpty():
        links = settle(links.unionByName(_across(split, links, with_texts, n, percent)), "links")
    comp = components(links)
    discard(texts, first, members, split)
    comp = (copies.join(comp, copies["rep"] == comp["node"], "left")
            .groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component")))
    return (signs.join(comp, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def _across(split: DataFrame, links: DataFrame, with_texts, n: int, percent: int) -> DataFrame:
    """Links between components of a split block that no part could see.

    Parts hold stretches of sizes, and sets that link differ little in size, so a part meets only the parts whose
    sizes are near enough. Everything outside a block's largest component is needed; pairs inside it are connected
    and not compared, and a part's own pairs were compared before. Of two parts the second one's needed sets are
    probes only if the first holds some of the largest component, which are none.
    """
    comp = components(links).select(F.col("node").alias("doc_id"), "component")
    state = settle(split.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component"), "state")
    by_comp = state.groupBy("block", "comp").agg(F.count("*").alias("n"))
    main = by_comp.groupBy("block").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    state = settle(state.join(main, "block").withColumn("needed", F.col("comp") != F.col("main")), "state")
    ranges = settle(state.groupBy("block", "part").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"),
                                                       F.count_if("needed").alias("probes"), F.count_if(~F.col("needed")).alias("rest")), "ranges")
    x, y = (ranges.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("part", "lo", "hi", "probes", "rest")]) for s in "xy")
    near = (F.col("hi_x") * 100 >= F.col("lo_y") * percent) & (F.col("hi_y") * 100 >= F.col("lo_x") * percent)
    pairs = x.join(y, "block").where("part_x < part_y and probes_x + probes_y > 0").where(near)
    pairs = settle(pairs.select("block", "part_x", "part_y", (F.col("rest_x") > 0).alias("both")), "part_pairs")
    to = F.col("part_x") * F.ceil(F.col("size") / BLOCK_ROWS).cast("int") + F.col("part_y")
    side = lambda own, probe: (state.withColumnRenamed("part", own).join(pairs, ["block", own])
                               .select("doc_id", "block", "size", "comp", probe.alias("needed"), to.alias("part")))
    rows = side("part_x", F.col("needed")).unionByName(side("part_y", F.col("needed") & F.col("both")))
    return _compare(with_texts(settle(rows, "portions")), n, percent)


def deduplicate(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows whose document stands for its group: one row per component, all columns as they are.

    Of rows that repeat the standing doc_id the one with the smallest hash stays. Rows with a null doc_id,
    and documents without shingles, stay: they link with nothing. Empty documents are no copies.
    """
    same = F.col("doc_id") == F.col("component_id")
    ids = link_documents(documents, n, percent).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.first(same).alias("stands"))
    # only ids are grouped: texts are moved where an id is repeated, and not where it is the only one of its row
    apart = settle(ids.where("rows > 1 or not stands"), "apart")
    columns = [F.col(f"`{f.name}`") for f in documents.schema.fields]
    single = documents.join(apart.select("doc_id"), "doc_id", "left_anti").select(*columns)
    repeated = apart.where("stands").select("doc_id")
    if repeated.isEmpty():
        return single
    hashed = [F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    kept = (documents.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*columns).alias("_row"), F.xxhash64(*hashed).alias("_hash"))
            .groupBy("doc_id").agg(F.min_by("_row", "_hash").alias("_row")))
    return single.unionByName(kept.select("_row.*"))
