"""Toxicity by a factorization machine over hashed terms."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .textkit import (LETTERLIKE, chunks, labelled_sample, raw, run_hash, sampled_texts, with_columns_from_text,
                      words)

BITS = 18
PER_CLASS = 3_000           # sampled labelled documents per class
FACTORS = 4
STEMS = (4, 5)              # leading bytes of a word that are terms of their own
EPOCHS = 80
L1 = 0.01                   # a weight's pull towards zero while the frequent terms are chosen
MISJUDGED = 3               # misjudged texts that a pair of terms must share to be tried
CHANCE = 0.05               # chance that a term, or a pair, without a tie to the classes is told


def terms(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hashed term) of the distinct terms of each text: its words, and stems of longer words."""
    texts = [raw(t.lower() if isinstance(t, str) else t) for t in texts]
    rows = [np.zeros(0, np.int64)]
    for lo, hi in chunks(texts):
        w = words(texts[lo:hi], LETTERLIKE)
        found = [(w.doc, w.hash)]
        for n in STEMS:
            long = w.length >= n
            found.append((w.doc[long], run_hash(w.buf, w.start[long], np.full(int(long.sum()), n)) + np.uint64(n)))
        rows += [np.unique(np.concatenate([(d + lo) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64) for d, h in found]))]
    both = np.concatenate(rows)
    return both >> BITS, both & ((1 << BITS) - 1)


def margins(row: np.ndarray, term: np.ndarray, n: int, model: dict) -> np.ndarray:
    """Bias, weights of the terms present, and half of (square of sums - sum of squares) of their factors."""
    live = model["live"][term]
    row, term = row[live], term[live]
    out = model["bias"] + np.bincount(row, model["w"][term], n)
    for f in range(model["v"].shape[1]):
        v = model["v"][term, f]
        out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _shrink(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def evidence(n: np.ndarray, toxic: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """How surprising it is that ``toxic`` of ``n`` texts are toxic where the model expects ``expected``: chance
    comes this far in one of exp(evidence) cases at most (Hoeffding)."""
    n, toxic, expected = np.maximum(n, 1e-9).astype(float), toxic.astype(float), expected.astype(float)
    a, b = np.clip(toxic / n, 0, 1), np.clip(expected / n, 1e-9, 1 - 1e-9)
    part = lambda x, y: np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / y), 0)
    return n * (part(a, b) + part(1 - a, 1 - b))


def telling_pairs(r: np.ndarray, c: np.ndarray, y: np.ndarray, p: np.ndarray, m: int, chance: float = CHANCE) -> np.ndarray:
    """Which of ``m`` terms form, with another, a pair whose texts the model ``p`` misjudges beyond chance.

    A pair that tells something makes the model err, so pairs are looked for in the misjudged texts only: those
    of terms that share at least MISJUDGED of them. Their evidence then counts over all texts. The bound is that of
    all pairs of the terms tried. Terms are met in blocks, so working arrays stay small.
    """
    told, wrong = np.zeros(m, bool), np.abs(y - p) >= 0.5
    at = wrong[r]
    often = np.flatnonzero(np.bincount(c[at], minlength=m) >= MISJUDGED)
    q = len(often)
    if q < 2:
        return told
    slot = np.full(m, -1)
    slot[often] = np.arange(q)
    inside = at & (slot[c] >= 0)
    line = np.cumsum(wrong) - 1
    x = np.zeros((q, int(wrong.sum())), np.float32)
    x[slot[c[inside]], line[r[inside]]] = 1
    bound = np.log(max(q * q / 2, 1) / chance)
    order = np.argsort(c, kind="stable")
    cut = np.searchsorted(c[order], np.arange(m + 1))
    texts = lambda k: r[order[cut[k]:cut[k + 1]]]
    has = np.zeros(len(y), bool)
    for i in range(q):
        both = np.flatnonzero(x[i + 1:] @ x[i] >= MISJUDGED) + i + 1
        if not len(both):
            continue
        has[:] = False
        has[texts(often[i])] = True
        found = [t[has[t]] for t in (texts(k) for k in often[both])]
        n, toxic, expected = (np.array([f(t) for t in found], float) for f in (len, lambda t: y[t].sum(), lambda t: p[t].sum()))
        beyond = evidence(n, toxic, expected) >= bound
        if beyond.any():
            told[often[i]] = told[often[both[beyond]]] = True
    return told


def _descend(row: np.ndarray, term: np.ndarray, y: np.ndarray, v: np.ndarray | None, pull: np.ndarray, epochs: int):
    """Bias, weights, factors and margins by full-batch Adagrad on the logistic loss, both classes weighing the same."""
    n, m = len(y), len(pull)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, bias, sw, sb = np.zeros(m), 0.0, np.full(m, 1e-8), 1e-8
    factors = 0 if v is None else v.shape[1]
    sv, z = np.full((m, factors), 1e-8), np.zeros(n)
    for _ in range(epochs):
        z = bias + np.bincount(row, w[term], n)
        if factors:
            sums = np.stack([np.bincount(row, v[term, f], n) for f in range(factors)], 1)
            z += 0.5 * (sums ** 2 - np.stack([np.bincount(row, v[term, f] ** 2, n) for f in range(factors)], 1)).sum(1)
        g = (sigmoid(z) - y) * weight
        gw, gb = np.bincount(term, g[row], m), g.sum()
        sw, sb = sw + gw ** 2, sb + gb ** 2
        w = _shrink(w - 0.3 * gw / np.sqrt(sw), 0.3 * pull / np.sqrt(sw))
        bias -= 0.3 * gb / np.sqrt(sb)
        for f in range(factors):
            gv = np.bincount(term, g[row] * sums[row, f], m) - gw * v[:, f]
            sv[:, f] += gv ** 2
            v[:, f] = _shrink(v[:, f] - 0.05 * gv / np.sqrt(sv[:, f]), 0.05 * pull / np.sqrt(sv[:, f]))
    return bias, w, v, z


def train(row: np.ndarray, term: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS) -> dict:
    """Learns the weights and factors of all terms that tell the classes apart, alone or in pairs, together.

    Every term of three or more texts is tried. Told are those that keep a linear weight under a soft
    threshold; those, however rare, whose texts the fitted model misjudges beyond chance; and those of pairs
    whose texts it does, even if neither term alone tells anything. After each addition the model is fitted
    anew, until nothing is left beyond chance. Terms at chance get no weight, as the thousands of them in a
    long text would drown the others. A rarer term is pulled to zero less, so that it can reach its weight.
    """
    size = 1 << BITS
    model = {"bias": 0.0, "w": np.zeros(size), "v": np.zeros((size, factors)), "live": np.zeros(size, bool)}
    if not len(y) or y.min() == y.max():
        model["bias"] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    prior = np.log((y == 1).sum() / (y == 0).sum())
    keep = np.flatnonzero(np.bincount(term, minlength=size) >= 3)
    slot = np.full(size, -1)
    slot[keep] = np.arange(len(keep))
    inside = slot[term] >= 0
    r, c, m = row[inside], slot[term[inside]], len(keep)
    n, toxic = np.bincount(c, minlength=m), np.bincount(c, y[r], m)
    share = np.bincount(c, np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())[r], m)
    pull = np.minimum(L1 / 8, share / 16)
    told = _descend(r, c, y, None, np.full(m, L1), epochs)[1] != 0
    while True:
        at, own = np.cumsum(told) - 1, told[c]
        v = np.random.default_rng(7).normal(0, 0.02, (int(told.sum()), factors))
        bias, w, v, z = _descend(r[own], at[c[own]], y, v, pull[told], epochs)
        p = sigmoid(z + prior)                              # the classes as frequent as in the sample
        new = (evidence(n, toxic, np.bincount(c, p[r], m)) >= np.log(max(m, 1) / CHANCE)) & ~told
        if not new.any():
            new = telling_pairs(r, c, y, p, m) & ~told
        if not new.any():
            break
        told |= new
    keep = keep[told]
    model["bias"], model["w"][keep], model["v"][keep] = bias, w, v
    model["live"][keep] = True
    return model


def fit(documents: DataFrame, labels: DataFrame, modulo: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> dict:
    """Learns from at most about ``per_class`` labelled rows of each class outside the held-out fold.

    Only the distinct hashed terms of the sampled whole texts reach the driver. Without labels the model
    says 0.5 for every text; with one class only it says that class.
    """
    sample = labelled_sample(labels, "toxic", modulo, held_out, per_class)

    def gather(batches):
        import pandas as pd
        for b in batches:
            r, t = terms(b["text"])
            cut = np.searchsorted(r, np.arange(1, len(b)))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "y": b["target"].to_numpy(),
                                "t": [x.tobytes() for x in np.split(t.astype("<i4"), cut)]})
    rows = sorted(((r["doc_id"], r["t"], r["y"]) for r in sampled_texts(documents, sample)
                   .mapInPandas(gather, "doc_id long, y int, t binary").toLocalIterator()), key=lambda x: x[:2])
    term = np.frombuffer(b"".join(t for _, t, _ in rows), "<i4")
    return train(np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) // 4 for _, t, _ in rows]), term, np.array([y for *_, y in rows]))


def score(documents: DataFrame, model: dict) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on) to every row; other columns are kept.

    A null text is scored as an empty one: by the bias alone. Columns with the names of the results are
    replaced. The model has a fixed size, whatever the data.
    """
    def apply(texts):
        row, term = terms(texts)
        p = sigmoid(margins(row, term, len(texts), model))
        return {"score": p, "predicted": (p >= 0.5).astype("int32")}
    return with_columns_from_text(documents, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())],
                                  apply, 1000)
