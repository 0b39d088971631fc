"""Document quality by gated attention over encoded passages (multiple-instance learning)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

from .textkit import SPACE, chunks, labelled_sample, raw, sampled_texts, with_columns_from_text, words

PASSAGE_WORDS = 120
PER_CLASS = 2_000           # sampled labelled documents per class
HIDDEN, GATE = 24, 12       # sizes of a passage's encoding and of the attention layer
BAG = 48                    # dimensions of the hashed bag of words of a passage
EPOCHS = 150
_SIGNS = "!#*$%&|<>.,;:?'\"()-_/@{}=+"
_CLASS = np.full(256, 4, np.int64)                    # 0 lower, 1 upper, 2 digit, 3 non-ASCII, 4 other, 5... one per sign
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _i, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 5 + _i
CLASSES = 5 + len(_SIGNS)
WIDTH = CLASSES + 8 + BAG


def own_line_feeds(w) -> np.ndarray:
    """Per line feed inside a text the word after it, or the text's last word behind which it stands.

    The line feed that joins a text to the next one is no part of either. Texts without words have none.
    """
    at = np.setdiff1d(np.flatnonzero(w.buf == 10), np.append(w.doc_start[1:], len(w.buf)) - 1, assume_unique=True)
    doc = np.searchsorted(w.doc_start, at, "right") - 1
    after = np.searchsorted(w.start, at)
    follows = w.doc[after.clip(max=len(w.doc) - 1)] == doc
    follows &= after < len(w.doc)
    word = np.where(follows, after, after - 1)
    return word[(word >= 0) & (w.doc[word] == doc)]


def passages(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature vector) of the consecutive passages of every whole text; an empty text has one of zeros."""
    texts = [raw(t) for t in texts]
    owner, found = [np.zeros(0, np.int64)], [np.zeros((0, WIDTH), np.float32)]
    for lo, hi in chunks(texts):
        w = words(texts[lo:hi], ~SPACE)
        first = np.searchsorted(w.doc, np.arange(hi - lo))
        place = np.arange(len(w.doc)) - first[w.doc] if len(w.doc) else np.zeros(0, np.int64)
        fresh = place % PASSAGE_WORDS == 0
        p = np.cumsum(fresh) - 1
        n = int(fresh.sum())
        doc = w.doc[fresh]
        x = np.zeros((n, WIDTH), np.float32)
        if n:
            count = np.bincount(p, minlength=n).astype(float)
            at = np.repeat(w.start, w.length) + np.arange(int(w.length.sum())) - np.repeat(np.cumsum(w.length) - w.length, w.length)
            kind = np.bincount(np.repeat(p, w.length) * CLASSES + _CLASS[w.buf[at]], minlength=n * CLASSES).reshape(n, CLASSES)
            chars = kind.sum(axis=1)
            x[:, :CLASSES] = np.sqrt(kind / chars[:, None])
            same = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & (p[1:] == p[:-1])))
            key = w.hash ^ (p.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            _, one, often = np.unique(key, return_index=True, return_counts=True)
            distinct = np.bincount(p[one], minlength=n)
            top = np.zeros(n)
            np.maximum.at(top, p[one], often)
            lines = np.bincount(p[own_line_feeds(w)], minlength=n)
            x[:, CLASSES:CLASSES + 8] = np.stack([
                np.log1p(count) / 5, chars / count / 10, np.bincount(p, same, n) / count, distinct / count, top / count,
                np.minimum(lines / count, 1), np.bincount(p, (w.length > 20), n) / count, np.bincount(p, w.length <= 2, n) / count], 1)
            slot = (w.hash >> np.uint64(32)).astype(np.int64)
            sign = np.where(slot & 1, 1.0, -1.0)
            bag = np.bincount(p * BAG + (slot >> 1) % BAG, sign, n * BAG).reshape(n, BAG)
            x[:, CLASSES + 8:] = bag / count[:, None]
        bare = np.setdiff1d(np.arange(hi - lo), doc)
        owner.append(np.concatenate([doc, bare]) + lo)
        found.append(np.vstack([x, np.zeros((len(bare), WIDTH), np.float32)]))
    owner, found = np.concatenate(owner), np.vstack(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], found[order]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def attend(owner: np.ndarray, x: np.ndarray, n: int, m: dict) -> dict:
    """The forward pass; ``owner`` is sorted and names every text from 0 to n - 1."""
    h = np.tanh(((x - m["mean"]) / m["scale"]) @ m["E"] + m["e"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    a = (t * s) @ m["a"]
    at = np.searchsorted(owner, np.arange(n))
    e = np.exp(a - np.maximum.reduceat(a, at)[owner])
    w = e / np.add.reduceat(e, at)[owner]
    z = np.add.reduceat(w[:, None] * h, at)
    return {"h": h, "t": t, "s": s, "w": w, "z": z, "at": at, "p": _sigmoid(z @ m["c"] + m["b"])}


def train(owner: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Adam on the logistic loss of whole documents; both classes weigh the same. Gradients are written out."""
    rng = np.random.default_rng(11)
    m = {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "E": rng.normal(0, 0.1, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "a": rng.normal(0, 0.2, GATE),
         "c": rng.normal(0, 0.2, HIDDEN), "b": 0.0}
    if not len(y) or y.min() == y.max():
        m["c"], m["b"] = np.zeros(HIDDEN), 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return m
    m["mean"], m["scale"] = x.mean(axis=0), x.std(axis=0) + 1e-3
    xs, n = (x - m["mean"]) / m["scale"], len(y)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    names = ("E", "e", "V", "U", "a", "c", "b")
    m1, m2 = ({k: np.zeros_like(np.asarray(m[k], float)) for k in names} for _ in range(2))
    for step in range(1, epochs + 1):
        f = attend(owner, x, n, m)
        g = (f["p"] - y) * weight
        dz = g[:, None] * m["c"]
        dw = (f["h"] * dz[owner]).sum(axis=1)
        da = f["w"] * (dw - np.add.reduceat(f["w"] * dw, f["at"])[owner])
        dt, ds = da[:, None] * m["a"] * f["s"] * (1 - f["t"] ** 2), da[:, None] * m["a"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["w"][:, None] * dz[owner] + dt @ m["V"].T + ds @ m["U"].T) * (1 - f["h"] ** 2)
        grad = {"E": xs.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ da,
                "c": f["z"].T @ g, "b": g.sum()}
        for k in names:
            d = grad[k] + (1e-4 * m[k] if k != "b" else 0)
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * d, 0.99 * m2[k] + 0.01 * d * d
            m[k] = m[k] - 0.02 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
    return m


def fit(documents: DataFrame, labels: DataFrame, modulo: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> dict:
    """Learns from at most about ``per_class`` labelled rows of each class outside the held-out fold.

    Only passage vectors of the sampled whole texts reach the driver. Without labels the model says 0.5 for
    every text; with one class only it says that class.
    """
    sample = labelled_sample(labels, "quality", modulo, held_out, per_class)

    def gather(batches):
        for b in batches:
            owner, x = passages(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "y": b["target"].to_numpy(),
                                "x": [v.ravel() for v in np.split(x, np.searchsorted(owner, np.arange(1, len(b))))]})
    rows = sorted(sampled_texts(documents, sample).mapInPandas(gather, "doc_id long, y int, x array<float>").toLocalIterator(),
                  key=lambda r: r["doc_id"])
    x = [np.array(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]
    if not x:
        return train(np.zeros(0, int), np.zeros((0, WIDTH)), np.zeros(0))
    return train(np.repeat(np.arange(len(x)), [len(v) for v in x]), np.vstack(x).astype(float), np.array([r["y"] for r in rows]))


def score(documents: DataFrame, model: dict) -> DataFrame:
    """Adds score (0 to 1), predicted, n_passages and top_passage (the most attended one) to every row.

    A null text is scored as an empty one, that is one passage of zeros. Other columns are kept; columns
    with the names of the results are replaced. Ties in attention take the first passage.
    """
    def apply(texts):
        owner, x = passages(texts)
        f = attend(owner, x, len(texts), model)
        n = np.bincount(owner, minlength=len(texts))
        best = [int(np.argmax(f["w"][a:a + k])) for a, k in zip(f["at"], n)]
        p = np.round(f["p"], 9)         # sums of a batch may differ by its size in the last digits
        return {"score": p, "predicted": (p >= 0.5).astype("int32"), "n_passages": n.astype("int64"),
                "top_passage": np.array(best, "int64")}
    return with_columns_from_text(documents, [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("n_passages", T.LongType()), T.StructField("top_passage", T.LongType())], apply, 1000)
