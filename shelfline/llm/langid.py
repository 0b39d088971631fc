"""Language identification by the nearest of several TF-IDF n-gram centroids per language."""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from shelfline.session import settle

from .textkit import chunks, fold_of, hash_share, raw, with_columns_from_text

DIMS = 4096
PER_LANGUAGE = 1_500        # sampled training documents per language for the clustering
CENTROIDS = 4               # clusters per language
ROUNDS = 12                 # k-means rounds
LENGTHS = (0, 8, 16, 32, 64, 128, 256, 1024)   # lower ends of the length classes, in n-grams
JUDGED = 5                  # one text in so many is left out of the clustering and judges the similarity that is usual
STRETCHES = 1_500           # stretches of judging texts per language and length class, at most
LOST = 0.002                # share of a language's own stretches that may be rejected, at most
NOISE = 0.99                # share of stretches with shuffled letters that is rejected, where LOST allows it
NEAR_ZERO = 0.01            # a cosine up to this is no likeness at any length

_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def gram_counts(texts) -> np.ndarray:
    """Hashed counts of the byte 3-grams of each lower-cased text; digits, punctuation and blanks are one blank."""
    texts = [b" " + b" ".join(raw(t.lower() if isinstance(t, str) else t).translate(_PLAIN).split()) + b" " for t in texts]
    out = np.zeros((len(texts), DIMS), np.float32)
    for lo, hi in chunks(texts):
        buf = np.frombuffer(b"".join(texts[lo:hi]) + b"  ", np.uint8).astype(np.uint32)
        gram = ((buf[:-2] << 16 | buf[1:-1] << 8 | buf[2:]) * np.uint32(2654435761)) >> np.uint32(20)
        at = 0
        for i in range(lo, hi):
            n = len(texts[i])
            out[i] = np.bincount(gram[at:at + n - 2], minlength=DIMS) if n > 2 else 0
            at += n
    return out


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, counts.sum(axis=1), "right") - 1


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def _training(documents: DataFrame, modulo: int, held_out: int) -> DataFrame:
    return (documents.select("doc_id", "text", "lang")
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", modulo) != held_out)))


def _document_frequency(training: DataFrame) -> tuple[int, np.ndarray]:
    """Number of training texts and, per dimension, how many of them hold it. Sums of fixed size per task."""
    def count(batches):
        n, df = 0, np.zeros(DIMS)
        for b in batches:
            for at in range(0, len(b), 256):
                c = gram_counts(b["text"].iloc[at:at + 256])
                n, df = n + len(c), df + (c > 0).sum(axis=0)
        yield pd.DataFrame({"dim": np.arange(-1, DIMS), "n": np.concatenate(([n], df)).astype("int64")})
    rows = training.select("text").mapInPandas(count, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = {r["dim"]: r["n"] for r in rows}
    return out.get(-1, 0), np.array([out.get(i, 0) for i in range(DIMS)], float)


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; one centroid per row."""
    seeds = [unit(x.mean(axis=0, keepdims=True))[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.argmin((x @ np.array(seeds).T).max(axis=1))])
    c = np.array(seeds)
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        c = unit(np.array([x[nearest == j].sum(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))]))
    return c


def stretches(texts: list[str], size: int, upto: int, most: int, rng: np.random.Generator) -> list[str]:
    """Stretches of whole words of ``size`` to ``upto`` bytes, drawn evenly from the texts that are that long."""
    split = [w for w in (t.split() for t in texts) if w]
    out = []
    for k in range(most):
        own = split[k % len(split)] if split else []
        goal, at, got = int(rng.integers(size, upto)), int(rng.integers(0, len(own) or 1)), 0
        end = at
        while end < len(own) and got < goal:
            got, end = got + len(own[end].encode("utf-8", "replace")) + 1, end + 1
        if size <= got < upto:
            out.append(" ".join(own[at:end]))
    return out


def shuffled(texts: list[str], rng: np.random.Generator) -> list[str]:
    """The same letters and blanks in random order: what a text without a language looks like."""
    return ["".join(np.array(list(t))[rng.permutation(len(t))]) for t in texts]


def least_cosines(texts: list[str], centroids: np.ndarray, idf: np.ndarray) -> list[float]:
    """Per length class the cosine below which a text is rejected.

    Stretches of the judging texts are measured for every class, so that a class that no whole text has is
    judged too. The limit is what NOISE of them stay under once their letters are shuffled, but never more than
    what all but LOST of them reach. A class without a stretch takes the limit of the nearest class with one.
    """
    rng, found = np.random.default_rng(len(texts)), {}

    def nearest(some):
        parts = [vectors(gram_counts(some[at:at + 256]), idf) @ centroids.T for at in range(0, len(some), 256)]
        return np.concatenate([p.max(axis=1) for p in parts])
    for j, size in enumerate(LENGTHS):
        upto = LENGTHS[j + 1] if j + 1 < len(LENGTHS) else 2 * size
        some = stretches(texts, max(size, 2), upto, STRETCHES, rng)
        if some:
            found[j] = max(NEAR_ZERO, min(float(np.quantile(nearest(some), LOST)), float(np.quantile(nearest(shuffled(some, rng)), NOISE))))
    return [found[min(found, key=lambda i: (abs(i - j), i))] if found else NEAR_ZERO for j in range(len(LENGTHS))]


def fit(documents: DataFrame, modulo: int = 3, held_out: int = 1, per_language: int = PER_LANGUAGE,
        k: int = CENTROIDS) -> dict:
    """Learns the model from text and non-null language of the rows outside the held-out fold.

    Inverse document frequencies cover every such row. Sizes per language, one row each, are broadcast. Clustering runs as one Spark task per language on at
    most about ``per_language`` texts. One text in JUDGED, by a hash, takes no part in the clustering: from it
    come the cosines below which a text is rejected (``least_cosines``). A language of too few texts to leave
    some out is judged by those it has. The model holds k centroids and these limits per language. No training
    rows give a model without languages.
    """
    training = _training(documents, modulo, held_out)
    n, df = _document_frequency(training)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    sizes = training.groupBy("lang").agg(F.count("*").alias("_n"))
    sample = training.join(F.broadcast(sizes), "lang").where(hash_share("doc_id") < F.lit(float(per_language)) / F.col("_n")).select("lang", "text")
    sample = settle(sample, "languages")

    def lettered(rows):
        """Texts with a vector, in order, and which of them judge."""
        texts = [t for t in sorted(rows["text"]) if len(raw(t.lower()).translate(_PLAIN).split())]
        judge = np.array([zlib.crc32(raw(t)) % JUDGED == 0 for t in texts], bool)
        return texts, judge if judge.any() and not judge.all() else None

    def centroids(key, rows):
        texts, judge = lettered(rows)
        texts = [t for i, t in enumerate(texts) if judge is None or not judge[i]]
        if not texts:
            return pd.DataFrame({"lang": [], "vector": []}, dtype=object)
        c = cluster(np.vstack([vectors(gram_counts(texts[at:at + 256]), idf) for at in range(0, len(texts), 256)]), k)
        return pd.DataFrame({"lang": [key[0]] * len(c), "vector": [v.astype(np.float32) for v in c]})
    found = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, vector array<float>").collect(), key=lambda r: (r["lang"], r["vector"]))
    c = np.array([r["vector"] for r in found], np.float32).reshape(len(found), DIMS)

    def limits(key, rows):
        texts, judge = lettered(rows)
        return pd.DataFrame({"lang": [key[0]], "least": [least_cosines([t for i, t in enumerate(texts) if judge is None or judge[i]], c, idf)]})
    least = {r["lang"]: r["least"] for r in sample.groupBy("lang").applyInPandas(limits, "lang string, least array<double>").collect()}
    return {"idf": idf, "langs": [r["lang"] for r in found], "centroids": c,
            "least": np.array([least[r["lang"]] for r in found]).reshape(len(found), len(LENGTHS))}


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """Adds lang_pred, score (cosine, 0 to 1) and rejected to every row; other columns are kept.

    A text that is null or has no letter gets ``und``, score 0, and is rejected. Any other text gets the
    language of the nearest centroid; it is rejected when its cosine is under the limit of that language and
    length class, which is NEAR_ZERO at least. Ties take the first centroid in order of language. Columns with the
    names of the three results are replaced.
    """
    def label(texts):
        langs, c, least = np.array(model["langs"], object), model["centroids"].T, model["least"]
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not len(langs):
            return {"lang_pred": ["und"] * len(texts), "rejected": [True] * len(texts), "score": [0.0] * len(texts)}
        counts = gram_counts(texts)
        s = vectors(counts, model["idf"]) @ c
        best = s.argmax(axis=1)
        score = np.clip(s[np.arange(len(s)), best], 0, 1).astype(float)
        return {"lang_pred": np.where(lettered, langs[best], "und"), "rejected": ~lettered | (score < least[best, length_class(counts)]),
                "score": np.where(lettered, score, 0.0)}
    return with_columns_from_text(documents, [
        T.StructField("lang_pred", T.StringType()), T.StructField("rejected", T.BooleanType()),
        T.StructField("score", T.DoubleType())], label, 256)
