"""Language, toxicity and quality models: held-out accuracy, and texts and columns of every kind."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfline.llm import langid, quality_mil, toxicity
from shelfline.llm.textkit import fold_of, labelled_sample

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", "en"), (3, "a", "de"), (4, " \n ", None), (None, "word " * 40000, "fr"), (5, "12 34 !!", "en"), (5, "12 34 !!", "en"),
       (6, "ελληνικά κείμενο", "el")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    """Nulls, empty, blank, very long, repeated and letterless texts, with columns named like the results."""
    rows = [(i, t, lang, "x", 7, dt.date(2026, 1, 1)) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, Predicted int, day date")


def test_language_held_out(spark, docs):
    out = langid.predict(docs, langid.fit(docs)).where(fold_of("doc_id", 3) == 1)
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert out.where("rejected").count() <= 2 and out.where("score < 0 or score > 1").isEmpty()


def test_language_odd_rows(spark, docs):
    rows = langid.predict(odd(spark), langid.fit(docs)).collect()
    assert len(rows) == len(ODD) and rows[0].day == dt.date(2026, 1, 1) and "Predicted" in rows[0]
    for r in rows:
        lettered = r.text is not None and any(map(str.isalpha, r.text))
        assert (r.lang_pred == "und") == (not lettered) and (lettered or (r.score == 0 and r.rejected)) and 0 <= r.score <= 1


FOREIGN = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. ",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。"}


def test_language_rejects_what_it_has_not_learned(spark):
    import random
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    draw = random.Random(4)
    model = langid.fit(docs)
    rows = [(n, "none", "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))) for n in (16, 32, 100, 400, 2000) for _ in range(200)]
    rows += [(n, name, (text * 60)[:n]) for name, text in FOREIGN.items() for n in (16, 32, 100, 400, 2000)]
    out = langid.predict(spark.createDataFrame(rows, "n int, kind string, text string"), model).toPandas()
    passed = (~out.rejected).groupby([out.kind, out.n]).mean().unstack()
    assert (passed.loc["none", [32, 100, 400, 2000]] <= 0.03).all() and passed.loc["none", 16] <= 0.1, passed
    assert (passed.loc[["el", "ja", "ru"]] == 0).all().all()
    held = langid.predict(docs, model).where((fold_of("doc_id", 3) == 1) & F.col("lang").isNotNull())
    assert held.where("rejected").count() <= 0.005 * held.count()


def test_language_score_is_the_plain_cosine(docs):
    """Counts, weights, cosine and nearest centroid in plain loops, with the hash of the operator."""
    import math
    import re
    model = langid.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    fast = langid.vectors(langid.gram_counts(texts), model["idf"]) @ model["centroids"].T
    for text, row in zip(texts, fast):
        data = b" " + b" ".join(re.sub(rb"[^a-z\x80-\xff]", b" ", text.lower().encode()).split()) + b" "
        count = {}
        for i in range(len(data) - 2):
            dim = (int.from_bytes(data[i:i + 3], "big") * 2654435761 % 2 ** 32) >> 20
            count[dim] = count.get(dim, 0) + 1
        weight = {d: math.log(1 + n) * float(model["idf"][d]) for d, n in count.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        plain = [sum(w * float(c[d]) for d, w in weight.items()) / norm for c in model["centroids"]]
        assert row.tolist() == pytest.approx(plain, abs=1e-5)


def test_limits_of_languages_with_few_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("one", "en"), ("ein", "de"), ("", "fr"), ("12", "it")] * 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=9)
    assert set(model["langs"]) == {"de", "en"} and (model["least"] >= langid.NEAR_ZERO).all() and (model["least"] <= 1).all()
    assert langid.stretches(["", "  "], 2, 8, 5, __import__("numpy").random.default_rng(1)) == []


def test_language_without_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert langid.predict(none, model).count() == 0
    assert [r.lang_pred for r in langid.predict(odd(spark).where("doc_id = 3"), model).collect()] == ["und"]


def test_toxicity_held_out(spark, docs, labels):
    out = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("toxic is not null")
    rate = {r.toxic: r.p for r in out.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rate[1] > 0.9 and rate[0] < 0.03


def test_toxicity_pairs():
    """Two terms that are harmless alone and toxic together."""
    import numpy as np
    rng, rows, y = np.random.default_rng(1), [], []
    for i in range(600):
        a, b = rng.integers(0, 2, 2)
        rows.append([1] * int(a) + [2] * int(b) + list(rng.integers(10, 60, 5)))
        y.append(int(a and b))
    row = np.repeat(np.arange(600), [len(set(r)) for r in rows])
    term = np.concatenate([sorted(set(r)) for r in rows])
    model = toxicity.train(row, term, np.array(y))
    p = toxicity.sigmoid(toxicity.margins(row, term, 600, model))
    assert ((p >= 0.5) == np.array(y)).mean() > 0.97
    assert float(model["v"][1] @ model["v"][2]) > 0.1


def noisy(rng, found):
    """Rows and terms of texts: the terms of each in ``found``, and 60 of 3,000 others."""
    import numpy as np
    rows = [np.unique(np.concatenate([np.array(x, int), rng.choice(np.arange(100, 3100), 60, False)])) for x in found]
    return np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows)


def test_toxicity_pair_without_marginal_signal():
    """Toxic if exactly one of two terms is there: neither tells anything alone."""
    import numpy as np
    rng = np.random.default_rng(3)
    has = rng.integers(0, 2, (2000, 2))
    y = has.sum(1) % 2
    row, term = noisy(rng, [np.flatnonzero(h) + 1 for h in has])
    learned = row < 1500
    model = toxicity.train(row[learned], term[learned], y[:1500])
    p = toxicity.sigmoid(toxicity.margins(row, term, 2000, model))[1500:]
    assert ((p >= 0.5) == y[1500:]).mean() > 0.95
    assert float(model["v"][1] @ model["v"][2]) < 0


def test_toxicity_rare_insult():
    """An insult in 1% of the toxic texts and in no clean one, beside one that most toxic texts hold."""
    import numpy as np
    rng = np.random.default_rng(4)
    y = np.arange(6000) % 2
    common, rare = (y == 1) & (rng.random(6000) < 0.9), np.zeros(6000, bool)
    rare[rng.choice(np.flatnonzero((y == 1) & ~common), 30, False)] = True
    row, term = noisy(rng, [[1] * int(a) + [2] * int(b) for a, b in zip(common, rare)])
    model = toxicity.train(row, term, y)
    p = toxicity.sigmoid(toxicity.margins(row, term, 6000, model))
    assert model["w"][2] > 0 and (p[rare] >= 0.5).mean() > 0.9 and (p[y == 0] < 0.5).mean() > 0.97


def test_quality_held_out(spark, docs, labels):
    out = quality_mil.score(docs, quality_mil.fit(docs, labels)).join(labels, "doc_id").where(fold_of("doc_id", 3) == 1)
    rate = {r.quality: r.p for r in out.groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert rate[1] > 0.95 and rate[0] < 0.3


@pytest.mark.parametrize("module", [toxicity, quality_mil])
def test_scores_of_odd_rows(spark, docs, labels, module):
    model = module.fit(docs, labels)
    rows = module.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and rows[0].lang == "en" and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert rows[0].score == rows[1].score and rows[5].score == rows[6].score
    none = spark.createDataFrame([], "doc_id long, text string")
    assert module.score(none, model).count() == 0
    bare = module.fit(docs, labels.where("doc_id < 0"))
    assert {r.score for r in module.score(odd(spark).limit(3), bare).collect()} == {0.5}


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1), (3, 1)], "doc_id long, toxic int"))
    sample = labelled_sample(labels, "toxic", 5, 0, 200)
    assert sample.where(fold_of("doc_id", 5) == 0).isEmpty() and sample.count() == sample.select("doc_id").distinct().count()
    assert all(100 < r["count"] < 300 for r in sample.groupBy("target").count().collect())


def test_quality_of_a_text_does_not_depend_on_its_neighbours(spark, docs, labels):
    model = quality_mil.fit(docs, labels)
    again = quality_mil.fit(docs.repartition(7, "text"), labels.repartition(3))
    texts = docs.select("doc_id", "text").unionByName(odd(spark).select("doc_id", F.concat("text", F.lit("\n\n")).alias("text")))
    first = quality_mil.score(texts, model)
    mixed = quality_mil.score(texts.orderBy(F.xxhash64("text")), again).select("text", F.col("score").alias("other"))
    both = first.join(mixed.distinct(), first["text"].eqNullSafe(mixed["text"]))
    assert both.where("abs(score - other) > 1e-6").isEmpty() and both.count() >= texts.count()


def test_line_feeds_count_for_their_own_text():
    import numpy as np
    from shelfline.llm.textkit import SPACE, raw, words
    texts = ["a\nb", "", "\n", "c", "\n\nd\n", "e f\n\n"]
    w = words([raw(t) for t in texts], ~SPACE)
    counted = np.bincount(w.doc[quality_mil.own_line_feeds(w)], minlength=len(texts))
    assert counted.tolist() == [1, 0, 0, 0, 3, 2]


def plain_margin(terms, model):
    """Bias, weights, and the sum over all pairs of the products of their factors."""
    live = [t for t in terms if model["live"][t]]
    pairs = sum(float(model["v"][a] @ model["v"][b]) for i, a in enumerate(live) for b in live[i + 1:])
    return model["bias"] + sum(model["w"][t] for t in live) + pairs


def test_toxicity_margin_is_the_sum_over_pairs(docs, labels):
    model = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    row, term = toxicity.terms(texts)
    fast = toxicity.margins(row, term, len(texts), model)
    assert fast.tolist() == pytest.approx([plain_margin(term[row == i].tolist(), model) for i in range(len(texts))])


def test_attention_is_the_plain_weighted_sum():
    import numpy as np
    rng = np.random.default_rng(2)
    m = quality_mil.train(*quality_mil.passages(["good words here. " * 90, "spam $$$ !!! " * 200, "fine text, again. " * 130, "### win *** "]), np.array([1, 0, 1, 0]), epochs=5)
    owner, x = quality_mil.passages(["one two three " * 150, "", "win $$$ " * 5])
    f = quality_mil.attend(owner, x, 3, m)
    for i in range(3):
        h = [np.tanh(((v - m["mean"]) / m["scale"]) @ m["E"] + m["e"]) for v in x[owner == i]]
        a = np.array([float((np.tanh(v @ m["V"]) / (1 + np.exp(-(v @ m["U"])))) @ m["a"]) for v in h])
        w = np.exp(a) / np.exp(a).sum()
        z = sum(k * v for k, v in zip(w, h))
        assert f["p"][i] == pytest.approx(1 / (1 + np.exp(-(z @ m["c"] + m["b"]))))
