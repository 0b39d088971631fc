"""The pipeline's stages, each on its own input, and odd rows through all of them."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_joins import brute

import corpus_pipeline
from shelfline.llm import ngram_join, packing, textkit

SF = "/root/testdata/sf0.01"


def test_names_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "packing"]
    kept = docs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        kept = corpus_pipeline.settle(stage(spark, kept, SF), name)
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert kept.columns == docs.columns and after <= set(before) and len(after) == kept.count()
        if name == "language":
            assert len(after) >= 0.99 * len(before)
        if name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect() if r.doc_id in before}
            assert np.mean([i in after for i, y in toxic.items() if y == 0]) > 0.97 and np.mean([i not in after for i, y in toxic.items() if y]) > 0.9
        if name == "near_duplicates":
            assert after == {c for _, c in brute(before, 5, 80).values()}
        if name == "mixing":
            size = kept.groupBy("source").agg(F.sum(F.length("text")).alias("n")).toPandas().set_index("source").n
            assert len(after) > 0.3 * len(before) and len(size) > 1
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    assert set(out.doc_id) == after and (out.groupby("sequence_id").length.sum() <= 4096).all()


def test_mixing_keeps_every_row_in_slot_order(spark):
    """One source holds a third of the text, and one a single row; neither ends the mix."""
    rows = [(i, "t" * 20_000, None if i == 0 else "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows + rows[5:6], "doc_id long, text string, source string")
    out = [r.doc_id for r in corpus_pipeline.mixed(spark, docs, SF).select("doc_id").collect()]
    assert sorted(out) == sorted([r[0] for r in rows] + [5])
    slot = {r.doc_id: r.mix_slot for r in corpus_pipeline.mixing.mix(docs).select("doc_id", "mix_slot").where("doc_id != 5").collect()}
    at = [slot[i] for i in out if i != 5]
    assert at == sorted(at)


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "12 !", "en", "a", 4), (None, "the text of nobody is here", "en", "b", 1),
            (4, "the text of somebody is here", "en", None, 2), (4, "the text of somebody is here", "en", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), name)
        assert docs.columns[-1] == "score" and docs.count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_no_model_is_no_filter(spark, tmp_path):
    """Without languages, and without labels or with labels of one class, the filters keep every document."""
    docs = spark.createDataFrame([(i, f"some words of text {i}", None, "a", 20) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, SF).count() == 8
    for k, rows in enumerate(([], [(1, 1, 1), (2, 1, 1)], [(1, None, None)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert corpus_pipeline.harmless(spark, docs, f"{tmp_path}/{k}").count() == 8


def test_sequences_follow_the_mix(spark):
    """Sources of very different sizes: each turn of sequences holds them as its slots of the mix do."""
    rows = [(i, f"w{i} " * 4000, "hot" if i % 3 else "s1") for i in range(150)] + [(None, "nobody", "s1"), (3, "again", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.packed(spark, docs, SF).toPandas()
    slot = {r.doc_id: r.s for r in corpus_pipeline.mixing.mix(docs).groupBy("doc_id").agg(F.min("mix_slot").alias("s")).collect()}
    turns = corpus_pipeline.MIX_TURNS
    last = max(s for i, s in slot.items() if i is not None) + 1
    want = [turns - 1 if np.isnan(i) else slot[i] * turns // last for i in out.doc_id]
    assert out.mix_turn.tolist() == want and len(out.doc_id.unique()) == 151
    range_ = out.groupby("mix_turn").sequence_id.agg(["min", "max"]).sort_index()
    assert (range_["min"].to_numpy()[1:] > range_["max"].to_numpy()[:-1]).all()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 4096
    sources = {i: s for i, _, s in rows}
    share = out[out.mix_turn < turns - 2].assign(hot=[sources.get(i) == "hot" for i in out[out.mix_turn < turns - 2].doc_id])
    share = share[share.hot].groupby("mix_turn").length.sum() / share.groupby("mix_turn").length.sum()
    assert len(share) == turns - 2 and share.max() - share.min() < 0.35


def test_batches_are_bounded_in_bytes(spark):
    """Python workers get no more than about BATCH_BYTES at a time, however long the documents are."""
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 50000)").alias("text"))

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})
    stage = corpus_pipeline._in_batches(lambda s, d, _: d.mapInArrow(seen, "rows long, bytes long"))
    got = stage(spark, docs, SF).collect()
    assert sum(r["rows"] for r in got) == 400 and max(r["bytes"] for r in got) <= 2 * corpus_pipeline.BATCH_BYTES


def test_stages_give_back_what_others_remember():
    """A tokenizer is kept from task to task of its stage, and not while the worker runs tasks of other stages."""
    with open(corpus_pipeline.tokenizer_path(), encoding="utf-8") as f:
        told = f.read()
    first = packing._encoder(told)
    assert list(textkit.releasing(lambda b: b, remembers=True)([1])) == [1] and packing._encoder(told) is first
    assert list(textkit.releasing(lambda b: b)([1])) == [1] and not textkit._remembered
    assert packing._encoder(told) is not first


def test_common_ngrams_do_not_depend_on_batches(spark):
    docs = spark.createDataFrame([(i, f"one passage of many documents w{i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    key, counted = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    held = spark.conf.get(key)
    for rows in (2, 7, 10_000):
        spark.conf.set(key, rows)
        counted.append(sorted(tuple(r) for r in ngram_join.signatures(docs, 5).select("h1", "h2", "n_shingles", "docs").collect()))
    spark.conf.set(key, held)
    assert counted[0] == counted[1] == counted[2] and any(r[3] == 50 for r in counted[0])
