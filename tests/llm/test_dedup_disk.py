"""What the near-duplicate stage leaves on disk, and which rows it moves."""
import re

import pytest
from pyspark.sql import functions as F

from test_joins import brute

import corpus_pipeline
from shelfline import session
from shelfline.llm import ngram_join

SF = "/root/testdata/sf0.01"


def written(spark, since):
    """Sizes of the settled tables that are still there, by label."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    for p in session._settled[since:]:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            label = re.search(r"shelfline-(\w+)-", p)[1]
            out[label] = out.get(label, 0) + fs.getContentSummary(path).getLength()
    return out


def test_large_tables_go_once_they_are_read(spark):
    docs, since = spark.read.parquet(f"{SF}/documents.parquet"), len(session._settled)
    kept = corpus_pipeline.distinct(spark, docs, SF)
    left = written(spark, since)
    assert not left.keys() & {"keys", "texts", "parts", "members", "split"} and "apart" in left
    assert kept.count() == ngram_join.link_documents(docs).where("doc_id = component_id").select("doc_id").distinct().count()


def test_texts_are_not_moved_where_ids_are_unique(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = ngram_join.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert not moved and "min_by" not in plan


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_repeated_and_missing_ids(spark, limit):
    """Of rows of one id that stands one stays, of one that does not stand none; rows without an id all stay."""
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z a b c d")
    rows = [(1, a, "x"), (2, a, "y"), (3, b, "x"), (3, b, "x"), (4, c, "p"), (4, c, "q"), (5, b, "z"), (5, b, "z"),
            (None, a, "n"), (None, a, "n"), (6, None, "e"), (7, "", "e"), (7, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("source", "doc_id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        out = ngram_join.deduplicate(docs)
        got = sorted((r.doc_id or 0, r.text or "", r.source) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns == docs.columns
    four = docs.where("doc_id = 4").select(F.min_by("source", F.xxhash64("source", "doc_id", "text"))).first()[0]
    assert got == sorted([(1, a, "x"), (3, b, "x"), (4, c, four), (0, a, "n"), (0, a, "n"), (6, "", "e"), (7, "", "e")])


def test_parts_meet_only_parts_of_near_sizes(spark, monkeypatch):
    """A chain of documents of growing sizes is one block; its parts are compared where a link is possible."""
    words = [f"w{i}" for i in range(4_000)]
    rows = [(i, " ".join(words[:12 + 10 * (i // 2)] + [f"x{i}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    # all are candidates of each other: every document is given one component
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)], "a long, b long")
    monkeypatch.setattr(ngram_join, "candidates", lambda *_: edges)
    settle, seen = ngram_join.settle, {}
    monkeypatch.setattr(ngram_join, "settle", lambda df, label: seen.update({label: r.count()}) or r if (r := settle(df, label)) is not None else r)
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(docs).collect()}
    want = {k: c for k, (_, c) in brute(dict(rows), 5, 80).items()}
    assert got == want
    assert 0 < seen.get("portions", 0) < 400 * 20 / 2        # 20 parts; each met all the others before
