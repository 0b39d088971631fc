"""The registered queries of the operators in this package: one per operator, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (conversation_repair, grid_join, html_suffix, langid, mixing, ngram_join, packing, periodic_runs, quality_mil, quality_rules, toxicity,
               warc, window_fill)
from .textkit import fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_warc_derivatives")
def op1(spark, sf_dir):
    records = warc.derive(warc.response_records(table(spark, sf_dir, "pages")))
    return records.withColumn("n_bytes", F.octet_length("block").cast("long")).withColumn("headers_crc32", F.crc32("headers")).drop("block", "headers")


@query("op2_minimum_slack_packing")
def op2(spark, sf_dir):
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_pfair_mixing")
def op3(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", "mix_phase", "mix_slot", "mix_block", "mix_chars")


@query("op4_attention_quality")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"), modulo=3, held_out=1)
    return quality_mil.score(docs, model).select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_passages", "top_passage")


@query("op5_prefix_tree_join")
def op5(spark, sf_dir):
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op6_toxicity_factorization")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), modulo=5, held_out=0)
    return toxicity.score(docs, model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op7_line_first_rules", quality_rules.SQL)
def op7(spark, sf_dir):
    return quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*quality_rules.QUERY_COLUMNS)


@query("op8_host_suffix_array")
def op8(spark, sf_dir):
    return html_suffix.extract(table(spark, sf_dir, "pages"))


@query("op9_epsilon_grid_join")
def op9(spark, sf_dir):
    return grid_join.link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query("op10_centroid_language")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, modulo=3, held_out=1)
    return langid.predict(docs.drop("lang"), model).select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op11_lightest_repair")
def op11(spark, sf_dir):
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(conversation_repair.repaired_pieces(rows, present="present"))


@query("op12_window_fill")
def op12(spark, sf_dir):
    return window_fill.fill_windows(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=2048, end_id=1)


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    found = periodic_runs.find_runs(periodic_runs.plant_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return (found.withColumn("_best", periodic_runs.strongest("runs"))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
                    F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
