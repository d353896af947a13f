"""Queries that run a stream over the documents to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions.encode import encoder, with_end_of_text
from tokenloom.functions.text import long_enough
from tokenloom.operators import carving, mixing
from tokenloom.operators.filters import score_at_least
from tokenloom.plans.corpus import MIXES, merges, need_tokens, with_scores
from tokenloom.plans.registry import artifact, query
from tokenloom.plans.sqltext import PER_BATCH, SHARD, sql
from tokenloom.session import spread, stage, staging_path
from tokenloom.sources.mixes import with_mix_source
from tokenloom.streaming import ingest


def passing_tokens(spark, sf_dir, docs):
    """``source, doc_id, ids`` of the documents the train mix may use: length and score rule, then token ids."""
    encode = encoder(merges(spark, sf_dir))
    named = with_mix_source(docs.where(long_enough(F.col("text"))), MIXES["train"])
    scored = with_scores(spark, sf_dir, named).where(score_at_least(F.col("min_score"), F.col("score")))
    return scored.select("source", "doc_id", with_end_of_text(encode(F.col("text"))).alias("ids"))


@query("stream_token_totals", sql(
    "select source, count(*)::BIGINT as docs, sum(n_tok)::BIGINT as tokens from tokens_train group by source", "tokens_train"))
def stream_token_totals(spark, sf_dir):
    """Running token totals per source, kept as streaming state."""
    docs = ingest.read_table(spark, f"{sf_dir}/documents.parquet")
    table = staging_path(spark, "totals")
    ingest.running_source_totals(
        passing_tokens(spark, sf_dir, docs).select("source", F.size("ids").alias("n_tok")), table,
        staging_path(spark, "totals-ckpt")).awaitTermination()
    return ingest.latest_version(spark, table)


@artifact
def ingested(spark, sf_dir):
    """The table a stream appends to: filtered, encoded documents."""
    table = staging_path(spark, "ingest")
    ingest.append_batches(
        ingest.read_table(spark, f"{sf_dir}/documents.parquet"), lambda b: passing_tokens(spark, sf_dir, spread(b)), table,
        staging_path(spark, "ingest-ckpt")).awaitTermination()
    return spark.read.parquet(table)


@query("stream_tokenise", sql("select doc_id, source, n_tok::INT as n_tok from tokens_train", "tokens_train"))
def stream_tokenise(spark, sf_dir):
    """Filter and encode while reading."""
    return ingested(spark, sf_dir).select("doc_id", "source", F.size("ids").alias("n_tok"))


@query("stream_carve", sql(
    "select split, shard_idx, sum(n_tok)::BIGINT as tokens, count(*)::BIGINT as chunks from carved_train group by split, shard_idx",
    "carved_train"))
def stream_carve(spark, sf_dir):
    """Mix and carve the table that the stream has appended to."""
    docs = stage(ingested(spark, sf_dir).select("source", "doc_id", F.size("ids").cast("long").alias("n_tok")), "stream-sizes")
    total, need = need_tokens(docs, "train")
    mixed = stage(mixing.token_deficit_mix(docs, MIXES["train"], need, PER_BATCH), "stream-mix")
    return carving.carve(mixed, SHARD, MIXES["train"].val_tokens, "train", total).groupBy("split", "shard_idx").agg(
        F.sum("n_tok").cast("long").alias("tokens"), F.count(F.lit(1)).alias("chunks"))
