"""Queries over the corpus: filters, mixes, order, vocabulary, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.encode import decoder, encoder, with_end_of_text
from tokenloom.functions.text import FIRST_MERGE, long_enough
from tokenloom.operators import bpe, bpe_draft, bpe_ranges, carving, mixing, ordering
from tokenloom.operators.filters import score_at_least
from tokenloom.plans.registry import artifact, digest, query, rounded, table
from tokenloom.plans.sqltext import MERGES, PER_BATCH, SHARD, SPLIT, VAL, ids_text, sql
from tokenloom.session import bound_batches, spread, stage, staging_path
from tokenloom.sources.mixes import (
    Mix, Source, choose_mix, read_sources, read_spec, table_mixes, tokenizer_mix, with_mix_source, write_spec,
)

MIXES = table_mixes(SHARD, VAL)


# -- artifacts ------------------------------------------------------------

def with_scores(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Add the optional quality score. Texts and ids stay out of this join."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return docs.join(labels, "doc_id", "left")


def passing(spark: SparkSession, sf_dir: str, mix: str) -> DataFrame:
    """``source, doc_id, score, n_chars`` of the documents a mix may use."""
    docs = table(spark, sf_dir, "documents").where(long_enough(F.col("text"))).select(
        "doc_id", "source", F.char_length("text").alias("n_chars"))
    named = with_mix_source(docs, choose_mix(MIXES, mix))
    scored = with_scores(spark, sf_dir, named)
    return scored.where(score_at_least(F.col("min_score"), F.col("score"))).drop("min_score")


def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing documents with one token per character, plus the end-of-text."""
    return passing(spark, sf_dir, "train").select(
        "source", "doc_id", (F.col("n_chars") + 1).cast("long").alias("n_tok"))


def need_tokens(docs: DataFrame, mix: str) -> tuple[int, int]:
    """(tokens of the passing documents, tokens the mix must supply for as many)."""
    total = docs.agg(F.sum("n_tok")).first()[0]
    return total, carving.stream_need(total, MIXES[mix].shard_tokens, MIXES[mix].val_tokens)


@artifact
def char_mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    docs = stage(char_tokens(spark, sf_dir), "char-tokens")
    total, need = need_tokens(docs, "train")
    return stage(mixing.token_deficit_mix(docs, MIXES["train"], need), "char-mix"), total


def byte_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and code documents for vocabulary training, unfiltered."""
    text = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.lit("text").alias("source"), "doc_id", "text")
    code = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.lit("code").alias("source"), F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return mixing.union_sources([text, code])


def byte_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored first: ordering samples its input, and the texts are read once.
    sizes = stage(byte_sources(spark, sf_dir).select(
        "source", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")), "sizes")
    return mixing.byte_budget_mix(sizes, tokenizer_mix())


#: Merges of the larger vocabulary, of which no SQL keeps track; its first MERGES are those of the smaller.
LARGE = 512


#: Pieces that the smaller vocabularies are drafted from.
SMALL_HEAD = 100_000


def train_vocabulary(spark: SparkSession, sf_dir: str, size: int = MERGES) -> DataFrame:
    texts = mixing.taken_rows(byte_sources(spark, sf_dir), byte_mix(spark, sf_dir), "doc_id")
    return bpe_draft.train_drafted(spark, bpe.piece_counts(texts), FIRST_MERGE + size, head_size=SMALL_HEAD)


@artifact
def merges(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The trained vocabulary, at most 65,536 pairs."""
    return bpe.merge_list(train_vocabulary(spark, sf_dir))


@artifact
def vocabulary_file(spark: SparkSession, sf_dir: str) -> str:
    """Where the larger vocabulary is stored, for the jobs that read it."""
    path = staging_path(spark, "vocabulary")
    bpe.write_vocabulary(train_vocabulary(spark, sf_dir, LARGE), path)
    return path


def large_merges(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    return bpe.merge_list(bpe.read_vocabulary(spark, vocabulary_file(spark, sf_dir)))


#: The whole vocabulary, special tokens and bytes included.
FULL = 32_768


@artifact
def full_vocabulary_file(spark: SparkSession, sf_dir: str) -> str:
    """Where the whole vocabulary is stored: as many merges as fit, or as there are pairs that occur twice."""
    bound_batches(spark)
    texts = mixing.taken_rows(byte_sources(spark, sf_dir), byte_mix(spark, sf_dir), "doc_id")
    path = staging_path(spark, "full-vocabulary")
    bpe.write_vocabulary(bpe_ranges.train_by_ranges(spark, bpe.piece_counts(texts), FULL), path)
    return path


def full_merges(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    return bpe.merge_list(bpe.read_vocabulary(spark, full_vocabulary_file(spark, sf_dir)))


def encode_documents(spark: SparkSession, sf_dir: str, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    encode = encoder(merges(spark, sf_dir) if pairs is None else pairs)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", "text", with_end_of_text(encode(F.col("text"))).alias("ids"))


@artifact
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids, end-of-text included: what all later jobs read."""
    coded = encode_documents(spark, sf_dir).where(long_enough(F.col("text")))
    return stage(coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tok")), "tokens")


def mixed_tokens(spark: SparkSession, sf_dir: str, mix: str) -> tuple[DataFrame, int]:
    sizes = with_mix_source(token_table(spark, sf_dir).select("doc_id", "source", "n_tok"), MIXES[mix])
    docs = with_scores(spark, sf_dir, sizes).where(score_at_least(F.col("min_score"), F.col("score")))
    docs = stage(docs.select("source", "doc_id", "n_tok"), f"sizes-{mix}")
    total, need = need_tokens(docs, mix)
    return stage(mixing.token_deficit_mix(docs, MIXES[mix], need, PER_BATCH), f"mix-{mix}"), total


# -- queries --------------------------------------------------------------

@query("quality_filter", sql(
    "select source, doc_id, score, length(text)::INT as n_chars from passing_train", "passing_train"))
def quality_filter(spark, sf_dir):
    return passing(spark, sf_dir, "train").select("source", "doc_id", "score", "n_chars")


@query("corpus_mix_schedule", sql(
    "select split, shard_idx, source, sum(n_tok)::BIGINT as tokens, count(*)::BIGINT as pieces, "
    "round(sum(n_tok) / sum(sum(n_tok)) over (partition by split, shard_idx), 6) as share "
    "from carved_chars group by split, shard_idx, source", "carved_chars"))
def corpus_mix_schedule(spark, sf_dir):
    """What each shard is made of: filter, mix, carve, shares."""
    mixed, total = char_mix(spark, sf_dir)
    carved = carving.carve(mixed, SHARD, VAL, "train", total)
    per = carved.groupBy("split", "shard_idx", "source").agg(
        F.sum("n_tok").cast("long").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    shard = per.groupBy("split", "shard_idx").agg(F.sum("tokens").alias("all"))
    return per.join(shard, ["split", "shard_idx"]).select(
        "split", "shard_idx", "source", "tokens", "pieces", rounded(F.col("tokens") / F.col("all")).alias("share"))


@query("mix_token_deficit", sql("select source, epoch::INT as epoch, doc_id, n_tok, batch_no, start from mix_chars", "mix_chars"))
def mix_token_deficit(spark, sf_dir):
    return char_mix.fresh(spark, sf_dir)[0].select("source", "epoch", "doc_id", "n_tok", "batch_no", "start")


@query("mix_from_spec", sql("select source, epoch::INT as epoch, doc_id, n_tok, batch_no, start from mix_chars", "mix_chars"))
def mix_from_spec(spark, sf_dir):
    """The same mix, its sources, weights and sizes read from a specification file."""
    path = staging_path(spark, "spec")
    write_spec(spark, MIXES, path)
    mix = choose_mix(read_spec(spark, path), "train")
    docs = stage(char_tokens(spark, sf_dir), "char-tokens")
    total = docs.agg(F.sum("n_tok")).first()[0]
    need = carving.stream_need(total, mix.shard_tokens, mix.val_tokens)
    return mixing.token_deficit_mix(docs, mix, need).select("source", "epoch", "doc_id", "n_tok", "batch_no", "start")


@query("mix_from_paths", sql("select source, epoch::INT as epoch, doc_id, n_tok, batch_no, start from mix_chars", "mix_chars"))
def mix_from_paths(spark, sf_dir):
    """The same mix out of four folders that differ in fields, nesting, types and scores, as a specification file lists them."""
    named = with_mix_source(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIXES["train"])
    named = named.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    shapes = {
        "edu": named.select("doc_id", "text", F.col("quality").alias("int_score"), F.lit(0.0).alias("score")),
        "web": named.select(F.col("doc_id").alias("url_id"), F.col("text").alias("content")),
        "code": named.select(F.struct(F.col("doc_id").alias("id"), F.struct(F.col("text").alias("body")).alias("file")).alias("blob")),
        "math": named.select("doc_id", F.lit("m").alias("kind"), F.col("quality").cast("double").alias("score"), "text"),
    }
    fields = {"web": ("content", "url_id"), "code": ("blob.file.body", "blob.id")}
    own = []
    for s in MIXES["train"].sources:
        path = staging_path(spark, f"source-{s.name}")
        shapes[s.name].where(named["source"] == s.name).write.parquet(path)
        text, key = fields.get(s.name, ("text", "doc_id"))
        own.append(Source(s.name, s.weight, path=path, text_field=text, id_field=key, min_score=s.min_score))
    spec = staging_path(spark, "path-spec")
    write_spec(spark, {"train": Mix(tuple(own), SHARD, VAL)}, spec)
    mix = choose_mix(read_spec(spark, spec), "train")
    docs = read_sources(spark, mix).where(long_enough(F.col("text")) & score_at_least(F.col("min_score"), F.col("score")))
    sizes = stage(docs.select("source", "doc_id", (F.char_length("text") + 1).cast("long").alias("n_tok")), "path-tokens")
    total = sizes.agg(F.sum("n_tok")).first()[0]
    need = carving.stream_need(total, mix.shard_tokens, mix.val_tokens)
    return mixing.token_deficit_mix(sizes, mix, need).select("source", "epoch", "doc_id", "n_tok", "batch_no", "start")


@query("mix_shares", sql(
    "select source, count(*)::BIGINT as docs, sum(n_tok)::BIGINT as tokens, "
    "round(sum(n_tok) / sum(sum(n_tok)) over (), 6) as share from mix_chars group by source", "mix_chars"))
def mix_shares(spark, sf_dir):
    return mixing.mix_shares(char_mix(spark, sf_dir)[0]).withColumn("share", rounded(F.col("share")))


@query("mix_byte_budget", sql("select source, doc_id, n_bytes, start from byte_mix", "byte_mix"))
def mix_byte_budget(spark, sf_dir):
    return byte_mix(spark, sf_dir)


SAMPLE = 400


@query("seeded_sample", sql(
    f"select doc_id, place from (select doc_id, row_number() over (order by md5('0:' || doc_id), doc_id) - 1 as place "
    f"from documents) where place < {SAMPLE}"))
def seeded_sample(spark, sf_dir):
    """Seeded shuffle of all documents, then take."""
    return ordering.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), 0, ["doc_id"], SAMPLE)


BUFFER = 256
_DRAW = f"('0x' || substr(md5('0:' || (r - {BUFFER})), 1, 12))::BIGINT % {BUFFER}"


@query("buffered_shuffle", sql(
    "with d as (select doc_id, row_number() over (order by doc_id) - 1 as r from documents), "
    f"h as (select doc_id, greatest(r - {BUFFER}, -1) as step, case when r < {BUFFER} then r else {_DRAW} end as slot from d), "
    "m as (select doc_id, slot, lead(step) over (partition by slot order by step) as place from h) "
    "select doc_id, place from m where place is not null union all "
    f"select doc_id, row_number() over (order by md5('0:end:' || slot), slot) - 1 + (select count(*) from h where step >= 0) "
    "from m where place is null"))
def buffered_shuffle(spark, sf_dir):
    """The order in which a reader with a buffer of 256 documents gives them out."""
    return ordering.buffered_shuffle(table(spark, sf_dir, "documents"), ["doc_id"], 0, BUFFER)


@query("epoch_permutation", sql(
    "select epoch::INT as epoch, doc_id, row_number() over (partition by epoch order by "
    "md5((epoch * 100)::VARCHAR || ':' || doc_id), doc_id) - 1 as place from documents, "
    "(select unnest(generate_series(0, 2)) as epoch)"))
def epoch_permutation(spark, sf_dir):
    """Three epochs of 100 steps, each with its own order of all documents."""
    return ordering.epoch_permutations(table(spark, sf_dir, "documents"), ["doc_id"], 3, 100)


@query("pretokenize_counts", sql(
    f"select piece, count(*)::BIGINT as n from (select unnest(regexp_extract_all(text, '{SPLIT}')) as piece from documents) "
    "group by piece"))
def pretokenize_counts(spark, sf_dir):
    return bpe.piece_counts(spread(table(spark, sf_dir, "documents").select("text")))


@query("bpe_train", sql('select rank, l as "left", r as "right", new_id from merges', "merges"))
def bpe_train(spark, sf_dir):
    """Always trains; the later queries take over what was trained."""
    trained = train_vocabulary(spark, sf_dir)
    merges.keep(spark, sf_dir, bpe.merge_list(trained))
    return trained


@query("vocabulary", sql(f"select id, token_hex, id < 4 as special from v{MERGES}", f"v{MERGES}"))
def vocabulary(spark, sf_dir):
    """Special tokens, bytes and merged tokens with the bytes they stand for."""
    pairs = merges(spark, sf_dir)
    rows = spark.createDataFrame([(i, a, b, FIRST_MERGE + i) for i, (a, b) in enumerate(pairs)], bpe.MERGES_SCHEMA)
    return bpe.vocabulary(spark, rows).select("id", F.hex("token_bytes").alias("token_hex"), "special")


@query("bpe_encode", sql(
    f"select doc_id, (length(syms) // 7)::INT as n_tok, md5({ids_text('syms')}) as ids_md5 from doc_tokens", "doc_tokens"))
def bpe_encode(spark, sf_dir):
    coded = encode_documents(spark, sf_dir)
    return coded.select("doc_id", F.size("ids").alias("n_tok"), digest(F.col("ids")).alias("ids_md5"))


@query("bpe_train_large")
def bpe_train_large(spark, sf_dir):
    """A vocabulary beyond what chained SQL can follow; tests replay it merge by merge."""
    path = vocabulary_file.fresh(spark, sf_dir)
    vocabulary_file.keep(spark, sf_dir, path)
    return bpe.read_vocabulary(spark, path)


@query("vocabulary_stored", sql(f"select id, token_hex, id < 4 as special from v{MERGES}", f"v{MERGES}"))
def vocabulary_stored(spark, sf_dir):
    """The small vocabulary as the head of the stored one."""
    head = bpe.read_vocabulary(spark, vocabulary_file(spark, sf_dir)).where(F.col("rank") < MERGES)
    return bpe.vocabulary(spark, head).select("id", F.hex("token_bytes").alias("token_hex"), "special")


@query("bpe_encode_large")
def bpe_encode_large(spark, sf_dir):
    coded = encode_documents(spark, sf_dir, large_merges(spark, sf_dir))
    return coded.select("doc_id", F.size("ids").alias("n_tok"), digest(F.col("ids")).alias("ids_md5"))


@query("bpe_train_full")
def bpe_train_full(spark, sf_dir):
    """The whole vocabulary of 32,768 tokens; tests replay it merge by merge."""
    path = full_vocabulary_file.fresh(spark, sf_dir)
    full_vocabulary_file.keep(spark, sf_dir, path)
    return bpe.read_vocabulary(spark, path)


@query("vocabulary_full")
def vocabulary_full(spark, sf_dir):
    """All tokens of the whole vocabulary with the bytes they stand for."""
    stored = bpe.read_vocabulary(spark, full_vocabulary_file(spark, sf_dir))
    return bpe.vocabulary(spark, stored).select("id", F.hex("token_bytes").alias("token_hex"), "special")


@query("bpe_encode_full")
def bpe_encode_full(spark, sf_dir):
    coded = encode_documents(spark, sf_dir, full_merges(spark, sf_dir))
    return coded.select("doc_id", F.size("ids").alias("n_tok"), digest(F.col("ids")).alias("ids_md5"))


@query("bpe_roundtrip", sql("select doc_id, md5(text) as text_md5, true as same from documents"))
def bpe_roundtrip(spark, sf_dir):
    """Every text to ids of the whole vocabulary and back."""
    pairs = full_merges(spark, sf_dir)
    decode = decoder(bpe.token_bytes(pairs))
    back = encode_documents(spark, sf_dir, pairs).select("doc_id", "text", decode(F.col("ids")).alias("back"))
    return back.select("doc_id", F.md5("back").alias("text_md5"), (F.col("back") == F.col("text")).alias("same"))


@query("source_repeat", sql(
    "select source, (max(epoch) + 1)::INT as epochs, count(*)::BIGINT as uses, sum(n_tok)::BIGINT as tokens "
    "from mix_anneal group by source", "mix_anneal"))
def source_repeat(spark, sf_dir):
    return mixing.source_repeats(mixed_tokens(spark, sf_dir, "anneal")[0])
