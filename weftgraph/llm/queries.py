"""The operators on their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import chat_format, exact_dedup, line_dedup, media, packing, pieces, quality, sharding, simhash, url_filter
from weftgraph.llm.common import table


def vocabulary_file(name: str) -> str:
    """A file of the public vocabularies; they lie at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_vocabulary() -> packing.Vocabulary:
    import public_tokenizers

    return packing.Vocabulary(vocabulary_file("byte_bpe_50k.json"), vocabulary_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids and back: the ids, and length and hash of the text that they decode to."""
    model = vocabulary_file("piece_bpe_32k.model")
    back = pieces.round_trip(table(spark, sf_dir, "documents"), model)
    return back.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.length("text").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    back = chat_format.parse(chat_format.format_chats(chat_format.stream_of(said.unionByName(extra))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.size("dropped_lines").alias("n_dropped"), "dropped_lines", F.length("text").alias("text_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("n_bytes"), media.padded(F.col("text")).alias("payload"))
    got = media.read(media.store(rows))
    feature = F.concat_ws(";", F.format_string("type=%d", "stream_type"), F.format_string("packets=%d", "packets"), F.format_string("units=%d", F.size("pts")), F.format_string("last_pts=%d", F.try_element_at("pts", F.lit(-1))), F.concat(F.lit("access="), F.array_join(F.transform("access_bytes", lambda x: x.cast("string")), ",")), F.concat(F.lit("problems="), F.array_join("problems", ",")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.pack(table(spark, sf_dir, "documents"), byte_vocabulary())
    return pieces_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, model)
    held = F.coalesce(quality.remainder(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


RULES = (
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document whose number ends its path: bad if low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/(\d{1,18})(?:\.html|/)?$", 1)
    outcomes = pages.withColumn("number", F.when(number != "", number.cast("long"))).join(bad, "number").select("url", "bad")
    judged = url_filter.judge(pages, outcomes, RULES, most_bad=0.3)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k == "pipeline" or k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from weftgraph.llm import sql

    return {"op3_chat_formatting": sql.OP3, "op6_exact_dedup": sql.OP6, "op10_url_filters": sql.OP10}
