"""The contract queries of this subpackage, each one operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chats, exact_dedup, html_text, langid, licenses, mixing, negatives, packing, phrases, simhash, tokens, topk, toxicity
from quarry.llm.common import table
from quarry.llm.oracles import ORACLES

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: A document is toxic from this score on.
TOXIC_AT = 0.7


def fold(ident: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit(""))), F.lit(of))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", F.when(F.col("score") >= TOXIC_AT, 1).otherwise(0).alias("predicted"))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score``: labels are learned from documents that are not held out."""
    held = fold(F.col("doc_id"), 3) == 1
    labelled = toxicity.with_labels(docs.filter(~held), labels)
    return toxicity.score(docs.select("doc_id", "text"), labelled, ["doc_id"]).withColumn("held_out", held)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    found = langid.predict(docs, langid.fit(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


#: A conversation of control strings, which the contract adds to the table.
PLANTED_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PLANTED_CHAT, "conv_id long, turn long, role string, text string"))
    tokenizer = public_tokenizers.path(BYTE_BPE)
    read = chats.read_back(chats.format_chats(chats.conversations(rows), tokenizer), tokenizer)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_exact_top_k, op3_best_fit_packing, op4_toxicity, op5_exact_dedup, op6_simhash_near_dedup, op7_token_counts, op8_html_extraction, op9_language_id, op10_mixing, op11_phrase_mining, op12_chat_formatting, op13_hard_negatives)
}


def queries() -> dict:
    """The operators' queries and the pipeline that chains five of them."""
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
